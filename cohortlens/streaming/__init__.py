"""cohortlens.streaming."""
