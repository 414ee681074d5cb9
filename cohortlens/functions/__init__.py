"""cohortlens.functions."""
