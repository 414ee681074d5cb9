"""cohortlens.operators."""
