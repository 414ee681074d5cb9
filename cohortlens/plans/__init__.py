"""cohortlens.plans."""
