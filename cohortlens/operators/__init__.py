"""cohortlens operators."""
