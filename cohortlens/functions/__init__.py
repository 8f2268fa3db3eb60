"""cohortlens functions."""
