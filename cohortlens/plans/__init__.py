"""cohortlens plans."""
