"""cohortlens sources."""
