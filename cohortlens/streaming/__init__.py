"""cohortlens streaming."""
