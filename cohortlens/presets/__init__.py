"""cohortlens presets."""
