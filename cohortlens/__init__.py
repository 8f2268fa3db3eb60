"""cohortlens: cohort analytics as Spark plans."""

__version__ = "0.1.0"
