"""Operators of a training-data pipeline: each module is one operator with its own
general interface; ``catalog`` binds them to the shared tables."""
