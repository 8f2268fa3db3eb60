"""Every operator bound to the shared tables, with its SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "sources_q",
    "scalars_q",
    "filters_q",
    "joins_q",
    "aggregates_q",
    "windows_q",
    "roles_q",
    "coverage_q",
    "selection_q",
    "quality_q",
    "forecast_q",
    "streaming_q",
    "extras_q",
)


def load():
    """All registered queries, keyed by operator id and name."""
    from .base import REGISTRY

    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
