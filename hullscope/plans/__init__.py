"""Registered queries: each applies operators to the driver's tables and has its SQL beside it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("prevalence", "statistics", "graphs", "catalogues", "corpus", "scanners", "files", "summaries")


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all modules."""
    from . import registry

    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
