"""Ready-made queries over the shipped tables and their reference SQL."""

from __future__ import annotations

from importlib import import_module, util

AREAS = ("portfolio_queries", "model_queries", "policy_queries", "monitor_queries")


def all_queries():
    """The registry with every area loaded."""
    for area in AREAS:
        if util.find_spec(f"{__name__}.{area}") is not None:
            import_module(f"{__name__}.{area}")
    return import_module(f"{__name__}.registry")
