"""Queries of the library over the driver's tables."""

from __future__ import annotations

from .registry import QUERIES, SQL


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    from . import basic, collation, files, graph, inserted, models, more, spheres, surface, timeline, traces  # noqa: F401

    return QUERIES, SQL
