"""Registered queries over the given tables, with the SQL that checks them."""

from __future__ import annotations


def every_query():
    """(queries by name, checking SQL by name)."""
    from . import analytics, catalog, ingest, journeys, places, upkeep  # noqa: F401
    from .registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
