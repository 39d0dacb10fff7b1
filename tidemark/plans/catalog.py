"""Registered queries: name to (Spark query, DuckDB oracle or None)."""

from __future__ import annotations

from . import queries_commerce, queries_events, queries_misc


def _all() -> dict:
    return {**queries_events.QUERIES, **queries_commerce.QUERIES, **queries_misc.QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
