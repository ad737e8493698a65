"""Queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def check(sql: str | None = None):
    """Register the function under its own name, with the SQL it must equal."""

    def keep(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return keep
