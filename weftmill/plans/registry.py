"""How a module's queries are registered."""

from __future__ import annotations

from collections.abc import Callable


def registered(queries: dict, sql_twins: dict, sql: str | None = None) -> Callable:
    """A decorator that puts a query, and its SQL if there is any, under the query's name."""

    def add(f: Callable) -> Callable:
        queries[f.__name__] = f
        if sql:
            sql_twins[f.__name__] = sql
        return f

    return add
