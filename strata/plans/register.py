"""A registry of queries for one module."""

from __future__ import annotations


def registry():
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        """Register a query under its function's name, with the SQL that it must equal if there is any."""

        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
