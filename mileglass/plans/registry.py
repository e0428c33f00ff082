"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from mileglass.plans import graph_queries, profile_queries, stream_queries, trip_queries
from mileglass.session import use_utc

_MODULES = (trip_queries, stream_queries, graph_queries, profile_queries)


def _in_utc(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        return query(use_utc(spark), sf_dir)
    return run


def all_queries() -> dict[str, Callable]:
    return {name: _in_utc(q) for m in _MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
