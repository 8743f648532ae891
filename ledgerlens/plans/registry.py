"""Registered queries: a Spark plan and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlens.plans import oracle
from ledgerlens.plans.inputs import Inputs


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None = None


class Registry(dict[str, Query]):
    def add(self, name: str, sql: str | None = None):
        """Register the decorated plan under ``name``."""
        def register(run: Callable[[Inputs], DataFrame]):
            if name in self:
                raise ValueError(f"query {name!r} is registered twice")
            self[name] = Query(run, oracle.sql(sql.strip()) if sql else None)
            return run

        return register


def all_queries() -> Registry:
    from ledgerlens.plans import feature_queries, model_queries, review_queries

    whole = Registry()
    for part in (feature_queries.QUERIES, review_queries.QUERIES, model_queries.QUERIES):
        whole.update(part)
    return whole
