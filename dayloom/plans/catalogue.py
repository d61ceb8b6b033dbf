"""Registry of queries: a Spark plan and, where SQL can say it, its check query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name, with its check SQL if there is one."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, dedent(sql).strip() if sql else None)
        return run

    return register


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from dayloom.plans import (  # noqa: F401
        cleaning_queries,
        forecast_queries,
        io_queries,
        job_queries,
        model_queries,
        panel_queries,
        stream_queries,
    )

    return REGISTRY
