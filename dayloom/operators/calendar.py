"""Unions and future rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.columns import as_day, filter_recent


def union_positional(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by position, refused when the column names are in another order."""
    for other in others:
        if other.columns != first.columns:
            raise ValueError(f"columns differ: {first.columns} / {other.columns}")
    return reduce(DataFrame.union, others, first)


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, others, first)


def future_by_shift(
    df: DataFrame, days: int, date: str = "Date", by: int | None = None, as_of: Column | dt.date | None = None
) -> DataFrame:
    """The panel plus a copy of its recent days moved into the future.

    The copy holds the rows of the last ``days`` days, moved by ``by`` (default
    ``days``) days.
    """
    recent = filter_recent(df, days, date, as_of)
    moved = recent.withColumn(date, F.date_add(date, days if by is None else by)).select(*df.columns)
    return union_positional(df, moved)


def extend_calendar(
    df: DataFrame, keys: Sequence[str], periods: int, date: str = "Date", until: Column | dt.date | None = None
) -> DataFrame:
    """Every day from a key's first day to ``periods`` days after its last (or the common) day."""
    last = F.max(date) if until is None else as_day(df, until, date)
    spans = df.groupBy(*keys).agg(F.min(date).alias("_from"), F.date_add(last, periods).alias("_to"))
    return spans.select(*keys, F.explode(F.sequence("_from", "_to")).alias(date))
