"""Sums, pivots, differences and running totals of daily panels.

A panel has one row per (keys, day). Windows below run per key over days; after
the sum per (key, day) a key has at most one row per calendar day, which bounds
the group whatever the number of source rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A panel holds more than one row for a key and day."""


def sum_panel(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], date: str | None = "Date") -> DataFrame:
    """Sum the metrics per key and day (null keys form a group of their own)."""
    by = [*keys, date] if date else list(keys)
    return df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in metrics])


def sum_panel_known(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], date: str = "Date") -> DataFrame:
    """As ``sum_panel``, without the rows that have a null key."""
    return sum_panel(df.na.drop(subset=[*keys, date]), keys, metrics, date)


def status_pivot(
    df: DataFrame,
    keys: Sequence[str],
    statuses: Mapping[str, str],
    status: str = "Status",
    cases: str = "Cases",
) -> DataFrame:
    """Long (cases, status) rows to one summed column per status; 0 where a status is absent."""
    sums = [
        F.sum(F.when(F.col(status) == value, F.col(cases)).otherwise(F.lit(0))).alias(name)
        for value, name in statuses.items()
    ]
    return df.groupBy(*keys).agg(*sums)


def residual_rollup(
    df: DataFrame, keys: Sequence[str], total: str, parts: Sequence[str], output: str, date: str = "Date"
) -> DataFrame:
    """Per key and day the sum of ``total`` minus ``parts``; rows with a null key are skipped."""
    rest = F.col(total)
    for part in parts:
        rest = rest - F.col(part)
    known = df.na.drop(subset=[*keys, date])
    return known.groupBy(date, *keys).agg(F.sum(rest).cast("double").alias(output))


def assert_unique(df: DataFrame, keys: Sequence[str], date: str = "Date") -> DataFrame:
    """Raise if a (key, day) occurs twice: lags over such a panel would multiply rows."""
    twice = df.groupBy(*keys, date).count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise DuplicateKeyError(f"duplicate rows for {[*keys, date]}")
    return df


# --- windows over calendar days -----------------------------------------------

def by_day(keys: Sequence[str], date: str = "Date") -> WindowSpec:
    """Per key, in the order of days (a ``DateType`` column)."""
    return Window.partitionBy(*keys).orderBy(date)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def calendar_lag(metric: str, days: int, keys: Sequence[str], date: str = "Date") -> Column:
    """The metric exactly ``days`` calendar days earlier; null where that day is absent.

    A range frame over the ``DateType`` column itself, not over a number made of it,
    so that all windows of a plan share one sort. SQL text, since only there a frame
    over dates takes whole days.
    """
    partition = f"PARTITION BY {', '.join(_quoted(k) for k in keys)} " if keys else ""
    frame = f"RANGE BETWEEN {int(days)} PRECEDING AND {int(days)} PRECEDING"
    return F.expr(f"max({_quoted(metric)}) OVER ({partition}ORDER BY {_quoted(date)} {frame})")


def cumulate(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], date: str = "Date") -> DataFrame:
    """Running totals per key; rows of one day are peers and share the total."""
    window = by_day(keys, date).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({m: F.sum(m).over(window) for m in metrics})


def decumulate(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], date: str = "Date", fill: float | None = None
) -> DataFrame:
    """Each metric minus its value of the previous calendar day.

    Null where the previous day is absent, or ``fill`` if given. Negative
    differences (corrections of the source) are kept.
    """
    differences = {m: F.col(m) - calendar_lag(m, 1, keys, date) for m in metrics}
    if fill is not None:
        differences = {m: F.coalesce(d, F.lit(fill)) for m, d in differences.items()}
    return df.withColumns(differences)


def days_between(later: DataFrame, earlier: DataFrame, date: str = "Date", output: str = "days") -> DataFrame:
    """Days from the last day of one table to the last day of another, as one row."""
    last = later.agg(F.max(date).alias("_last"))
    return last.select(F.datediff("_last", earlier.agg(F.max(date)).scalar()).alias(output))
