"""Calendar-lag features ``<metric>_1 .. <metric>_H``, in that order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.columns import prefix_columns
from dayloom.operators.joins import null_safe_join
from dayloom.operators.panel import assert_unique, calendar_lag


def lag_names(metric: str, horizon: int) -> list[str]:
    return [f"{metric}_{h}" for h in range(1, horizon + 1)]


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    metric: str,
    horizon: int,
    date: str = "Date",
    fill: float | None = None,
    check_unique: bool = False,
) -> DataFrame:
    """Add all lags 1..H of a metric with one shuffle and one sort.

    Every lag is a range frame of one day over the same window, so gaps in the
    calendar give null (or ``fill``) where a row lag would slip.
    """
    if check_unique:
        assert_unique(df, keys, date)
    lags = {}
    for h, name in enumerate(lag_names(metric, horizon), start=1):
        lag = calendar_lag(metric, h, keys, date)
        lags[name] = lag if fill is None else F.coalesce(lag, F.lit(fill))
    return df.withColumns(lags)


def lag_join(
    df: DataFrame, keys: Sequence[str], metric: str, days: int, date: str = "Date", fill: float | None = None
) -> DataFrame:
    """One lag as a date-shifted self join; the same result as the window form."""
    name = f"{metric}_{days}"
    past = prefix_columns(df.select(*keys, date, metric))
    past = past.select(
        *[F.col(f"N_{k}").alias(k) for k in keys],
        F.date_add(f"N_{date}", days).alias(date),
        F.col(f"N_{metric}").alias(name),
    )
    joined = null_safe_join(df, past, [*keys, date], "left")
    return joined if fill is None else joined.na.fill(fill, subset=[name])


def lag_features_by_join(
    df: DataFrame, keys: Sequence[str], metric: str, horizon: int, date: str = "Date"
) -> DataFrame:
    """All lags by one self join per day, for comparison with ``lag_features``."""
    result = df
    for h in range(1, horizon + 1):
        block = lag_join(df, keys, metric, h, date).select(*keys, date, f"{metric}_{h}")
        result = null_safe_join(result, block, [*keys, date])
    return result
