"""Projections, casts, fills and row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_PROVINCE = "RAS"


def prefix_columns(df: DataFrame, prefix: str = "N_") -> DataFrame:
    """Rename every column to ``<prefix><name>``."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns})


def select_by_prefix(df: DataFrame, prefix: str, also: Sequence[str] = ()) -> DataFrame:
    return df.select(*also, *[c for c in df.columns if c.startswith(prefix) and c not in also])


def drop_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def cast_metrics(df: DataFrame, metrics: Sequence[str], to: str = "bigint") -> DataFrame:
    """Cast the metric columns; a value that does not fit becomes null."""
    return df.withColumns({m: F.col(m).try_cast(to) for m in metrics})


def fill_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """Fill nulls of every numeric column (dates and texts stay)."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(value, subset=numeric) if numeric else df


def fill_subset(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def head_or_default(array: Column, default: str = MISSING_PROVINCE) -> Column:
    """First element of an array; the default for an empty or null array."""
    return F.when(F.size(array) > 0, F.get(array, F.lit(0))).otherwise(F.lit(default))


def max_date(df: DataFrame, date: str = "Date") -> Column:
    """The last known day as a scalar subquery (nothing is collected)."""
    return df.agg(F.max(date)).scalar()


def as_day(df: DataFrame, as_of: Column | dt.date | None, date: str) -> Column:
    """The reference day: the caller's, or the last known day of ``df``."""
    if as_of is None:
        return max_date(df, date)
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def filter_recent(
    df: DataFrame, days: int, date: str = "Date", as_of: Column | dt.date | None = None
) -> DataFrame:
    """Rows no older than ``days`` before the reference day.

    ``date`` may be a date or a timestamp column; of a stored one the bound reaches
    the scan.
    """
    return df.where(F.col(date) >= F.date_sub(as_day(df, as_of, date), days))


def filter_on_date(df: DataFrame, day: Column | dt.date | None, date: str = "Date") -> DataFrame:
    """Rows of one day; a null day matches null dates."""
    return df.where(F.col(date).eqNullSafe(day if isinstance(day, Column) else F.lit(day)))


def filter_after(df: DataFrame, other: DataFrame, date: str = "Date") -> DataFrame:
    """Rows on days strictly after the last day of another table."""
    return df.where(F.col(date) >= F.date_add(max_date(other, date), 1))


def mask_after(df: DataFrame, metric: str, cutoff: Column, date: str = "Date", inclusive: bool = False) -> DataFrame:
    """Zero a metric after a day (from that day on if inclusive)."""
    day = F.col(date)
    late = day >= cutoff if inclusive else day > cutoff
    return df.withColumn(metric, F.when(late, F.lit(0)).otherwise(F.col(metric)))


def record_id(location: Column, date_text: Column) -> Column:
    """``<location>_<date>`` with colons of the date as dashes."""
    return F.concat_ws("_", location, F.regexp_replace(date_text, ":", "-"))


def geo_point(lat: Column, lon: Column) -> Column:
    """``lat,lon``; null if a side is missing."""
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def unpivot_metrics(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value"
) -> DataFrame:
    """One row per key and metric, so that one plan serves every target."""
    return df.unpivot(list(keys), list(metrics), name, value)


def round_half_up(number: Column) -> Column:
    """Prediction to a whole number (bigint): halves go up, also for negative numbers."""
    return F.floor(number + F.lit(0.5)).cast("bigint")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The row with the greatest ``order`` tuple per key.

    An aggregate rather than a ranked window: partial maxima are taken before
    the shuffle, so a key that holds a large share of the rows sends one row per task. The
    price is a sort on either side of the shuffle (the maximum of a struct is not hashed).
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)
