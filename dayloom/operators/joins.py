"""Null-safe joins, label dictionaries and request tables.

No join here forces a broadcast. Dictionaries are stored tables, so Catalyst
knows their size and broadcasts them below the session's threshold; beyond it
they are shuffled and runtime re-planning splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.columns import prefix_columns
from dayloom.operators.sequence import number_rows
from dayloom.session import materialise


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where null keys match each other; the right copies of the keys are dropped."""
    if not keys:
        return left.join(right, how=how)
    other = prefix_columns(right.select(*keys), "_r_")
    renamed = right.withColumnsRenamed(dict(zip(keys, other.columns)))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, other.columns)])
    return left.join(renamed, on, how).drop(*other.columns)


def fit_dictionary(df: DataFrame, label: str, index: str, weight: Column | None = None) -> DataFrame:
    """Index labels from 0 (bigint), most frequent first, ties by label.

    Counts are partial before the shuffle, and the numbering is the distributed
    one of ``number_rows``: the labels are never gathered in one place. ``weight`` is
    the number of rows that a row stands for, where they were counted before.
    """
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(many.alias("n"))
    numbered = number_rows(counts, index, [F.col("n").desc(), F.col(label).asc()], unique_order=True)
    return materialise(numbered.select(label, F.col(index).cast("bigint").alias(index)), "dictionary")


def encode(df: DataFrame, dictionary: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add the indexes; rows whose label is unknown are left out."""
    return df.join(dictionary, list(labels))


def decode(df: DataFrame, dictionary: DataFrame, indexes: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Add the labels; rows whose index is unknown keep a null label."""
    if null_safe:
        return null_safe_join(df, dictionary, indexes, "left")
    return df.join(dictionary, list(indexes), "left")


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Dictionary rows already present in an encoded table."""
    return df.select(*columns).distinct()


def mapping_table(df: DataFrame, mapping: Mapping, key: str, value: str) -> DataFrame:
    """A Python dict as a two-column table; its size is known, so Catalyst decides how to join it."""
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    sample = next(v for v in mapping.values() if v is not None)
    value_type = {bool: "boolean", int: "bigint", float: "double"}.get(type(sample), "string")
    return spark.createDataFrame(list(mapping.items()), f"`{key}` {key_type}, `{value}` {value_type}")


def harmonise(df: DataFrame, label: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace the spellings in ``mapping``; other labels stay."""
    table = mapping_table(df, mapping, label, "_mapped")
    joined = df.join(table, label, "left")
    return joined.withColumn(label, F.coalesce("_mapped", label)).select(*df.columns)


def decode_lookup(df: DataFrame, column: str, mapping: Mapping, default, output: str) -> DataFrame:
    """``output`` = mapping of the value, or the default. A null key may be mapped."""
    if not mapping:
        return df.withColumn(output, F.lit(default))
    table = mapping_table(df, mapping, column, output).withColumn("_known", F.lit(True))
    joined = null_safe_join(df, table, [column], "left")
    value = F.when(F.col("_known"), F.col(output)).otherwise(F.lit(default))
    return joined.withColumn(output, value).drop("_known")


def restrict_to_requested(df: DataFrame, request: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are requested; repeated requests do not repeat rows."""
    return df.join(request, list(keys), "left_semi")


def fill_request(request: DataFrame, forecast: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The request table with the forecast metrics, null where there is no forecast."""
    return request.join(forecast.select(*keys, *metrics), list(keys), "left")


def join_targets(long: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "metric",
                 value: str = "value") -> DataFrame:
    """Long per-target results to one row per key that has every target."""
    wide = long.groupBy(*keys).pivot(name, list(metrics)).agg(F.first(value))
    return wide.dropna(subset=list(metrics))


def with_actuals(forecast: DataFrame, actuals: DataFrame, on: Sequence[str] = ("ds",)) -> DataFrame:
    """Forecast rows with the actual values of the same day where known."""
    return forecast.join(actuals, list(on), "left")
