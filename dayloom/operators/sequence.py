"""Distributed row numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.session import materialise

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row position below


def number_rows(
    df: DataFrame,
    output: str,
    order: Sequence[Column],
    names: Sequence[str] = (),
    start: int = 0,
    step: int = 1,
    unique_order: bool = False,
) -> DataFrame:
    """Number the rows of each name ``start, start + step, ...`` in the given order.

    A ranking window would sort one name in one task. Instead the rows are
    range-partitioned on (name, order), positions are taken inside each
    partition, and each (name, partition) run is shifted by the rows the name
    has in earlier partitions. A hot name spreads over many partitions; the
    window runs over at most one row per (name, partition). The positions are
    stored before they are used twice, so both uses see the same partitioning.

    Unless the order is known to be unique within a name, ties are broken by the
    place of a row in a stored copy of the input: repeatable, and different even
    for identical rows, so that a large group of ties spreads as well.
    """
    columns = df.columns
    sort = [F.col(n).asc() for n in names] + list(order)
    if not unique_order:
        df = materialise(df, "sequence-input").select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
        sort += [F.col("_file"), F.col("_row")]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    marked = materialise(ranged.select(*columns, F.monotonically_increasing_id().alias("_mark")), "sequence")
    marked = marked.select(
        "*",
        F.shiftright("_mark", _POSITION_BITS).alias("_part"),
        F.col("_mark").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
    )
    runs = marked.groupBy(*names, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        *[F.col(n).alias(f"_n_{n}") for n in names],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    # Stored, so that the join is broadcast exactly when this table is small.
    shifts = materialise(shifts, "sequence-shifts")
    same_run = F.col("_part") == F.col("_p")
    for n in names:
        same_run = same_run & F.col(n).eqNullSafe(F.col(f"_n_{n}"))
    ordinal = F.col("_pos") + F.col("_shift")
    value = F.lit(start) + F.lit(step) * ordinal
    return marked.join(shifts, same_run).select(*columns, value.cast("bigint").alias(output))
