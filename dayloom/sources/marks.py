"""High-water marks, the journal of loads, and incremental loads.

The journal is an append-only table: one row when a load starts, one when it is done. A load has a
number of its own, so two loads that start from the same mark never write to the same place; a load
that was started and not done is repeated under its number and from its own mark before any new one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dayloom.operators.joins import null_safe_join
from dayloom.schemas import HIGH_WATER_MARK, LOAD_JOURNAL
from dayloom.session import path_exists

DEFAULT_MARK = dt.datetime(2019, 1, 1)
STARTED, DONE = "started", "done"
ACCEPTED, LATE, UNDATED, CORRUPT = "accepted", "late", "undated", "corrupt"


def read_mark(spark: SparkSession, path: str, default: dt.datetime = DEFAULT_MARK) -> dt.datetime:
    """The greatest mark stored so far, or the default where none is stored."""
    if not path_exists(spark, path):
        return default
    marks = spark.read.schema(HIGH_WATER_MARK).parquet(path)
    return marks.agg(F.max("mark").alias("mark")).first()["mark"] or default


def write_mark(spark: SparkSession, path: str, mark: dt.datetime) -> None:
    """Add a mark. Marks are appended, never replaced, so a failed write loses nothing."""
    _append(spark, path, mark=mark)


def _append(spark: SparkSession, path: str, **values) -> None:
    row = tuple(values.get(f.split()[0]) for f in LOAD_JOURNAL.split(", "))
    spark.createDataFrame([row], LOAD_JOURNAL).coalesce(1).write.mode("append").parquet(path)


def newer_than(df: DataFrame, ts: str, mark: Column | dt.datetime, allowed_lateness: str | None = None) -> DataFrame:
    """Rows strictly newer than the mark, which ``allowed_lateness`` (``"2 days"``) moves back."""
    return df.where(F.col(ts) > _limit(mark, allowed_lateness))


def _limit(mark: Column | dt.datetime, allowed_lateness: str | None = None) -> Column:
    limit = mark if isinstance(mark, Column) else F.lit(mark).cast("timestamp_ntz")
    return limit - F.expr(f"interval {allowed_lateness}") if allowed_lateness else limit


def load_counts(df: DataFrame, ts: str, mark: Column | dt.datetime) -> DataFrame:
    """One row: accepted and rejected rows, and the mark after the load."""
    limit = _limit(mark)
    newer = F.col(ts) > limit
    return df.agg(
        F.count_if(newer).alias("accepted"),
        F.count_if(~F.coalesce(newer, F.lit(False))).alias("rejected"),
        F.greatest(F.max(ts), limit).alias("new_mark"),
    )


# --- journal --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Load:
    """A load under way: its number, and the mark from which it starts."""

    number: int
    mark: dt.datetime

    @property
    def name(self) -> str:
        return load_name(self.number)


def load_name(number: int) -> str:
    """Folder-safe name of a load; names sort as numbers do."""
    return f"n{number:09d}"


def journal(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the journal; empty where there is none. Rows without a load are bare marks."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOAD_JOURNAL)
    return spark.read.schema(LOAD_JOURNAL).parquet(path)


def loads(spark: SparkSession, path: str) -> DataFrame:
    """One row per load: number, name, state, the mark it starts from and, when done, what it counted."""
    rows = journal(spark, path).where("load is not null").groupBy("load").agg(
        F.max(F.col("state") == DONE).alias("done"), F.min("begins").alias("begins"), F.max("mark").alias("mark"),
        F.max("accepted").alias("accepted"), F.max("rejected").alias("rejected"), F.max("inputs").alias("inputs"))
    name = F.concat(F.lit("n"), F.lpad(F.col("load").cast("string"), 9, "0"))
    return rows.withColumn("name", name)


def begin_load(spark: SparkSession, path: str, default: dt.datetime = DEFAULT_MARK, inputs: str | None = None) -> Load:
    """The load to do next: one that was started and not done, or a new one from the greatest mark.

    One writer at a time; two that begin at once would take the same number.
    """
    waiting = loads(spark, path).where("not done").orderBy("load").first()
    if waiting:
        return Load(waiting["load"], waiting["begins"])
    last = journal(spark, path).agg(F.max("load")).first()[0] or 0
    load = Load(last + 1, read_mark(spark, path, default))
    _append(spark, path, load=load.number, state=STARTED, begins=load.mark, inputs=inputs)
    return load


def finish_load(spark: SparkSession, path: str, load: Load, mark: dt.datetime | None = None, accepted: int | None = None,
                rejected: int | None = None) -> None:
    """Store that a load is done, with the mark it reached (none where it moved none)."""
    _append(spark, path, mark=mark, load=load.number, state=DONE, accepted=accepted, rejected=rejected)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads that are done: the places a reader may read."""
    return [r["name"] for r in loads(spark, path).where("done").orderBy("load").select("name").collect()]


# --- loads ------------------------------------------------------------------------------------


def incremental_load(
    df: DataFrame,
    ts: str,
    mark_path: str,
    write: Callable[[DataFrame, str], None],
    default: dt.datetime = DEFAULT_MARK,
    allowed_lateness: str | None = None,
    loaded: DataFrame | None = None,
    keys: Sequence[str] = (),
    inputs: str | None = None,
) -> dict:
    """Write the rows past the mark with ``write(rows, load)``, then advance the mark.

    ``load`` names the load; a load that failed is repeated under the same name and from the same mark, so
    a writer that puts each load in a place of its own name, overwriting it, doubles and loses no row.

    ``allowed_lateness`` looks back behind the mark; rows found there that ``loaded`` already holds
    (by ``keys``, null-safe) are left out. ``loaded`` must hold the rows of ``finished`` loads only. The counters come
    from the pass that writes: rows past the (moved) limit are accepted, the rest, undated ones included, rejected.
    """
    spark = df.sparkSession
    load = begin_load(spark, mark_path, default, inputs)
    mark = load.mark
    if allowed_lateness and loaded is not None:
        limit = F.lit(mark).cast("timestamp_ntz")
        old = df.where(F.col(ts) <= limit)
        df = df.where(~F.coalesce(F.col(ts) <= limit, F.lit(False))).unionByName(
            null_safe_join(old, loaded.select(*keys).distinct(), list(keys), "left_anti"))
    newer = F.coalesce(F.col(ts) > _limit(mark, allowed_lateness), F.lit(False))
    seen = Observation()
    counted = df.observe(seen, F.count_if(newer).alias("accepted"), F.count_if(~newer).alias("rejected"),
                         F.max(F.when(newer, F.col(ts))).alias("latest"))
    write(counted.where(newer), load.name)
    latest = seen.get["latest"]
    new_mark = max(mark, latest) if latest else mark
    accepted, rejected = seen.get["accepted"], seen.get["rejected"]
    finish_load(spark, mark_path, load, new_mark if new_mark > mark else None, accepted, rejected)
    return {"load": load.name, "accepted": accepted, "rejected": rejected, "mark": mark, "new_mark": new_mark}


def route_of(ts: str, mark: Column | dt.datetime, allowed_lateness: str | None = None, corrupt: str | None = None) -> Column:
    """Where a row of a load goes: corrupt (its text is set), undated, late (not past the mark) or accepted."""
    route = F.when(F.col(ts).isNull(), UNDATED).when(F.col(ts) > _limit(mark, allowed_lateness), ACCEPTED).otherwise(LATE)
    return F.when(F.col(corrupt).isNotNull(), CORRUPT).otherwise(route) if corrupt else route


def routed_load(
    df: DataFrame,
    ts: str,
    mark_path: str,
    target: str,
    default: dt.datetime = DEFAULT_MARK,
    allowed_lateness: str | None = None,
    corrupt: str | None = None,
    inputs: str | None = None,
) -> dict:
    """Every row of a load to a folder of its route, accepted or rejected, in one pass over the input.

    Below ``target`` the rows of a load stand in ``load=<name>/route=<route>`` as Parquet, all columns kept, so a rejected
    row can be looked at, mended and landed again. Counters per route come from the pass that writes.
    ``routed`` reads finished loads.
    """
    spark = df.sparkSession
    load = begin_load(spark, mark_path, default, inputs)
    named = df.withColumn("route", route_of(ts, load.mark, allowed_lateness, corrupt))
    seen = Observation()
    routes = (ACCEPTED, LATE, UNDATED, CORRUPT)
    counted = named.observe(seen, *[F.count_if(F.col("route") == r).alias(r) for r in routes],
                            F.max(F.when(F.col("route") == ACCEPTED, F.col(ts))).alias("latest"))
    counted.write.mode("overwrite").partitionBy("route").parquet(f"{target}/load={load.name}")
    found = seen.get
    new_mark = max(load.mark, found["latest"]) if found["latest"] else load.mark
    finish_load(spark, mark_path, load, new_mark if new_mark > load.mark else None, found[ACCEPTED],
                found[LATE] + found[UNDATED] + found[CORRUPT])
    return {"load": load.name, "mark": load.mark, "new_mark": new_mark} | {r: found[r] for r in routes}


def routed(spark: SparkSession, mark_path: str, target: str, route: str | None = None) -> DataFrame | None:
    """Rows of the finished loads, with ``load`` and ``route``; None where no load has stored any."""
    names = [n for n in finished(spark, mark_path) if path_exists(spark, f"{target}/load={n}/route=*")]
    if not names:
        return None
    rows = spark.read.option("basePath", target).parquet(*[f"{target}/load={n}" for n in names])
    return rows.where(F.col("route") == route) if route else rows
