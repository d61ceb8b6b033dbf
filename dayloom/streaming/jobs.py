"""Continuous jobs over a folder of arriving files (or any streaming source).

A store is a folder of one sub-folder per micro-batch, overwritten when a batch is repeated after a
failure, and of bases: ``compact`` folds a base and the batches up to some number into a new base,
which counts once its marker is there. Readers take the newest marked base and only the batches
after it, and of those the newest row per key. A batch that is repeated after it went into a base
writes its folder again and changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dayloom.functions.dates import from_utc_clock, utc_day
from dayloom.operators.columns import latest_per_key
from dayloom.session import delete_path, list_folder, path_exists
from dayloom.sources.marks import newer_than

_BATCH = "_batch"
_BASE = "_base"
#: Written by the committer after the last file of a write.
_MARKER = "_SUCCESS"


def file_stream(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet",
                files_per_batch: int | None = None, **options: str) -> DataFrame:
    """A stream of the files below ``path`` (a folder, a file or a glob)."""
    reader = spark.readStream.format(format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A glob is resolved to whatever is there, file or folder; a plain path must be a folder.
    glob = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return reader.load(glob)


def daily_rollup(df: DataFrame, ts: str, keys: Sequence[str], measures: dict[str, Column],
                 lateness: str = "1 day", date: str = "Date") -> DataFrame:
    """Aggregate per UTC day and keys; on a stream, days close one ``lateness`` after their end.

    ``ts`` is a wall-clock (NTZ) column read as UTC. Works on batch frames too.
    Rows with a null key are skipped.
    """
    clocked = df.na.drop(subset=[ts, *keys]).withColumn("_instant", from_utc_clock(F.col(ts)))
    days = clocked.withWatermark("_instant", lateness).groupBy(F.window("_instant", "1 day"), *keys)
    rolled = days.agg(*[m.alias(name) for name, m in measures.items()])
    return rolled.select(utc_day(F.col("window.start")).alias(date), *keys, *measures)


def _write_batch(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    return write


def start_rollup(rolled: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store every update of a streaming roll-up (default trigger: what is there now)."""
    return (
        rolled.writeStream.outputMode("update")
        .foreachBatch(_write_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def rollup_table(spark: SparkSession, path: str, keys: Sequence[str], date: str = "Date") -> DataFrame:
    """The roll-up as of the last batch: the newest update of each key and day."""
    stored = read_store(spark, path)
    return latest_per_key(stored, [date, *keys], [_BATCH], [c for c in stored.columns if c != _BATCH])


def start_incremental(stream: DataFrame, ts: str, mark: Column | dt.datetime, path: str, checkpoint: str,
                      allowed_lateness: str | None = None, **trigger) -> StreamingQuery:
    """Append rows past the mark; afterwards the checkpoint remembers which files are done."""
    return (
        newer_than(stream, ts, mark, allowed_lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_upsert(stream: DataFrame, keys: Sequence[str], version: Sequence[str], path: str, checkpoint: str,
                 **trigger) -> StreamingQuery:
    """Store the newest row per key of every micro-batch."""
    write = _write_batch(path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        write(latest_per_key(batch, keys, version).select(*batch.columns), batch_id)

    return (
        stream.writeStream.outputMode("append")
        .foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key over all batches: the greatest version, the later batch on a tie."""
    stored = read_store(spark, path)
    columns = [c for c in stored.columns if c != _BATCH]
    return latest_per_key(stored, keys, [*version, _BATCH], columns).select(*columns)


# --- stores -------------------------------------------------------------------------------------


def _numbers(spark: SparkSession, path: str, kind: str, marked: bool = False) -> list[int]:
    """Numbers of the sub-folders of a kind, rising; with ``marked`` of the whole ones only."""
    found = [int(name.partition("=")[2]) for name in list_folder(spark, path)
             if name.startswith(f"{kind}=") and name.partition("=")[2].isdigit()]
    return sorted(n for n in found if not marked or path_exists(spark, f"{path}/{kind}={n}/{_MARKER}"))


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest whole base, named by the last batch in it, and the batches after it."""
    bases = _numbers(spark, path, _BASE, marked=True)
    base = bases[-1] if bases else None
    return base, [n for n in _numbers(spark, path, _BATCH) if base is None or n > base]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """What a store holds by now, with ``_batch``: rows of a base have the number of the last batch in it."""
    base, batches = _parts(spark, path)
    if base is None and not batches:
        raise FileNotFoundError(f"nothing is stored in {path}")
    rows = None
    if batches:
        rows = spark.read.option("basePath", path).parquet(*[f"{path}/{_BATCH}={n}" for n in batches])
        rows = rows.withColumn(_BATCH, F.col(_BATCH).cast("bigint"))
    if base is not None:
        folded = spark.read.parquet(f"{path}/{_BASE}={base}").withColumn(_BATCH, F.lit(base).cast("bigint"))
        rows = folded if rows is None else folded.unionByName(rows)
    return rows


def compact(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str] = (), upto: int | None = None) -> None:
    """Fold the newest base and the batches after it (up to number ``upto``) into a new base, then delete what it replaces.

    The newest row per key is written beside all else. Until its marker stands readers see the old base
    and its batches, from then on the new base, so a failure at any point loses and doubles nothing; what
    it leaves over is deleted by the next run. Batches that arrive or are repeated meanwhile stay or are ignored.
    Run one compaction of a store at a time. The newest batch folded may be one that the stream repeats after a restart:
    it is in the base already, and its folder no longer counts.
    """
    base, batches = _parts(spark, path)
    batches = [n for n in batches if upto is None or n <= upto]
    if batches:
        stored = read_store(spark, path).where(F.col(_BATCH) <= batches[-1])
        names = [c for c in stored.columns if c != _BATCH]
        folded = latest_per_key(stored, keys, [*version, _BATCH], names).select(*names)
        folded.write.mode("overwrite").parquet(f"{path}/{_BASE}={batches[-1]}")
    remove_folded(spark, path)


def remove_folded(spark: SparkSession, path: str) -> None:
    """Delete batches and bases that the newest whole base replaces, and bases that were never whole."""
    base, _ = _parts(spark, path)
    for n in _numbers(spark, path, _BATCH):
        if base is not None and n <= base:
            delete_path(spark, f"{path}/{_BATCH}={n}")
    for n in _numbers(spark, path, _BASE):
        if n != base:
            delete_path(spark, f"{path}/{_BASE}={n}")
