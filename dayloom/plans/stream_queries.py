"""Streaming queries, run over what is there now and read back from their sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dayloom import streaming
from dayloom.plans.catalogue import query
from dayloom.plans.views import cents, table, with_views
from dayloom.session import delete_path, list_folder, scratch_path


def _measures():
    return {"n": F.count(F.lit(1)), "cents": F.sum(cents(F.col("value")))}


def _events(spark, folder, **options):
    schema = table(spark, folder, "events").schema
    return streaming.file_stream(spark, f"{folder.rstrip('/')}/events.parquet", schema, **options)


def _finish(stream_query):
    stream_query.awaitTermination()


@query("stream_daily_rollup", with_views("events_daily", "SELECT * FROM events_daily"))
def stream_daily_rollup(spark, folder):
    path, checkpoint = scratch_path(spark, "rollup"), scratch_path(spark, "rollup-checkpoint")
    rolled = streaming.daily_rollup(_events(spark, folder), "ts", ["event_type"], _measures())
    _finish(streaming.start_rollup(rolled, path, checkpoint))
    streaming.compact(spark, path, ["Date", "event_type"])
    return streaming.rollup_table(spark, path, ["event_type"])


def _restarted(spark, checkpoint):
    """The checkpoint as after a failure before the last commit: a restart repeats the last batch."""
    commits = [int(n) for n in list_folder(spark, f"{checkpoint}/commits") if n.isdigit()]
    delete_path(spark, f"{checkpoint}/commits/{max(commits)}")


@query("stream_rollup_replayed", with_views("events_daily", "SELECT * FROM events_daily"))
def stream_rollup_replayed(spark, folder):
    # Compacted, then the last batch comes again: nothing is lost or doubled.
    path, checkpoint = scratch_path(spark, "rollup"), scratch_path(spark, "rollup-checkpoint")
    rolled = streaming.daily_rollup(_events(spark, folder), "ts", ["event_type"], _measures())
    _finish(streaming.start_rollup(rolled, path, checkpoint))
    streaming.compact(spark, path, ["Date", "event_type"])
    _restarted(spark, checkpoint)
    _finish(streaming.start_rollup(rolled, path, checkpoint))
    return streaming.rollup_table(spark, path, ["event_type"])


@query("stream_counters", """
    SELECT count(*) AS n_read, count(*) FILTER (WHERE event_type <> 'click') AS n_accepted,
           count(*) FILTER (WHERE event_type = 'click') AS n_null_key, CAST(0 AS BIGINT) AS n_late,
           count(*) FILTER (WHERE event_type <> 'click') AS n_stored FROM events""")
def stream_counters(spark, folder):
    """What a roll-up read, accepted and passed over, its last batch repeated: counted once, and all accepted rows are stored."""
    path, checkpoint, landed = (scratch_path(spark, f"counted{part}") for part in ("", "-checkpoint", "-landed"))
    events = table(spark, folder, "events")
    events.withColumn("event_type", F.nullif("event_type", F.lit("click"))).repartition(3, "event_id").write.parquet(landed)
    keys = ["event_type"]
    with streaming.counting(spark, path) as counter:
        for repeated in (False, True):
            if repeated:
                _restarted(spark, checkpoint)
            stream = streaming.observed(streaming.file_stream(spark, landed, events.schema, files_per_batch=1), "ts", keys)
            rolled = streaming.daily_rollup(stream, "ts", keys, _measures(), lateness="10000 days")
            counter.finish(streaming.start_rollup(rolled, path, checkpoint))
    counted = streaming.read_counters(spark, path).agg(
        *[F.sum(c).alias(c) for c in ("n_read", "n_accepted", "n_null_key", "n_late")])
    return counted.withColumn("n_stored", streaming.rollup_table(spark, path, keys).agg(F.sum("n")).scalar())


@query("stream_incremental", """
    SELECT event_id, ts, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'""")
def stream_incremental(spark, folder):
    path, checkpoint = scratch_path(spark, "increment"), scratch_path(spark, "increment-checkpoint")
    mark = dt.datetime(2024, 1, 10)
    # The second run finds no new files and adds nothing.
    for _ in range(2):
        _finish(streaming.start_incremental(_events(spark, folder), "ts", mark, path, checkpoint))
    return spark.read.parquet(path).select("event_id", "ts", "event_type", "value")


_LATEST = """
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
    WHERE r = 1"""


#: In how many micro-batches, at most, a table that is there already is taken in.
_BACKLOG_BATCHES = 8


@query("stream_upsert", _LATEST)
def stream_upsert(spark, folder):
    path, checkpoint = scratch_path(spark, "upsert"), scratch_path(spark, "upsert-checkpoint")
    # Land the events as several files, two or more to a micro-batch, so that keys recur over batches. Files and batches
    # grow with the table and their number does not: a batch has a price of its own, whatever it holds.
    landed = scratch_path(spark, "upsert-landed")
    events = table(spark, folder, "events")
    events.write.option("maxRecordsPerFile", max(2000, -(-events.count() // (2 * _BACKLOG_BATCHES)))).parquet(landed)
    files = sum(name.startswith("part-") for name in list_folder(spark, landed))
    keys, version = ["user_id", "event_type"], ["ts", "event_id"]
    stream = streaming.file_stream(spark, landed, events.schema, files_per_batch=max(2, -(-files // _BACKLOG_BATCHES)))
    _finish(streaming.start_upsert(stream, keys, version, path, checkpoint))
    streaming.compact(spark, path, keys, version)
    return streaming.read_upserted(spark, path, keys, version).select(*keys, "event_id", "value")


@query("stream_upsert_replayed", _LATEST)
def stream_upsert_replayed(spark, folder):
    # Four files in four batches: two, a compaction, the second batch again, the others, another compaction, the last again.
    path, checkpoint = scratch_path(spark, "upsert"), scratch_path(spark, "upsert-checkpoint")
    landed = scratch_path(spark, "upsert-landed")
    events = table(spark, folder, "events")
    keys, version = ["user_id", "event_type"], ["ts", "event_id"]
    for half in (0, 1):
        part = events.where(F.col("event_id") % 2 == half).repartition(2, "event_id")
        part.write.mode("append").parquet(landed)
        for repeated in (False, True):
            if repeated:
                streaming.compact(spark, path, keys, version)
                _restarted(spark, checkpoint)
            stream = streaming.file_stream(spark, landed, events.schema, files_per_batch=1)
            _finish(streaming.start_upsert(stream, keys, version, path, checkpoint))
    return streaming.read_upserted(spark, path, keys, version).select(*keys, "event_id", "value")
