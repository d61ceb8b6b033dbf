import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayloom import streaming

SCHEMA = "id bigint, k string, ts timestamp_ntz, v bigint"


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    return [(i, rng.choice("abc"), start + dt.timedelta(minutes=rng.randrange(6 * 1440)), rng.randrange(9))
            for i in range(300)]


def land(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def measures():
    return {"n": F.count(F.lit(1)), "v": F.sum("v")}


@pytest.mark.parametrize("files", [1, 4, 9])
def test_rollup_is_the_same_for_any_split(spark, records, tmp_path, files):
    # In order of time, so that no file is later than the watermark allows.
    ordered = sorted(records, key=lambda r: r[2])
    size = -(-len(ordered) // files)
    for i in range(files):
        land(spark, ordered[i * size:(i + 1) * size], f"{tmp_path}/in")
        stream = streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA)
        rolled = streaming.daily_rollup(stream, "ts", ["k"], measures())
        streaming.start_rollup(rolled, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = streaming.rollup_table(spark, f"{tmp_path}/out", ["k"])
    batch = streaming.daily_rollup(spark.createDataFrame(records, SCHEMA), "ts", ["k"], measures())
    columns = ["Date", "k", "n", "v"]
    assert got.select(columns).exceptAll(batch.select(columns)).isEmpty()
    assert got.count() == batch.count()


def test_rollup_skips_null_keys_and_late_days(spark, tmp_path):
    at = dt.datetime
    land(spark, [(1, "a", at(2020, 1, 10, 5), 1), (2, None, at(2020, 1, 10, 5), 1)], f"{tmp_path}/in")
    later = [[(3, "a", at(2020, 1, 10, 7), 1)], [(4, "a", at(2020, 1, 2, 7), 1)]]
    for extra in [[], *later]:
        if extra:
            land(spark, extra, f"{tmp_path}/in")
        rolled = streaming.daily_rollup(streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA), "ts", ["k"], measures())
        streaming.start_rollup(rolled, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["Date"], r["k"], r["n"]) for r in streaming.rollup_table(spark, f"{tmp_path}/out", ["k"]).collect()}
    assert got == {(dt.date(2020, 1, 10), "a", 2)}


def test_incremental_adds_each_file_once(spark, records, tmp_path):
    for part in (records[:200], records[200:]):
        land(spark, part, f"{tmp_path}/in")
        stream = streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA)
        mark = dt.datetime(2020, 1, 3)
        streaming.start_incremental(stream, "ts", mark, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(r[0] for r in records if r[2] > mark)


@pytest.mark.parametrize("files", [1, 5])
def test_upsert_keeps_the_latest_for_any_split(spark, records, tmp_path, files):
    for i in range(files):
        land(spark, records[i::files], f"{tmp_path}/in")
    stream = streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)
    streaming.start_upsert(stream, ["k"], ["ts", "id"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["k"]: r["id"] for r in streaming.read_upserted(spark, f"{tmp_path}/out", ["k"], ["ts", "id"]).collect()}
    want = {k: max((r for r in records if r[1] == k), key=lambda r: (r[2], r[0]))[0] for k in "abc"}
    assert got == want


def test_compaction_keeps_the_result_and_one_batch(spark, records, tmp_path):
    for i in range(4):
        land(spark, records[i::4], f"{tmp_path}/in")
    for part in range(2):
        stream = streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)
        streaming.start_upsert(stream, ["k"], ["ts", "id"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        before = sorted(map(tuple, streaming.read_upserted(spark, f"{tmp_path}/out", ["k"], ["ts", "id"]).collect()))
        streaming.compact(spark, f"{tmp_path}/out", ["k"], ["ts", "id"])
        after = sorted(map(tuple, streaming.read_upserted(spark, f"{tmp_path}/out", ["k"], ["ts", "id"]).collect()))
        assert before == after and not list((tmp_path / "out").glob("_batch=*"))
        assert len(list((tmp_path / "out").glob("_base=*"))) == 1
        land(spark, records[:50], f"{tmp_path}/in")


def stored(spark, path):
    return sorted(map(tuple, streaming.read_upserted(spark, path, ["k"], ["ts", "id"]).collect()))


def test_a_batch_repeated_after_compaction_loses_nothing(spark, records, tmp_path):
    for i in range(3):
        land(spark, records[i::3], f"{tmp_path}/in")
    path, checkpoint = f"{tmp_path}/out", tmp_path / "cp"
    run = lambda: streaming.start_upsert(
        streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1), ["id"], ["ts"], path, str(checkpoint)
    ).awaitTermination()
    run()
    streaming.compact(spark, path, ["id"], ["ts"])
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (checkpoint / "commits" / name).unlink()
    run()
    assert (tmp_path / "out" / f"_batch={last}").exists()
    assert streaming.read_upserted(spark, path, ["id"], ["ts"]).count() == len(records)
    land(spark, [(1000, "z", dt.datetime(2021, 1, 1), 1)], f"{tmp_path}/in")
    run()
    assert streaming.read_upserted(spark, path, ["id"], ["ts"]).count() == len(records) + 1
    streaming.compact(spark, path, ["id"], ["ts"])
    assert streaming.read_upserted(spark, path, ["id"], ["ts"]).count() == len(records) + 1


@pytest.mark.parametrize("stop", ["write", "marker", "delete"])
def test_compaction_stopped_between_steps(spark, records, tmp_path, monkeypatch, stop):
    """Stopped before the base is whole, before its marker, or before the old batches go: the same rows, and the next run mends."""
    path = f"{tmp_path}/out"
    for i in range(3):
        spark.createDataFrame(records[i::3], SCHEMA).write.parquet(f"{path}/_batch={i}")
    whole = stored(spark, path)
    if stop == "delete":
        monkeypatch.setattr(streaming.jobs, "remove_folded", lambda *a: None)
        streaming.compact(spark, path, ["k"], ["ts", "id"])
        monkeypatch.undo()
        assert len(list((tmp_path / "out").glob("_batch=*"))) == 3
    else:
        half = spark.createDataFrame(records[:5], SCHEMA)
        half.write.parquet(f"{path}/_base=2")
        (tmp_path / "out" / "_base=2" / "_SUCCESS").unlink()
        if stop == "write":
            for f in (tmp_path / "out" / "_base=2").glob("*.parquet"):
                f.unlink()
    assert stored(spark, path) == whole
    spark.createDataFrame([(999, "a", dt.datetime(2022, 1, 1), 1)], SCHEMA).write.parquet(f"{path}/_batch=3")
    newest = stored(spark, path)
    assert newest != whole
    streaming.compact(spark, path, ["k"], ["ts", "id"])
    assert stored(spark, path) == newest
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_ba")] == ["_base=3"]


def test_compaction_up_to_a_batch_and_an_empty_store(spark, records, tmp_path):
    path = f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        streaming.read_store(spark, path)
    streaming.compact(spark, path, ["k"])
    for i in range(4):
        spark.createDataFrame(records[i::4], SCHEMA).write.parquet(f"{path}/_batch={i}")
    whole = stored(spark, path)
    streaming.compact(spark, path, ["k"], ["ts", "id"], upto=1)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_base=1", "_batch=2", "_batch=3"]
    assert stored(spark, path) == whole


def test_counters_per_batch(spark, tmp_path):
    at = dt.datetime
    files = [
        [(1, "a", at(2020, 1, 10, 5), 1), (2, None, at(2020, 1, 10, 5), 1), (3, "b", None, 1)],
        [(4, "a", at(2020, 1, 20, 7), 1)],
        [(5, "a", at(2020, 1, 2, 7), 1), (6, "b", at(2020, 1, 20, 8), 1)],
    ]
    path = f"{tmp_path}/out"
    assert streaming.read_counters(spark, path).isEmpty()
    for rows in files:
        land(spark, rows, f"{tmp_path}/in")
        with streaming.counting(spark, path) as counter:
            stream = streaming.observed(streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA), "ts", ["k"])
            rolled = streaming.daily_rollup(stream, "ts", ["k"], measures())
            counter.finish(streaming.start_rollup(rolled, path, f"{tmp_path}/cp"))
    got = [tuple(r)[1:] for r in streaming.read_counters(spark, path).where("n_read > 0").orderBy("batch").collect()]
    assert got == [(3, 1, 2, 0), (1, 1, 0, 0), (2, 2, 0, 1)]
    stored = streaming.rollup_table(spark, path, ["k"])
    assert {(str(r["Date"]), r["k"], r["n"]) for r in stored.collect()} == {
        ("2020-01-10", "a", 1), ("2020-01-20", "a", 1), ("2020-01-20", "b", 1)}


def test_counters_that_cannot_be_stored_are_an_error(spark, tmp_path):
    land(spark, [(1, "a", dt.datetime(2020, 1, 10, 5), 1)], f"{tmp_path}/in")
    (tmp_path / "file").write_text("no folder")
    with streaming.counting(spark, f"{tmp_path}/file/below") as counter:
        stream = streaming.observed(streaming.file_stream(spark, f"{tmp_path}/in", SCHEMA), "ts", ["k"])
        rolled = streaming.daily_rollup(stream, "ts", ["k"], measures())
        with pytest.raises(RuntimeError):
            counter.finish(streaming.start_rollup(rolled, f"{tmp_path}/out", f"{tmp_path}/cp"))


def test_upsert_query_takes_a_large_backlog_in_few_batches(spark, tmp_path, monkeypatch):
    """The number of batches does not grow with the table, and keys still recur over several."""
    from dayloom.plans import stream_queries

    n, folder, checkpoints = 100_000, str(tmp_path), []
    spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 977)").alias("ts"),
        (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"),
    ).coalesce(2).write.parquet(f"{folder}/events.parquet")
    real = streaming.start_upsert
    monkeypatch.setattr(streaming, "start_upsert", lambda *a, **k: (checkpoints.append(a[4]), real(*a, **k))[1])
    got = {r["user_id"]: r["event_id"] for r in stream_queries.stream_upsert(spark, folder).collect()}
    assert got == {u: max(range(u, n, 50), key=lambda i: (i % 977, i)) for u in range(50)}
    batches = [name for name in stream_queries.list_folder(spark, f"{checkpoints[0]}/commits") if name.isdigit()]
    assert 2 <= len(batches) <= 8
