import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.operators.sequence import number_rows
from dayloom.plans import pipelines
from dayloom.session import materialise
from dayloom.sources import documents, marks, sinks, tables


def test_array_payload_types(spark):
    payload = json.dumps([
        {"Country": "A", "Lat": "1.5", "Lon": "", "Confirmed": 3, "Date": "2020-01-22T00:00:00Z"},
        {"Country": "", "Province": "p", "Confirmed": "4", "Lat": "north"},
    ])
    df = spark.createDataFrame([(payload,), ("[]",), (None,), ("not json",)], "payload string")
    got = documents.explode_json_array(df, "payload").select("Country", "Province", "Lat", "Lon", "Confirmed").collect()
    assert [tuple(r) for r in got if r["Confirmed"] is not None] == [("A", None, 1.5, None, 3), (None, "p", None, None, 4)]


def test_array_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Country": "A", "Confirmed": 1}, {"Country": "B", "Confirmed": 2}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"Country": "C", "Confirmed": 3}]))
    got = documents.read_json_array_files(spark, str(tmp_path)).select("Country", "Confirmed").collect()
    assert {tuple(r) for r in got} == {("A", 1), ("B", 2), ("C", 3)}


def test_missing_store_is_empty(spark, tmp_path):
    assert documents.read_documents(spark, f"{tmp_path}/none", "a string, b int").count() == 0


def test_array_fields_take_single_values(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    lines = ['{"a":["x","y"]}', '{"a":"z"}', '{"a":[]}', '{"a":""}', '{"b":1}']
    (tmp_path / "docs" / "1.json").write_text("\n".join(lines))
    got = documents.read_documents(spark, f"{tmp_path}/docs", "a array<string>, b int", array_fields=["a"])
    assert [r["a"] for r in got.collect()] == [["x", "y"], ["z"], [], [], None]


def test_headerless_folder_with_repeated_runs(spark, tmp_path):
    df = spark.createDataFrame([("Korea, South", "", 1), ("A", "b", 2)], "c string, p string, n int")
    for mode in ("overwrite", "append", "append"):
        sinks.write_csv(df, f"{tmp_path}/csv", mode)
    names = ["c", "p", "n"]
    assert tables.read_headerless_csv(spark, f"{tmp_path}/csv", names, df.schema).count() == 6
    once = tables.read_headerless_csv(spark, f"{tmp_path}/csv", names, df.schema, dedupe=True)
    assert {r["c"] for r in once.collect()} == {"Korea, South", "A"} and once.count() == 2


def test_bulk_files_hold_100_records(spark, tmp_path):
    df = spark.range(250).select(F.concat(F.lit("r"), "id").alias("_id"), "id").coalesce(1)
    sinks.write_bulk(df, f"{tmp_path}/bulk", "_id", "idx", records_per_file=100)
    sizes = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "bulk").glob("part-*"))
    assert sizes == [100, 200, 200]
    first = sorted((tmp_path / "bulk").glob("part-*"))[0].read_text().splitlines()
    assert json.loads(first[0])["index"] == {"_index": "idx", "_type": "_doc", "_id": "r0"}
    assert json.loads(first[1]) == {"id": 0}


def test_export_spreads_a_value_and_loses_nothing(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), "id").unionByName(spark.range(3).select(F.lit("x").alias("k"), "id"))
    sinks.export_csv(rows, f"{tmp_path}/out", ["k"], files_per_value=8)
    read = spark.read.schema("id bigint, k string").csv(f"{tmp_path}/out")
    assert read.groupBy("k").count().orderBy("k").collect() == [("hot", 1000), ("x", 3)]
    assert 1 <= len(list((tmp_path / "out" / "k=hot").glob("part-*"))) <= 8


def test_rejected_payloads_are_listed(spark, tmp_path):
    bad = ['[{"a": 1', "text", '{"a": 1'] 
    df = spark.createDataFrame([(p,) for p in [*bad, "[]", "", "  ", None, '[{"Country": "A"}]']], "payload string")
    assert {r["_corrupt"] for r in documents.json_array_rejects(df, "payload").collect()} == set(bad)
    (tmp_path / "good.json").write_text('[{"Country": "A"},\n {"Country": "B"}]')
    (tmp_path / "cut.json").write_text('[{"Country": "C"}, {"Coun')
    files = documents.read_payload_files(spark, str(tmp_path))
    assert [r["file"].rsplit("/")[-1] for r in documents.json_array_rejects(files, "payload", ["file"]).collect()] == ["cut.json"]
    assert {r["Country"] for r in documents.read_json_array_files(spark, str(tmp_path)).collect()} >= {"A", "B"}


def test_nested_documents_of_a_hot_id_are_split_and_whole(spark):
    rows = [("hot", i % 7, i) for i in range(95)] + [("one", 0, 1000)]
    df = spark.createDataFrame(rows, "_id string, o int, v int").repartition(5)
    got = sinks.nest_json(df, "_id", ["v"], order=["o"], max_rows=20).collect()
    hot = sorted((r["part"], json.loads(r["json"])["data"]) for r in got if r["_id"] == "hot")
    assert [p for p, _ in hot] == [0, 1, 2, 3, 4]
    listed = [d["v"] for _, data in hot for d in data]
    assert sorted(listed) == list(range(95)) and [v % 7 for v in listed] == sorted(v % 7 for v in range(95))
    assert [json.loads(r["json"]) for r in got if r["_id"] == "one"] == [{"data": {"v": 1000}}]


def test_documents_write_nulls_and_append(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 2), None)], "Date date, n int")
    for _ in range(2):
        sinks.write_documents(sinks.forecast_documents(df, constants={"m": -1}), f"{tmp_path}/docs")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/docs").collect()]
    assert lines == ['{"Date":"02-01-2020 00:00:00","n":null,"m":-1}'] * 2


def test_push_payload(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 2), None, 2.5)], "ds date, a double, b double")
    row = sinks.push_payload(df, ["ds", "a", "b"]).first()
    assert (row["a"], row["b"]) == (-1.0, 2.5) and len(row["_id"]) == 32
    assert row["_id"] == sinks.push_payload(df, ["ds", "a"]).first()["_id"]


def test_push_payload_ids_of_several_series(spark, tmp_path):
    day = dt.date(2020, 1, 2)
    df = spark.createDataFrame([(day, "a", "b", 1.0), (day, "a,b", "", 2.0), (day, None, "b", 3.0), (day, "", "b", None)],
                               "ds date, k string, l string, n double")
    pushed = sinks.push_payload(df, ["ds", "k", "n"], keys=["k", "l"])
    assert pushed.select("_id").distinct().count() == 4 and dict(pushed.dtypes)["k"] == "string"
    assert sorted(r["n"] for r in pushed.collect()) == [-1.0, 1.0, 2.0, 3.0]
    pipelines.push_forecast(df, f"{tmp_path}/pushed", keys=["k", "l"])
    assert spark.read.json(f"{tmp_path}/pushed").select("_id").distinct().count() == 4


def test_upsert_latest(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 3, "old"), ("c", 1, "old")], "_id string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("d", 1, "new"), ("d", 2, "newer")], old.schema)
    got = {(r["_id"], r["x"]) for r in sinks.upsert_latest(old, new, ["_id"], ["v"]).collect()}
    assert got == {("a", "new"), ("b", "old"), ("c", "old"), ("d", "newer")}


def test_incremental_load_advances_only_past_the_mark(spark, tmp_path):
    def at(d):
        return dt.datetime(2020, 1, d)

    df = spark.createDataFrame([(i, at(i)) for i in range(1, 6)], "i int, ts timestamp_ntz")
    state, out = f"{tmp_path}/mark", f"{tmp_path}/out"
    marks.write_mark(spark, state, at(3))
    load = dict(ts="ts", mark_path=state, write=lambda fresh, load: fresh.write.mode("append").parquet(out))
    assert marks.incremental_load(df, **load) == {
        "load": "n000000001", "accepted": 2, "rejected": 3, "mark": at(3), "new_mark": at(5)}
    assert marks.incremental_load(df, **load) == {
        "load": "n000000002", "accepted": 0, "rejected": 5, "mark": at(5), "new_mark": at(5)}
    assert sorted(r["i"] for r in spark.read.parquet(out).collect()) == [4, 5]
    assert marks.read_mark(spark, f"{tmp_path}/none") == marks.DEFAULT_MARK
    assert marks.newer_than(df, "ts", at(5), "2 days").count() == 2


def test_numbering_of_a_hot_name_with_ties_and_copies(spark):
    rows = [("hot", 1)] * 300 + [("hot", 0)] * 10 + [("b", i) for i in range(5)] + [(None, 3)] * 4
    df = spark.createDataFrame(rows, "name string, o int").repartition(7)
    got = number_rows(df, "n", [F.col("o")], ["name"], start=10, step=2).collect()
    for name, size in (("hot", 310), ("b", 5), (None, 4)):
        mine = sorted((r["n"], r["o"]) for r in got if r["name"] == name)
        assert [n for n, _ in mine] == [10 + 2 * i for i in range(size)]
        assert [o for _, o in mine] == sorted(o for _, o in mine)


def test_numbering_spreads_a_hot_tie(spark):
    df = spark.range(4000).select(F.lit("k").alias("name"), F.lit(1).alias("o")).repartition(8)
    numbered = number_rows(df, "n", [F.col("o")], ["name"])
    stored = materialise(numbered, "spread")
    assert stored.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 3999, 4000)


def test_parse_counts(spark):
    df = spark.createDataFrame([("22-01-2020 03:04:05",), ("2020",), (None,)], "d string")
    got = [r[0] for r in df.select(dates.parse_timestamp(F.col("d"), dates.DOCUMENT_PATTERN)).collect()]
    assert got == [dt.datetime(2020, 1, 22, 3, 4, 5), None, None]


def stamped(spark, *days):
    return spark.createDataFrame([(d, dt.datetime(2020, 1, d)) for d in days], "id int, ts timestamp_ntz")


def test_a_failed_load_is_repeated_in_its_place(spark, tmp_path):
    state, target = f"{tmp_path}/mark", f"{tmp_path}/out"

    def write(fresh, load):
        fresh.write.mode("overwrite").parquet(f"{target}/load={load}")

    def broken(fresh, load):
        write(fresh, load)
        raise OSError("no space left")

    marks.incremental_load(stamped(spark, 1, 2), "ts", state, write)
    with pytest.raises(OSError):
        marks.incremental_load(stamped(spark, 1, 2, 3), "ts", state, broken)
    assert marks.finished(spark, state) == ["n000000001"]
    # More has landed since; the repetition takes it all, from the mark of the load that failed.
    counts = marks.incremental_load(stamped(spark, 1, 2, 3, 4), "ts", state, write)
    assert counts["load"] == "n000000002" and counts["accepted"] == 2
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4]
    assert marks.finished(spark, state) == ["n000000001", "n000000002"]
    assert marks.incremental_load(stamped(spark, 4), "ts", state, write)["load"] == "n000000003"


def test_late_loads_have_places_of_their_own(spark, tmp_path):
    """The mark stands still for two loads: neither takes the other's place."""
    state, target = f"{tmp_path}/mark", f"{tmp_path}/out"

    def write(fresh, load):
        fresh.write.mode("overwrite").parquet(f"{target}/load={load}")

    seen = []
    for part in ((9,), (9, 10), (8, 9, 10), ()):
        loaded = spark.read.schema("id int, ts timestamp_ntz").parquet(target) if seen else None
        marks.incremental_load(stamped(spark, *part) if part else stamped(spark, 1).limit(0), "ts", state, write,
                               allowed_lateness="30 days", loaded=loaded, keys=["id"])
        seen.append(spark.read.schema("id int").parquet(target).count())
    assert seen == [1, 2, 3, 3]


def test_routes_of_a_load(spark, tmp_path):
    at = dt.datetime
    rows = [(1, at(2020, 1, 5), None), (2, at(2020, 1, 1), None), (3, None, None), (4, None, "[3]"), (5, at(2020, 1, 9), "x")]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, bad string")
    state, target = f"{tmp_path}/mark", f"{tmp_path}/out"
    got = marks.routed_load(df, "ts", state, target, default=at(2020, 1, 2), corrupt="bad")
    assert got == {"load": "n000000001", "mark": at(2020, 1, 2), "new_mark": at(2020, 1, 5), "accepted": 1, "late": 1,
                   "undated": 1, "corrupt": 2}
    assert {(r["id"], r["route"]) for r in marks.routed(spark, state, target).collect()} == {
        (1, "accepted"), (2, "late"), (3, "undated"), (4, "corrupt"), (5, "corrupt")}
    assert [r["id"] for r in marks.routed(spark, state, target, "late").collect()] == [2]
    again = marks.routed_load(df.limit(0), "ts", state, target, corrupt="bad")
    assert again["accepted"] == 0 and again["new_mark"] == at(2020, 1, 5)
    assert marks.routed(spark, state, target).count() == 5
    assert marks.routed(spark, f"{tmp_path}/none", target) is None


PAYLOADS = ['[{"Country":"A"},3]', '{"Country":"A"}', "[null]", '[{"Other":1}]', '[{"Country":"A"}] more', '[{"Country":"A"},{"Cou',
            "  ", '\n[ {"Country":"B"} , {"Country":"C"} ]\n']


def test_column_and_file_form_agree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(PAYLOADS):
        (tmp_path / "in" / f"{i}.json").write_text(text)
    rows = spark.createDataFrame(list(enumerate(PAYLOADS)), "i int, payload string")
    columns = lambda df: sorted(((r["Country"], r["_corrupt"]) for r in df.collect()), key=str)
    by_column = columns(documents.parse_json_array(rows, "payload", "Country string"))
    by_file = columns(documents.parse_json_array_files(spark, f"{tmp_path}/in", "Country string"))
    assert by_column == by_file == sorted([
        ("A", None), (None, "3"), (None, PAYLOADS[1]), (None, "null"), (None, None), (None, PAYLOADS[4]), (None, PAYLOADS[5]),
        ("B", None), ("C", None)], key=str)
    assert documents.read_json_array_files(spark, f"{tmp_path}/in", "Country string").count() == 4
    assert documents.json_array_rejects(rows, "payload", ["i"]).count() == 5
