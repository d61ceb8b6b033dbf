"""Queries of the scans, sinks, incremental load and upsert: written to the scratch folder and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.operators import columns, joins
from dayloom.plans import pipelines
from dayloom.plans.catalogue import query
from dayloom.plans.views import (
    PANEL_METRICS,
    country_counts,
    events_daily,
    panel,
    raw_payloads,
    table,
    with_views,
)
from dayloom.schemas import API_RECORD, DAILY_PANEL, LABEL_DICTIONARY
from dayloom.session import materialise, scratch_path
from dayloom.sources import documents, marks, sinks, tables

LOAD_MARK = dt.datetime(2024, 1, 15)

# --- CSV ---------------------------------------------------------------------------


def _panel_file(spark, folder):
    row = panel(spark, folder)
    return row.select("Country", "Province", "Date", dates.month_scaled_day(F.col("Date")).alias("DateInt"),
                      *PANEL_METRICS)


_PANEL_FILE = with_views("panel", """
    SELECT "Country", "Province", "Date", round(day("Date") / CAST(1.3 AS DOUBLE) + 30 * month("Date"), 6) AS "DateInt",
           "Confirmed", "Deaths", "Recovered" FROM panel""")
_NAMES = ["Country", "Province", "Date", "DateInt", *PANEL_METRICS]


@query("scan_csv_headerless", _PANEL_FILE)
def scan_csv_headerless(spark, folder):
    path = scratch_path(spark, "headerless")
    sinks.write_csv(_panel_file(spark, folder), path)
    read = tables.read_headerless_csv(spark, path, _NAMES, DAILY_PANEL)
    return read.withColumn("DateInt", F.round("DateInt", 6))


@query("scan_csv_inferred", with_views("panel", """
    SELECT "Country", "Province", "Date", CAST("Confirmed" AS BIGINT) AS "Confirmed" FROM panel"""))
def scan_csv_inferred(spark, folder):
    # Three write runs in one folder, as one table with equal rows kept once.
    path = scratch_path(spark, "inferred")
    rows = materialise(panel(spark, folder).select("Country", "Province", "Date", "Confirmed"), "inferred-rows")
    for mode in ("overwrite", "append", "append"):
        sinks.write_csv(rows, path, mode)
    read = tables.read_headerless_csv(spark, path, rows.columns, dedupe=True)
    return columns.cast_metrics(read.withColumn("Date", F.to_date("Date")), ["Confirmed"])


@query("scan_csv_header", """
    SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'RAS' ELSE c_mktsegment END AS "Province_State",
           c_nationkey AS "Country_Region", c_acctbal AS "ConfirmedCases" FROM customer""")
def scan_csv_header(spark, folder):
    path = scratch_path(spark, "header")
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Id"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("Province_State"),
        F.col("c_nationkey").alias("Country_Region"),
        F.col("c_acctbal").alias("ConfirmedCases"),
    )
    sinks.write_csv(rows, path, header=True)
    schema = "Id bigint, Province_State string, Country_Region int, ConfirmedCases double"
    return tables.read_headered_csv(spark, path, schema, fill={"Province_State": columns.MISSING_PROVINCE})


@query("dictionary_table", with_views("dictionary", """
    SELECT "Country", "CountryIndex" FROM dictionary"""))
def dictionary_table(spark, folder):
    # Fitted once, written as CSV, read back as the fixed dictionary of later jobs.
    path = scratch_path(spark, "dictionary")
    rows = country_counts(spark, folder)
    sinks.write_csv(joins.fit_dictionary(rows, "Country", "CountryIndex", F.col("n")), path)
    return tables.read_headerless_csv(spark, path, ["Country", "CountryIndex"], LABEL_DICTIONARY)


@query("scan_csv_sep", with_views("events_daily", """
    SELECT event_type, "Date", n, cents FROM events_daily"""))
def scan_csv_sep(spark, folder):
    path = scratch_path(spark, "separated")
    sinks.write_csv(events_daily(spark, folder), path, header=True, sep=";")
    return tables.read_separated(spark, path, "event_type string, Date date, n bigint, cents bigint")


@query("sink_csv_roundtrip", """
    SELECT p_partkey, p_name, p_brand, p_retailprice, 'a,"b"' || chr(10) || p_type AS awkward FROM part""")
def sink_csv_roundtrip(spark, folder):
    path = scratch_path(spark, "roundtrip")
    rows = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_brand", "p_retailprice",
        F.concat(F.lit('a,"b"\n'), F.col("p_type")).alias("awkward"),
    )
    rows.write.mode("overwrite").option("escape", '"').csv(path)
    reader = spark.read.schema(rows.schema).option("multiLine", True).option("escape", '"')
    return reader.csv(path)


@query("sink_partitioned", with_views("events_daily", """
    SELECT event_type, "Date", n, cents, true AS within FROM events_daily"""))
def sink_partitioned(spark, folder):
    # One folder per event type, its rows dealt to at most two files.
    path = scratch_path(spark, "export")
    daily = events_daily(spark, folder)
    sinks.export_csv(daily, path, ["event_type"], files_per_value=2)
    files = tables.list_files(spark, path, "part-*.csv").groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    files = files.select(F.substring_index("folder", "=", -1).alias("event_type"), F.col("files").between(1, 2).alias("within"))
    read = spark.read.schema("Date date, n bigint, cents bigint, event_type string").csv(path)
    return read.join(files, "event_type")


@query("list_input_files", """
    SELECT 'event_type=' || event_type AS folder, 1 AS files, true AS filled FROM events GROUP BY event_type""")
def list_input_files(spark, folder):
    path = scratch_path(spark, "listing")
    events_daily(spark, folder).repartition("event_type").write.partitionBy("event_type").csv(path)
    listed = tables.list_files(spark, path, "part-*.csv")
    return listed.groupBy("folder").agg(
        F.count(F.lit(1)).cast("int").alias("files"), F.min(F.col("length") > 0).alias("filled")
    )


# --- JSON ----------------------------------------------------------------------------

_RECORDS = """
    SELECT "Country", 'C' || split_part("Country", '_', 2) AS "CountryCode", {province} AS "Province",
           CAST(NULL AS VARCHAR) AS "City", CAST(NULL AS VARCHAR) AS "CityCode",
           CAST(split_part("Country", '_', 2) || '.5' AS DOUBLE) AS "Lat", CAST(NULL AS DOUBLE) AS "Lon",
           CAST("Confirmed" AS INTEGER) AS "Confirmed", CAST("Deaths" AS INTEGER) AS "Deaths",
           CAST("Recovered" AS INTEGER) AS "Recovered",
           CAST("Confirmed" - "Deaths" - "Recovered" AS INTEGER) AS "Active",
           strftime("Date", '%Y-%m-%dT00:00:00Z') AS "Date", md5("Country" || '/' || "Province") AS "LocationID"
    FROM panel"""
_BOTH_SHAPES = with_views("panel", _RECORDS.format(province="CAST(NULL AS VARCHAR)") + "\nUNION ALL" +
                          _RECORDS.format(province='"Province"'))


@query("json_array_explode", _BOTH_SHAPES)
def json_array_explode(spark, folder):
    return documents.explode_json_array(raw_payloads(spark, folder), "payload")


@query("json_array_files", _BOTH_SHAPES)
def json_array_files(spark, folder):
    # Landed files of one JSON array per line, read by the column form.
    path = scratch_path(spark, "landed")
    raw_payloads(spark, folder).write.text(path)
    landed = spark.read.text(path)
    return documents.explode_json_array(landed, "value")


@query("json_props_extract", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS absent FROM events""")
def json_props_extract(spark, folder):
    return documents.extract_fields(table(spark, folder, "events"), "props", "k int, absent string", ["event_id"])


@query("scan_documents", with_views("panel", """
    SELECT "Country", CASE WHEN "Province" = 'BUILDING' THEN NULL ELSE "Province" END AS "Province",
           CAST("Date" AS TIMESTAMP) AS "Date", "Confirmed" FROM panel WHERE "Confirmed" > 1"""))
def scan_documents(spark, folder):
    path = scratch_path(spark, "documents")
    stored = sinks.forecast_documents(panel(spark, folder)).withColumn(
        "Province", F.when(F.col("Province") == "BUILDING", F.lit("")).otherwise(F.col("Province"))
    )
    sinks.write_documents(stored, path)
    schema = "Country string, Province string, Date string, Confirmed bigint, Deaths bigint, Recovered bigint"
    read = documents.read_documents(
        spark, path, schema, ["Country", "Province", "Date", "Confirmed"],
        date_patterns={"Date": dates.DOCUMENT_PATTERN}, where=F.col("Confirmed") > 1,
    )
    absent = documents.read_documents(spark, f"{path}-absent", schema, read.columns)
    return read.unionByName(absent.withColumn("Date", F.col("Date").cast("timestamp_ntz")))


@query("scan_documents_arrays", with_views("panel", """
    SELECT "Country", CASE WHEN "Province" = 'BUILDING' THEN 'RAS' ELSE "Province" END AS "Province",
           CAST(sum("Confirmed") AS BIGINT) AS "Confirmed" FROM panel GROUP BY 1, 2"""))
def scan_documents_arrays(spark, folder):
    # Province is stored as an array (empty where unknown), for some countries as a single value.
    path = scratch_path(spark, "arrays")
    rows = panel(spark, folder)
    is_single = F.col("Country").endswith("1")
    province = F.when(F.col("Province") == "BUILDING", F.array().cast("array<string>")).otherwise(F.array("Province"))
    sinks.write_documents(rows.where(~is_single).withColumn("Province", province), path)
    single = F.when(F.col("Province") != "BUILDING", F.col("Province"))
    sinks.write_documents(rows.where(is_single).withColumn("Province", single), path)
    schema = "Country string, Province array<string>, Confirmed bigint"
    read = documents.read_documents(spark, path, schema, array_fields=["Province"])
    named = read.withColumn("Province", columns.head_or_default(F.col("Province")))
    return named.groupBy("Country", "Province").agg(F.sum("Confirmed").alias("Confirmed"))


# --- bulk lines and documents -----------------------------------------------------------


def _bulk_source(spark, folder):
    row = panel(spark, folder)
    record = columns.record_id(F.concat_ws("/", "Country", "Province"), F.col("Date").cast("string"))
    return row.select(record.alias("_id"), "Country", "Province", F.col("Date").cast("string").alias("Date"), "Confirmed")


@query("sink_bulk_ndjson", with_views("panel", """
    WITH docs AS (SELECT "Country" || '/' || "Province" || '_' || CAST("Date" AS VARCHAR) AS _id,
        '{"Country":"' || "Country" || '","Province":"' || "Province" || '","Date":"' || CAST("Date" AS VARCHAR)
        || '","Confirmed":' || "Confirmed" || '}' AS doc FROM panel)
    SELECT value, count(*) AS n FROM (
        SELECT '{"index":{"_index":"panel", "_type":"_doc", "_id": "' || _id || '"}}' AS value FROM docs
        UNION ALL SELECT doc FROM docs) GROUP BY value"""))
def sink_bulk_ndjson(spark, folder):
    path = scratch_path(spark, "bulk")
    sinks.write_bulk(_bulk_source(spark, folder), path, "_id", "panel")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def read_bulk(spark, path):
    """Records of bulk files with the action line and the document line that follows it."""
    records = spark.read.option("lineSep", '{"index":').text(path).where("length(value) > 0")
    lines = F.split(F.concat(F.lit('{"index":'), F.rtrim(F.col("value"), F.lit("\n"))), "\n")
    return records.withColumns({"action": F.get(lines, F.lit(0)), "doc": F.get(lines, F.lit(1)), "lines": F.size(lines)})


@query("sink_bulk_files", """
    WITH daily AS (SELECT o_custkey, o_orderkey FROM orders)
    SELECT '{"index":{"_index":"orders", "_type":"_doc", "_id": "' || o_orderkey || '"}}' AS action,
           '{"o_custkey":' || o_custkey || '}' AS doc, true AS within FROM daily""")
def sink_bulk_files(spark, folder):
    # At most 100 records per file, each action line right before its own document.
    path = scratch_path(spark, "bulk")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    sinks.write_bulk(rows, path, "o_orderkey", "orders", records_per_file=100)
    records = read_bulk(spark, path).withColumn("file", F.col("_metadata.file_path"))
    sizes = records.groupBy("file").agg((F.count(F.lit(1)) <= 100).alias("within"))
    return records.where("lines = 2").join(sizes, "file").select("action", "doc", "within")


@query("nest_json_by_id", """
    WITH docs AS (SELECT o_custkey AS _id, o_orderkey,
        (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS part,
        '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS doc FROM orders)
    SELECT _id, part, '{"data":' || CASE WHEN count(*) = 1 THEN max(doc)
           ELSE '[' || string_agg(doc, ',' ORDER BY o_orderkey) || ']' END || '}' AS json
    FROM docs GROUP BY _id, part""")
def nest_json_by_id(spark, folder):
    # Parts of five, so that several parts of an id occur.
    rows = table(spark, folder, "orders").withColumnRenamed("o_custkey", "_id")
    return sinks.nest_json(rows, "_id", ["o_orderkey", "o_orderstatus"], order=["o_orderkey"], max_rows=5,
                           unique_order=True)


@query("nest_json_unique", """
    SELECT c_custkey AS _id, CAST(0 AS BIGINT) AS part,
           '{"data":{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}}' AS json FROM customer""")
def nest_json_unique(spark, folder):
    rows = table(spark, folder, "customer").withColumnRenamed("c_custkey", "_id")
    return sinks.nest_json(rows, "_id", ["c_name", "c_mktsegment"])


@query("sink_documents", with_views("events_daily", """
    SELECT '{"event_type":"' || event_type || '","Date":"' || strftime("Date", '%d-%m-%Y 00:00:00') || '","n":'
           || CASE WHEN n > 60 THEN CAST(n AS VARCHAR) ELSE 'null' END || ',"Predicted":-1}' AS value
    FROM events_daily"""))
def sink_documents(spark, folder):
    path = scratch_path(spark, "sink")
    daily = events_daily(spark, folder).select("event_type", "Date", F.when(F.col("n") > 60, F.col("n")).alias("n"))
    sinks.write_documents(sinks.forecast_documents(daily, constants={"Predicted": -1}), path)
    return spark.read.text(path)


@query("push_payload", with_views("events_daily", """
    SELECT "Date" AS ds, CAST(CASE WHEN n > 60 THEN n ELSE -1 END AS FLOAT) AS n, CAST(cents AS FLOAT) AS cents
    FROM events_daily"""))
def push_payload(spark, folder):
    daily = events_daily(spark, folder).select(
        F.col("Date").alias("ds"), F.when(F.col("n") > 60, F.col("n")).alias("n"), "cents", "event_type"
    )
    # As a sink keyed by the id has them: ids that collide would lose rows.
    return sinks.push_payload(daily, ["ds", "n", "cents"], keys=["event_type"]).dropDuplicates(["_id"]).drop("_id")


# --- incremental load and upsert -----------------------------------------------------------


@query("incremental_load", """
    SELECT event_id, ts, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'""")
def incremental_load(spark, folder):
    state, target = scratch_path(spark, "mark"), scratch_path(spark, "loaded")
    rows = table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    marks.write_mark(spark, state, LOAD_MARK)
    # A load, and a second one that finds nothing newer than the advanced mark.
    for _ in range(2):
        marks.incremental_load(rows, "ts", state, lambda fresh, load: fresh.write.mode("append").parquet(target))
    return spark.read.parquet(target)


@query("load_counters", """
    SELECT 1 AS load, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-10 00:00:00') AS accepted,
           count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') AS rejected FROM events
           WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'
    UNION ALL SELECT 2, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')),
           count(*) FILTER (WHERE ts <= (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'))
           FROM events""")
def load_counters(spark, folder):
    # Counters of two loads, from the passes that wrote them.
    state, target = scratch_path(spark, "mark"), scratch_path(spark, "loaded")
    rows = table(spark, folder, "events").select("event_id", "ts")
    marks.write_mark(spark, state, dt.datetime(2024, 1, 10))
    found = []
    for number, part in ((1, rows.where("ts <= timestamp_ntz'2024-01-20 00:00:00'")), (2, rows)):
        counts = marks.incremental_load(
            part, "ts", state, lambda fresh, load: fresh.write.mode("overwrite").parquet(f"{target}/load={load}"))
        found.append((number, counts["accepted"], counts["rejected"]))
    return spark.createDataFrame(found, "load int, accepted bigint, rejected bigint")


@query("late_rows_once", """
    SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'""")
def late_rows_once(spark, folder):
    # A second load that looks back five days finds the late rows only, not those already there.
    state, target = scratch_path(spark, "mark"), scratch_path(spark, "loaded")
    rows = table(spark, folder, "events").select("event_id", "ts")
    in_time = rows.where("event_id % 7 != 0")
    marks.write_mark(spark, state, LOAD_MARK)

    def write(fresh, load):
        fresh.write.mode("overwrite").parquet(f"{target}/load={load}")

    marks.incremental_load(in_time, "ts", state, write)
    loaded = materialise(spark.read.parquet(target).drop("load"), "loaded")
    marks.incremental_load(rows, "ts", state, write, allowed_lateness="30 days", loaded=loaded, keys=["event_id"])
    return spark.read.parquet(target).where(F.col("ts") > F.lit(LOAD_MARK).cast("timestamp_ntz")).select("event_id", "ts")


@query("late_loads_kept", """
    SELECT '{"index":{"_index":"events", "_type":"_doc", "_id": "' || event_id || '"}}' AS action,
           '{"event_type":"' || event_type || '"}' AS doc,
           CASE WHEN event_id % 7 = 0 THEN 3 WHEN ts <= TIMESTAMP '2024-01-10 00:00:00' THEN 1 ELSE 2 END AS load
    FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def late_loads_kept(spark, folder):
    # Two loads, one of late rows only (the mark stays where it is), one of nothing: the lines of all stay.
    state, bulk = scratch_path(spark, "mark"), scratch_path(spark, "bulk")
    rows = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("_id"), "event_id", "ts", "event_type")
    rows = rows.where("ts <= timestamp_ntz'2024-01-20 00:00:00'")
    in_time = rows.where("event_id % 7 != 0")

    def write(fresh, load):
        sinks.write_bulk(fresh.select("_id", "event_type"), bulk, "_id", "events", load=load)

    for part in (in_time.where("ts <= timestamp_ntz'2024-01-10 00:00:00'"), in_time, rows, rows.limit(0)):
        loaded = sinks.bulk_ids(spark, bulk, marks.finished(spark, state))
        marks.incremental_load(part, "ts", state, write, allowed_lateness="30 days", loaded=loaded, keys=["_id"])
    number = F.substring("load", 2, 9).cast("int").alias("load")
    return read_bulk(spark, bulk).where("lines = 2").select("action", "doc", number)


@query("load_routes", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'corrupt' WHEN o_orderkey % 5 = 0 THEN 'undated'
           WHEN o_orderdate > DATE '1995-06-30' THEN 'accepted' ELSE 'late' END AS route,
           count(*) OVER (PARTITION BY CASE WHEN o_orderkey % 7 = 0 THEN 'corrupt' WHEN o_orderkey % 5 = 0 THEN 'undated'
           WHEN o_orderdate > DATE '1995-06-30' THEN 'accepted' ELSE 'late' END) AS counted FROM orders""")
def load_routes(spark, folder):
    # Payloads of one element each: records, dateless ones, and elements that are no record, in one pass.
    key = F.col("o_orderkey")
    date = F.when(key % 5 == 0, F.lit("some day")).otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00Z")))
    payload = F.when(key % 7 == 0, F.when(key % 2 == 0, F.lit("[3]")).otherwise(F.lit('[{"Date":'))).otherwise(
        F.to_json(F.array(F.struct(date.alias("Date")))))
    landed = table(spark, folder, "orders").select("o_orderkey", payload.alias("payload"))
    parsed = documents.parse_json_array(landed, "payload", "Date string", ["o_orderkey"])
    parsed = parsed.withColumn("DateReal", dates.parse_timestamp(F.col("Date"), dates.API_PATTERN))
    state, target = scratch_path(spark, "mark"), scratch_path(spark, "routes")
    found = marks.routed_load(parsed, "DateReal", state, target, default=dt.datetime(1995, 6, 30), corrupt="_corrupt")
    counted = spark.createDataFrame([(r, found[r]) for r in ("accepted", "late", "undated", "corrupt")], "route string, counted bigint")
    return marks.routed(spark, state, target).join(counted, "route").select("o_orderkey", "route", "counted")


@query("json_element_rejects", """
    SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN '3' WHEN 2 THEN 'null' WHEN 3 THEN '{"Country":"A"}'
           WHEN 4 THEN '[{"Country":"A"}] more' WHEN 5 THEN '[{"Country":"A"},{"Cou' END AS rejected,
           CASE WHEN o_orderkey % 8 = 6 THEN 'A' END AS country FROM orders WHERE o_orderkey % 8 <> 0""")
def json_element_rejects(spark, folder):
    # Every element is a record or a reject, in one parse: [{..}], [3], [null], a lone object, text after the array, a cut one.
    key = F.col("o_orderkey") % 8
    payload = F.when(key == 0, F.lit(" ")).when(key == 1, F.lit('[3]')).when(key == 2, F.lit("[null]")).when(
        key == 3, F.lit('{"Country":"A"}')).when(key == 4, F.lit('[{"Country":"A"}] more')).when(
        key == 5, F.lit('[{"Country":"A"},{"Cou')).when(key == 6, F.lit('[{"Country":"A"}]')).otherwise(F.lit('[{"Other":1}]'))
    rows = table(spark, folder, "orders").select("o_orderkey", payload.alias("payload"))
    parsed = documents.parse_json_array(rows, "payload", "Country string", ["o_orderkey"])
    return parsed.select("o_orderkey", F.col("_corrupt").alias("rejected"), F.col("Country").alias("country"))


# --- whole loads ------------------------------------------------------------------------------


def _landed_files(rows, path):
    """One file per country, a JSON array of its records."""
    inner = rows.select("Country", F.substring(F.col("payload"), 2, 1 << 30).alias("p"))
    inner = inner.select("Country", F.expr("left(p, length(p) - 1)").alias("p"))
    files = inner.groupBy("Country").agg(F.concat(F.lit("["), F.array_join(F.collect_list("p"), ","), F.lit("]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("json_array_file_scan", _BOTH_SHAPES)
def json_array_file_scan(spark, folder):
    path = scratch_path(spark, "landed")
    _landed_files(raw_payloads(spark, folder).withColumn("Country", F.get_json_object("payload", "$[0].Country")), path)
    return documents.read_json_array_files(spark, path)


@query("payload_rejects", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '[{"Country": "A", "Confirmed":' ELSE 'no json' END AS _corrupt
    FROM orders WHERE o_orderkey % 4 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)""")
def payload_rejects(spark, folder):
    # Cut-off arrays and plain text among good, empty and absent payloads.
    key = F.col("o_orderkey")
    payload = (
        F.when(key % 4 == 0, F.when(key % 8 == 0, F.lit("")))
        .when(key % 3 == 0, F.lit('[{"Country": "A", "Confirmed":'))
        .when(key % 5 == 0, F.lit("no json"))
        .otherwise(F.lit('[{"Country": "A", "Confirmed": 1}]'))
    )
    rows = table(spark, folder, "orders").select("o_orderkey", payload.alias("payload"))
    return documents.json_array_rejects(rows, "payload", ["o_orderkey"])


@query("ingest_twice", with_views("panel", """
    WITH ids AS (SELECT md5("Country" || '/' || "Province") || '_' || strftime("Date", '%Y-%m-%dT00-00-00Z') AS _id, *
                 FROM panel), shapes AS (SELECT *, CAST(NULL AS VARCHAR) AS p FROM ids UNION ALL SELECT *, "Province" FROM ids)
    SELECT '{"index":{"_index":"panel", "_type":"_doc", "_id": "' || _id || '"}}' AS action, "Country", p AS "Province",
           CAST("Confirmed" AS VARCHAR) AS "Confirmed", strftime("Date", '%d-%m-%Y 00:00:00') AS "Date",
           CASE WHEN "Date" <= DATE '1998-01-01' THEN 1 ELSE 2 END AS load FROM shapes"""))
def ingest_twice(spark, folder):
    # Two loads with a mark between and a third with nothing fresh: the files of both stay.
    landed, state, bulk = (scratch_path(spark, n) for n in ("landed", "mark", "bulk"))
    rows = raw_payloads(spark, folder).withColumns({
        "Country": F.get_json_object("payload", "$[0].Country"), "Date": F.get_json_object("payload", "$[0].Date")})
    rows = materialise(rows, "payloads")
    _landed_files(rows.where("Date < '1998-01-02'"), f"{landed}/1")
    _landed_files(rows, f"{landed}/2")
    for part in ("1", "2", "2"):
        pipelines.ingest(spark, f"{landed}/{part}", state, bulk, "panel", default=dt.datetime(1990, 1, 1))
    records = read_bulk(spark, bulk).where("lines = 2")
    field = {n: F.get_json_object("doc", f"$.{n}").alias(n) for n in ("Country", "Province", "Confirmed", "Date")}
    first = F.col("load") == marks.load_name(1)
    return records.select("action", *field.values(), F.when(first, 1).otherwise(2).alias("load"))


@query("incremental_counts", """
    SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 00:00:00') AS accepted,
           count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') AS rejected, max(ts) AS new_mark FROM events""")
def incremental_counts(spark, folder):
    return marks.load_counts(table(spark, folder, "events"), "ts", LOAD_MARK)


@query("high_water_mark", "SELECT max(ts) AS mark, TIMESTAMP '2019-01-01 00:00:00' AS default_mark FROM events")
def high_water_mark(spark, folder):
    state = scratch_path(spark, "mark")
    before = marks.read_mark(spark, state)
    counts = marks.load_counts(table(spark, folder, "events"), "ts", before).first()
    marks.write_mark(spark, state, counts["new_mark"])
    stored = spark.read.parquet(state)
    return stored.select("mark", F.lit(before).cast("timestamp_ntz").alias("default_mark"))


@query("upsert_latest", """
    WITH both_sides AS (
        SELECT user_id, event_type, event_id, value, ts FROM events WHERE event_type <> 'error'
        UNION ALL SELECT user_id, event_type, event_id, value + 1, ts FROM events WHERE event_type <> 'click')
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, value DESC) AS r
        FROM both_sides) WHERE r = 1""")
def upsert_latest(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value", "ts")
    old = rows.where("event_type <> 'error'")
    new = rows.where("event_type <> 'click'").withColumn("value", F.col("value") + 1)
    return sinks.upsert_latest(old, new, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("ingest_pipeline", with_views("panel", """
    SELECT md5("Country" || '/' || "Province") || '_' || strftime("Date", '%Y-%m-%dT00-00-00Z') AS _id,
           "Country", "Province", strftime("Date", '%d-%m-%Y 00:00:00') AS "Date",
           CAST("Confirmed" AS INTEGER) AS "Confirmed"
    FROM panel WHERE "Date" > DATE '1998-01-01'"""))
def ingest_pipeline(spark, folder):
    # Payload -> records -> id, dates and mark -> one row per id (the province shape is the later version).
    records = documents.explode_json_array(raw_payloads(spark, folder), "payload", API_RECORD)
    mapped = records.select(
        columns.record_id(F.col("LocationID"), F.col("Date")).alias("_id"),
        "Country", "Province", "Confirmed",
        dates.parse_timestamp(F.col("Date"), dates.API_PATTERN).alias("DateReal"),
    )
    fresh = marks.newer_than(mapped, "DateReal", dt.datetime(1998, 1, 1))
    versioned = fresh.withColumn("_version", F.col("Province").isNotNull().cast("int"))
    latest = columns.latest_per_key(versioned, ["_id"], ["_version"])
    return latest.select("_id", "Country", "Province",
                         dates.format_document_date(F.col("DateReal")).alias("Date"), "Confirmed")
