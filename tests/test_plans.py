"""The shape of physical plans: shuffles, joins, what reaches the scan."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dayloom.operators import forecast, lags, panel
from dayloom.plans.catalogue import load_all
from dayloom.plans.views import country_counts
from dayloom.sources import marks

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node: str) -> int:
    return len(re.findall(rf"[-+:] {node}\b", plan(df)))


@pytest.fixture
def stored(spark, tmp_path):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(i), i, "x") for i in range(9)]
    spark.createDataFrame(rows, "k string, Date date, n bigint, unused string").write.parquet(f"{tmp_path}/panel")
    return spark.read.parquet(f"{tmp_path}/panel")


def test_windows_share_one_shuffle_and_one_sort(stored):
    daily = panel.decumulate(panel.cumulate(stored.select("k", "Date", "n"), ["k"], ["n"]), ["k"], ["n"], fill=0)
    df = panel.cumulate(lags.lag_features(daily, ["k"], "n", 20), ["k"], ["n_1"])
    assert count(df, "Exchange") == 1 and count(df, "Sort") == 1
    assert "unused" not in plan(df)


def test_recursion_shuffles_only_to_build_the_state(stored):
    df = forecast.recursive_forecast(stored, ["k"], "n", 7, 30, as_of=dt.date(2020, 1, 9))
    assert count(df, "Exchange") == 1
    assert len(plan(df)) < 2.0 * len(plan(forecast.recursive_forecast(stored, ["k"], "n", 7, 1, as_of=dt.date(2020, 1, 9))))
    assert "GreaterThan(Date" in plan(df)


def test_mark_reaches_the_scan(spark):
    df = marks.newer_than(spark.read.parquet(f"{FOLDER}/events.parquet"), "ts", dt.datetime(2024, 1, 15)).select("event_id", "ts")
    assert "GreaterThan(ts,2024-01-15" in plan(df)
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>", plan(df))


def test_sums_are_partial_before_the_shuffle(spark):
    text = plan(load_all()["panel_sum"].run(spark, FOLDER))
    assert text.count("partial_count") >= 3


NO_TRAINING = [n for n in load_all() if not re.search(r"gbt|rf_|cv_|holdout|glm|model|shifted_.*scored|scored", n)]


def test_no_cross_join_in_any_plan(spark):
    for name in NO_TRAINING:
        if name.startswith(("stream_", "sink_", "scan_")):
            continue
        text = plan(load_all()[name].run(spark, FOLDER))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_sources_avoid_unsafe_calls():
    code = "\n".join(p.read_text() for p in (ROOT / "dayloom").rglob("*.py") if "llm" not in p.parts)
    for banned in ("localCheckpoint", "crossJoin", ".toPandas(", ".rdd", "coalesce(1).write.parquet"):
        assert banned not in code
    assert "F.broadcast(" not in code


def scans(df) -> list[str]:
    """Tables that the executed plan reads, one entry per scan that is run."""
    df.write.format("noop").mode("overwrite").save()
    return re.findall(r"(?m)^.*FileScan parquet .*?Location: [^\[]*\[([^\]]*)\]", plan(df))


@pytest.mark.parametrize("name", ["forecast_metric", "submission_join", "backfill_missing", "recursive_forecast"])
def test_forecasts_read_their_stored_days_not_the_events(spark, name):
    found = scans(load_all()[name].run(spark, FOLDER))
    assert found and not any("events.parquet" in f for f in found)


def test_panel_shuffles_three_times_at_most(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert count(load_all()["panel_sum"].run(spark, FOLDER), "Exchange") <= 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert count(load_all()["panel_sum"].run(spark, FOLDER), "Exchange") == 1


def test_labels_are_counted_before_the_join(spark):
    text = plan(country_counts(spark, FOLDER))
    assert text.rindex("partial_count(1)") > text.index("Join")
