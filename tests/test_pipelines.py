"""The end-to-end jobs on small tables of the documented shapes."""

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from dayloom import schemas
from dayloom.operators import features, forecast, joins, lags, models
from dayloom.plans import pipelines
from dayloom.session import scratch_root
from dayloom.sources import marks

START = dt.date(2020, 3, 1)


def on(offset):
    return START + dt.timedelta(offset)


def test_ingest_writes_new_records_and_moves_the_mark(spark, tmp_path):
    def record(d, **more):
        return {"Country": "A", "CountryCode": "AA", "Lat": "1.5", "Lon": "2.5", "Confirmed": d, "Deaths": 0,
                "Recovered": 0, "Active": d, "Date": f"2020-01-{d:02d}T00:00:00Z", "LocationID": "loc", **more}

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps([record(1), record(2), record(3, Province="P")]))
    mark = f"{tmp_path}/mark"
    marks.write_mark(spark, mark, dt.datetime(2020, 1, 1))
    counts = pipelines.ingest(spark, f"{tmp_path}/in", mark, f"{tmp_path}/bulk", "raw")
    assert counts["accepted"] == 2 and marks.read_mark(spark, mark) == dt.datetime(2020, 1, 3)
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/bulk").collect())
    documents = [json.loads(x) for x in lines if not x.startswith('{"index"')]
    ids = {json.loads(x)["index"]["_id"] for x in lines if x.startswith('{"index"')}
    assert ids == {"loc_2020-01-02T00-00-00Z", "loc_2020-01-03T00-00-00Z"}
    assert {d["Date"] for d in documents} == {"02-01-2020 00:00:00", "03-01-2020 00:00:00"}
    assert documents[0]["Location"] == "1.5,2.5"
    # A later load adds its own folder; one with nothing fresh adds none; broken files are counted.
    (tmp_path / "in" / "2.json").write_text(json.dumps([record(4)]))
    (tmp_path / "in" / "3.json").write_text('[{"Country": "A", "Da')
    counts = pipelines.ingest(spark, f"{tmp_path}/in", mark, f"{tmp_path}/bulk", "raw")
    assert (counts["accepted"], counts["corrupt"]) == (1, 1)
    assert pipelines.ingest(spark, f"{tmp_path}/in", mark, f"{tmp_path}/bulk", "raw")["accepted"] == 0
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/bulk").collect()]
    assert len(lines) == 6 and len(list((tmp_path / "bulk").glob("load=*"))) == 2


def test_build_panel(spark):
    rows = [("A", [], "01-03-2020 00:00:00", 5, 0, 0), ("A", None, "02-03-2020 00:00:00", 9, 1, 0),
            ("A", ["p", "q"], "02-03-2020 00:00:00", 2, 0, 0), ("A", ["p"], "02-03-2020 00:00:00", 3, 0, 0)]
    stored = spark.createDataFrame(
        rows, "Country string, Province array<string>, Date string, Confirmed int, Deaths int, Recovered int")
    got = {(r["Province"], r["Date"], r["Confirmed"]) for r in pipelines.build_panel(stored).collect()}
    assert got == {("RAS", on(0), None), ("RAS", on(1), 4), ("p", on(1), None)}


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(c, on(i), (i % 7) * w) for c, w in (("A", 3), ("B", 1)) for i in range(40)]
    return spark.createDataFrame(rows, "Country string, Date date, Confirmed bigint")


def test_train_and_predict_countries(spark, daily, tmp_path):
    dictionary = joins.fit_dictionary(daily, "Country", "CountryIndex")
    coded = joins.encode(daily, dictionary, ["Country"])
    fitted, metrics = pipelines.train_on_lags(
        coded, ["Country", "CountryIndex"], ["CountryIndex"], "Confirmed", 7, models.gbt(maxIter=3), {"maxDepth": [3]},
        f"{tmp_path}/model", folds=2,
    )
    assert metrics.first()["rmse"] < 20
    got = pipelines.predict_countries(daily, dictionary, fitted, 7, 5)
    assert got.count() == 80 + 10 and got.where(F.col("Date") > on(39)).agg(F.max("Confirmed")).first()[0] == 0
    with pytest.raises(features.FeatureSizeError):
        pipelines.predict_countries(daily, dictionary, fitted, 6, 5)


def test_predict_by_shift(spark, daily):
    index = joins.fit_dictionary(daily, "Country", "CountryIndex")
    ready = features.assemble(joins.encode(daily, index, ["Country"]).withColumn(
        "DateInt", F.dayofmonth("Date") / 1.3 + F.month("Date") * 30), ["CountryIndex", "DateInt"])
    model = models.forest(numTrees=2).fit(ready.withColumn("label", F.col("Confirmed").cast("double")))
    got = pipelines.predict_by_shift(daily, model, index, 10)
    assert got.count() == 80 + 22 and got.where("Predicted_Confirmed IS NULL").isEmpty()


def test_contest_input_and_submission(spark):
    # R ends with the training table; the newer source knows V (under another name) for 6 more days.
    training = [(i, None, c, on(d), float((d + 1) * s), float(d + 1)) for i, (c, s) in enumerate((("V", 2), ("R", 5)))
                for d in range(12)]
    newer = [("Viet Nam", "RAS", on(d), 2, 1) for d in range(10, 18)]
    request = [(100 * i + d, None, c, on(d)) for i, c in enumerate(("V", "R", "Z")) for d in range(8, 24)]
    dictionary = spark.createDataFrame([("V", 0.0, "RAS", 0.0), ("R", 1.0, "RAS", 0.0)], schemas.PAIR_DICTIONARY)
    training = spark.createDataFrame(training, schemas.TRAINING_TABLE).drop("Id")
    newer = spark.createDataFrame(
        newer, "Country_Region string, Province_State string, Date date, ConfirmedCases int, Fatalities int")
    request = spark.createDataFrame(request, schemas.REQUEST_TABLE)
    encoded = pipelines.contest_input(training, newer, request, dictionary, {"Viet Nam": "V"}, horizon=5)
    got = {(r[0], r["Date"]): (r["ConfirmedCases"], r["Fatalities"]) for r in encoded.collect()}
    assert len(got) == 2 * 18
    assert got[0.0, on(0)] == (0.0, 0.0) and got[0.0, on(17)] == (2.0, 1.0) and got[1.0, on(17)] == (5.0, 1.0)
    submitted = {r["ForecastId"]: r for r in pipelines.contest_submission(
        encoded, dictionary, request, horizon=5, periods=6, history="full").collect()}
    assert len(submitted) == 48
    assert submitted[23]["ConfirmedCases"] == 2.0 * 23 and submitted[123]["ConfirmedCases"] == 5.0 * 23
    assert submitted[223]["ConfirmedCases"] is None
    window = {r["ForecastId"]: r for r in pipelines.contest_submission(
        encoded, dictionary, request, horizon=5, periods=6).collect()}
    assert window[23]["ConfirmedCases"] == 2.0 * (7 + 6)
    # A model per target gives the same as the mean of lags when it has learnt a constant.
    fitted = {}
    for target, metric in zip(pipelines.TARGETS, ("ConfirmedCases", "Fatalities")):
        ready = features.assemble_lags(lags.lag_features(
            encoded, pipelines.CODES, metric, 5, fill=0), pipelines.CODES, metric, 5)
        fitted[target] = models.forest(numTrees=1, maxDepth=1).fit(
            ready.where("Country_RegionIndex = 0 AND Date > DATE'2020-03-08'").withColumn("label", F.col(metric)))
    by_model = {r["ForecastId"]: r for r in pipelines.contest_submission(
        encoded, dictionary, request, fitted, horizon=5, periods=6).collect()}
    assert by_model[23]["ConfirmedCases"] == 2.0 * (7 + 6) and by_model[23]["Fatalities"] == 7 + 6


def test_world_forecast_and_push(spark, tmp_path):
    rows = [(c, "X", on(i), float(i), 1.0, None) for c in "AB" for i in range(20)]
    grouped = spark.createDataFrame(rows, schemas.GROUPED_TABLE)
    table = pipelines.world_forecast(grouped, 5, forecast.trend_forecast)
    assert table.columns[:4] == ["ds", "confirmed", "deaths", "recovered"] and len(table.columns) == 13
    pipelines.push_forecast(table, f"{tmp_path}/pushed")
    pushed = spark.read.json(f"{tmp_path}/pushed")
    assert pushed.count() == 25 and pushed.where("confirmed = -1.0").count() == 5
    assert pushed.select("_id").distinct().count() == 25


@pytest.mark.parametrize("master, folder, expected", [
    ("local[2]", None, "/house/_scratch/dayloom-app"), ("local-cluster[1,1,1024]", "/shared/", "/shared/dayloom-app"),
    ("spark://host:7077", "/shared", "/shared/dayloom-app"), ("spark://host:7077", None, None)])
def test_scratch_folder_is_shared_or_refused(master, folder, expected):
    settings = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/house"}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: settings[name]),
                           sparkContext=SimpleNamespace(master=master, applicationId="app"))
    if expected is None:
        with pytest.raises(RuntimeError):
            scratch_root(fake)
    else:
        assert scratch_root(fake) == expected
