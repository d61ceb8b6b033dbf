import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from dayloom.operators import features, forecast, lags, models

START = dt.date(2020, 3, 1)


def on(offset):
    return START + dt.timedelta(offset)


@pytest.fixture(scope="module")
def series(spark):
    """Two keys to the last day (one with gaps) and one that ends early."""
    rng = np.random.default_rng(7)
    rows = [("a", on(i), int(v)) for i, v in enumerate(rng.integers(0, 50, 20))]
    rows += [("b", on(i), int(v)) for i, v in enumerate(rng.integers(0, 50, 20)) if i not in (14, 17)]
    rows += [("c", on(i), 5) for i in range(12)]
    return spark.createDataFrame(rows, "k string, Date date, n bigint"), rows


def brute(rows, horizon, periods, rounded=False, score=None):
    table = {(k, d): float(v) for k, d, v in rows}
    last = max(d for _, d, _ in rows)
    out = {}
    for k in {k for k, d, _ in rows if d == last}:
        for step in range(1, periods + 1):
            now = last + dt.timedelta(step)
            past = [table.get((k, now - dt.timedelta(h)), 0.0) for h in range(1, horizon + 1)]
            value = score(past) if score else sum(past) / horizon
            table[k, now] = float(math.floor(value + 0.5)) if rounded else value
            out[k, now] = table[k, now]
    return out


def as_dict(df, metric="n"):
    return {(r["k"], r["Date"]): r[metric] for r in df.collect()}


@pytest.mark.parametrize("rounded", [False, True])
@pytest.mark.parametrize("horizon, periods", [(5, 9), (7, 1), (3, 20)])
def test_recursion_against_brute_force(series, horizon, periods, rounded):
    df, rows = series
    got = as_dict(forecast.recursive_forecast(df, ["k"], "n", horizon, periods, round_feedback=rounded))
    want = brute(rows, horizon, periods, rounded)
    assert got.keys() == want.keys() and {k for k, _ in got} == {"a", "b"}
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_model_recursion_with_storing_equals_brute_force(spark, series):
    df, rows = series
    lagged = features.assemble_lags(lags.lag_features(df, ["k"], "n", 3, fill=0), [], "n", 3)
    fitted = LinearRegression(regParam=0.1).fit(lagged.withColumn("label", F.col("n").cast("double")))
    got = as_dict(forecast.recursive_forecast(df, ["k"], "n", 3, 7, fitted, store_every=2))
    w, b = list(fitted.coefficients), fitted.intercept
    want = brute(rows, 3, 7, score=lambda past: b + sum(x * y for x, y in zip(past, w)))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_one_step_equals_direct_scoring(series):
    df, _ = series
    rows = features.assemble_lags(lags.lag_features(df, ["k"], "n", 4, fill=0), [], "n", 4)
    fitted = models.gbt(maxIter=3, maxDepth=3).fit(rows.withColumn("label", F.col("n").cast("double")))
    ahead = as_dict(forecast.recursive_forecast(df, ["k"], "n", 4, 1, fitted))
    tomorrow = df.unionByName(
        df.where(F.col("Date") == on(19)).withColumns({"Date": F.lit(on(20)), "n": F.lit(0).cast("bigint")})
    )
    direct = features.assemble_lags(lags.lag_features(tomorrow, ["k"], "n", 4, fill=0), [], "n", 4)
    scored = as_dict(fitted.transform(direct.where(F.col("Date") == on(20))), "prediction")
    assert ahead == scored


def test_feature_size_is_checked(series):
    df, _ = series
    rows = features.assemble_lags(lags.lag_features(df, ["k"], "n", 2, fill=0), [], "n", 2)
    fitted = models.forest(numTrees=2, maxDepth=2).fit(rows.withColumn("label", F.col("n").cast("double")))
    with pytest.raises(features.FeatureSizeError):
        forecast.recursive_forecast(df, ["k"], "n", 5, 2, fitted)


def test_weights_per_key_predict_a_line(spark):
    # n = n_1 + 2 for one key, n = n_1 - 1 for the other.
    rows = [("up", on(i), 2 * i) for i in range(15)] + [("down", on(i), 50 - i) for i in range(15)]
    df = spark.createDataFrame(rows, "k string, Date date, n bigint")
    weights = models.ridge_per_key(
        lags.lag_features(df, ["k"], "n", 1).where("n_1 IS NOT NULL"), ["k"], "n", 1, penalty=0.0
    ).drop("n")
    got = as_dict(forecast.recursive_forecast(df, ["k"], "n", 1, 3, forecast.weighted_lags(), parameters=weights))
    assert [round(got["up", on(15 + i)], 6) for i in range(3)] == [30, 32, 34]
    assert [round(got["down", on(15 + i)], 6) for i in range(3)] == [35, 34, 33]


def test_weights_equal_least_squares(series):
    df, rows = series
    fits = {r["k"]: r for r in models.ridge_per_key(lags.lag_features(df, ["k"], "n", 3, fill=0), ["k"], "n", 3, 0.0).collect()}
    for k in "ab":
        table = {d: v for x, d, v in rows if x == k}
        x = [[1.0] + [table.get(d - dt.timedelta(h), 0) for h in (1, 2, 3)] for d in table]
        want = np.linalg.lstsq(np.array(x), np.array(list(table.values()), float), rcond=None)[0]
        assert np.allclose([fits[k]["intercept"], *fits[k]["weights"]], want)
        assert fits[k]["n"] == len(table)


def test_totals_from_window_and_from_all_history(series):
    df, rows = series
    ahead = brute(rows, 5, 3)
    for history, first in (("window", on(19 - 5)), ("full", on(0))):
        got = as_dict(forecast.forecast_metric(df, ["k"], "n", 5, 3, history))
        past = sum(v for k, d, v in rows if k == "b" and d >= first)
        assert abs(got["b", on(22)] - past - sum(ahead["b", on(20 + i)] for i in range(3))) < 1e-9


def test_as_of_cuts_the_history(series):
    df, rows = series
    got = as_dict(forecast.recursive_forecast(df, ["k"], "n", 4, 2, as_of=on(10)))
    want = brute([r for r in rows if r[1] <= on(10)], 4, 2)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_backfill_finds_the_absent_entity(spark, series):
    df, rows = series
    older, newer = df.where(F.col("Date") <= on(11)), df.where((F.col("Date") > on(11)) & (F.col("k") != "c"))
    got = as_dict(forecast.backfill_missing(older, newer, ["k"], ["k"], ["n"], 4))
    want = {(k, d): float(v) for k, d, v in rows}
    want.update(brute([r for r in rows if r[1] <= on(11) and r[0] == "c"], 4, 8))
    assert got == want


def test_backfill_without_a_gap_changes_nothing(series):
    df, rows = series
    got = as_dict(forecast.backfill_missing(df, df.where("k = 'a'"), ["k"], ["k"], ["n"], 4))
    assert got == {(k, d): float(v) for k, d, v in rows}


def test_additive_forecast_follows_trend_and_week(spark):
    def truth(i):
        return 100 + 3 * i + 10 * math.sin(2 * math.pi * i / 7)

    df = spark.createDataFrame([("a", on(i), truth(i)) for i in range(70)] + [("b", on(0), 4.0)],
                               "k string, Date date, n double")
    got = {r["ds"]: r for r in forecast.additive_forecast(df, ["k"], "n", 14).where("k = 'a'").collect()}
    assert len(got) == 84
    assert max(abs(got[on(i)]["yhat"] - truth(i)) for i in range(84)) < 3
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in got.values())
    assert forecast.additive_forecast(df, ["k"], "n", 2).where("k = 'b'").count() == 3


def test_forecast_table_contract(spark):
    df = spark.createDataFrame([(on(i), i, 2 * i, 3) for i in range(10)], "Date date, a bigint, b bigint, c bigint")
    for method in (forecast.trend_forecast, forecast.additive_forecast):
        table = forecast.forecast_table(df, ["a", "b", "c"], 5, forecaster=method)
        assert table.columns == ["ds", "a", "b", "c"] + [
            f"{m}_{s}" for m in "abc" for s in ("yhat", "yhat_lower", "yhat_upper")
        ]
        rows = {r["ds"]: r for r in table.collect()}
        assert len(rows) == 15 and rows[on(12)]["a"] is None
        assert abs(rows[on(12)]["b_yhat"] - 24) < 0.5


def test_dictionary_equals_the_indexer(spark):
    from dayloom.operators.joins import fit_dictionary

    df = spark.createDataFrame([(c,) for c in "bbaaccczdd"], "Country string")
    mine = {r["Country"]: r["i"] for r in fit_dictionary(df, "Country", "i").collect()}
    fitted = features.label_indexer("Country", "i").fit(df)
    assert mine == {label: i for i, label in enumerate(fitted.labels)}


def test_listed_models_are_fitted_once(spark, series, tmp_path):
    df, _ = series
    rows = features.assemble_lags(lags.lag_features(df, ["k"], "n", 2, fill=0), [], "n", 2)
    train = rows.withColumn("label", F.col("n").cast("double"))
    made = []

    def estimator():
        made.append(1)
        return models.gbt(maxIter=2)

    for _ in range(2):
        fitted = models.fit_listed_keys(train, "k", ["a", "b"], estimator, {"maxDepth": [2]}, str(tmp_path), folds=2)
    assert len(made) == 2 and set(fitted) == {"a", "b"}
    assert features.check_feature_size(fitted["a"], 2) is None


def test_splits_and_folds(series):
    df, _ = series
    split = features.hash_split(df, ["k", "Date"], 0.7)
    again = features.hash_split(df.repartition(5), ["k", "Date"], 0.7)
    assert split.exceptAll(again).isEmpty() and 0 < split.where("is_train").count() < df.count()
    folds = features.time_folds(df, 3).groupBy("fold").agg(F.min("Date").alias("a"), F.max("Date").alias("b"))
    spans = sorted((r["a"], r["b"], r["fold"]) for r in folds.collect())
    assert [s[2] for s in spans] == [0, 1, 2] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_grids_hold_distinct_points():
    assert len(models.param_grid(models.glm(), models.GLM_GRID)) == 90
    assert len(models.param_grid(models.forest(), models.FOREST_GRID)) == 12


def test_sparse_trend_finds_few_changes_and_widens(spark):
    start = dt.date(2020, 1, 1)
    rows = [(k, start + dt.timedelta(d), 5.0 + 0.1 * d + (0.9 * max(d - 160, 0) if k == "bent" else 0.0) + 3 * math.sin(2 * math.pi * d / 7))
            for k in ("bent", "straight") for d in range(400)]
    rows += [(None, start + dt.timedelta(d), 4.0) for d in range(30)] + [("one", start, 2.0), ("void", start, None)]
    frame = spark.createDataFrame(rows, "k string, Date date, v double")
    fits = {r["k"]: r for r in forecast.sparse_trend_fit(frame, ["k"], "v", weekly=1, yearly=0, knots=7, penalty=0.01).collect()}
    assert set(fits) == {"bent", "straight", None, "one"}
    changes = {k: np.array(r["weights"][2:9]) for k, r in fits.items()}
    # 160 of 399 days lie at the fourth of seven places (0.4 of the span).
    assert changes["bent"].argmax() == 3 and (changes["bent"] == 0).sum() >= 3
    assert np.abs(changes["straight"]).max() < 1e-6 and fits["straight"]["sd"] < 1e-3
    assert not changes[None].any() and abs(fits["one"]["weights"][0] - 2.0) < 2.0
    ahead = forecast.sparse_trend_forecast(frame, ["k"], "v", 60, weekly=1, yearly=0, knots=7, penalty=0.01)
    got = {(r["k"], r["ds"]): r for r in ahead.collect()}
    assert len(got) == 2 * 460 + 90 + 61
    bent = [got["bent", start + dt.timedelta(d)] for d in (399, 420, 459)]
    widths = [r["yhat_upper"] - r["yhat_lower"] for r in bent]
    assert widths[0] < widths[1] < widths[2]
    assert all(abs(got[None, start + dt.timedelta(d)]["yhat"] - 4.0) < 1e-6 for d in (0, 40, 80))
    assert abs(got["one", start]["yhat"] - 2.0) < 1e-6
    assert forecast.sparse_trend_forecast(frame.limit(0), ["k"], "v", 5).isEmpty()


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    for n in (3, 30, 200):
        x = np.column_stack([np.ones(n), *[np.maximum(np.linspace(0, 1, n) - k / 10, 0) for k in range(10)]])
        y = np.cumsum(rng.normal(size=n))
        free = np.array([True, True] + [False] * 9)
        square, right = x.T @ x / n, x.T @ y / n
        for limit in (0.0, 1e-4, 0.01, 1.0):
            w = forecast._lasso(square, right, free, limit)
            g = right - square @ w
            assert np.abs(g[free]).max() < 1e-7
            used = ~free & (w != 0)
            assert np.abs(g[used] - limit * np.sign(w[used])).max(initial=0.0) < 1e-7
            assert (np.abs(g[~free & (w == 0)]) <= limit + 1e-7).all()
