"""Queries of features, regressors, grid search and per-key models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators import features, joins, lags, models, trees
from dayloom.plans.catalogue import query
from dayloom.plans.views import country_panel, events_daily, places, table, with_views
from dayloom.session import materialise, scratch_path

HORIZON = 7
# Two points of the fixed forest grid; the whole grid is models.FOREST_GRID.
CV_GRID = {"maxBins": models.FOREST_GRID["maxBins"][:2], "maxDepth": models.FOREST_GRID["maxDepth"][:1]}
_KEY = ["Country"]


def training_rows(spark, folder):
    """Country panel with its index, seven zero-filled lags, feature vector and label."""
    dictionary = joins.fit_dictionary(places(spark, folder), "Country", "CountryIndex")
    encoded = joins.encode(country_panel(spark, folder), dictionary, _KEY)
    lagged = lags.lag_features(encoded, _KEY, "Confirmed", HORIZON, fill=0)
    rows = features.assemble_lags(lagged, ["CountryIndex"], "Confirmed", HORIZON)
    return rows.withColumn("label", F.col("Confirmed").cast("double"))


def stored_training_rows(spark, folder):
    """Training reads its input once per tree level, so it reads a stored table."""
    rows = training_rows(spark, folder).select("Country", "CountryIndex", "Date", "features", "label")
    split = features.hash_split(rows, ["Country", "Date"])
    return materialise(split, "training")


def _vector_text(vector):
    return F.concat_ws(",", F.transform(vector_to_array(vector), lambda x: x.cast("bigint").cast("string")))


_LAG_LIST = " || ',' || ".join(
    f"""coalesce(max("Confirmed") OVER (PARTITION BY "Country" ORDER BY "Date"
        RANGE BETWEEN INTERVAL {h} DAYS PRECEDING AND INTERVAL {h} DAYS PRECEDING), 0)"""
    for h in range(1, HORIZON + 1)
)


@query("assemble_features", with_views("country_panel", f"""
    WITH idx AS (SELECT n_name AS "Country", row_number() OVER (ORDER BY count(*) DESC, n_name) - 1 AS i
                 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
    SELECT "Country", "Date", i || ',' || {_LAG_LIST} AS features, CAST("Confirmed" AS DOUBLE) AS label
    FROM country_panel JOIN idx USING ("Country")"""))
def assemble_features(spark, folder):
    return training_rows(spark, folder).select("Country", "Date", _vector_text("features").alias("features"), "label")


@query("hash_split", """
    SELECT o_orderkey, CAST('0x' || substr(md5(o_orderkey || '|1234'), 1, 8) AS BIGINT) % 1000 < 900 AS is_train
    FROM orders""")
def hash_split(spark, folder):
    return features.hash_split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])


@query("gbt_forecast")
def gbt_forecast(spark, folder):
    rows = stored_training_rows(spark, folder)
    fitted = models.gbt(maxIter=20, maxDepth=10, maxBins=190).fit(rows.where("is_train"))
    return fitted.transform(rows).select("Country", "Date", "label", "is_train", "prediction")


@query("rf_forecast")
def rf_forecast(spark, folder):
    rows = stored_training_rows(spark, folder)
    fitted = models.forest(numTrees=20, maxDepth=10, maxBins=250).fit(rows.where("is_train"))
    return fitted.transform(rows).select("Country", "Date", "label", "is_train", "prediction")


@query("glm_fit", with_views("events_daily", """
    SELECT round(regr_slope(n, dayofyear("Date")), 4) AS slope,
           round(regr_intercept(n, dayofyear("Date")), 4) AS intercept FROM events_daily"""))
def glm_fit(spark, folder):
    daily = events_daily(spark, folder).select(
        F.dayofyear("Date").cast("double").alias("day"), F.col("n").cast("double").alias("label")
    )
    fitted = models.glm(family="gaussian").fit(materialise(features.assemble(daily, ["day"]), "glm"))
    return spark.createDataFrame(
        [(round(float(fitted.coefficients[0]), 4), round(float(fitted.intercept), 4))], "slope double, intercept double"
    )


@query("glm_families")
def glm_families(spark, folder):
    rows = stored_training_rows(spark, folder)
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    results = []
    for family in models.GLM_GRID["family"]:
        # The tweedie family takes its identity link as a power.
        link = {"linkPower": 1.0, "variancePower": 0.0} if family == "tweedie" else {"link": "identity"}
        fitted = models.glm(**{"link": None, **link}, family=family, regParam=0.3, maxIter=20).fit(train)
        results.append(models.rmse_by_key(fitted.transform(test)).withColumn("family", F.lit(family)))
    return reduce(DataFrame.unionByName, results)


@query("glm_families_contract", with_views("country_panel", """
    SELECT family, (SELECT count(*) FROM country_panel WHERE NOT (CAST('0x' || substr(md5("Country" || '|' ||
        CAST("Date" AS VARCHAR) || '|1234'), 1, 8) AS BIGINT) % 1000 < 900)) AS n, true AS below_naive
    FROM (VALUES ('gaussian'), ('tweedie'), ('poisson')) AS t(family)"""))
def glm_families_contract(spark, folder):
    naive = _naive_rmse(stored_training_rows(spark, folder)).select("naive_rmse").scalar()
    return glm_families(spark, folder).select("family", "n", (F.col("rmse") < naive).alias("below_naive"))


@query("cv_grid_metrics")
def cv_grid_metrics(spark, folder):
    rows = features.time_folds(stored_training_rows(spark, folder), 3)
    fitted = models.cross_validate(rows.where("is_train"), models.forest(numTrees=20), CV_GRID, fold_col="fold")
    return models.grid_metrics(spark, fitted)


@query("holdout_metrics")
def holdout_metrics(spark, folder):
    rows = stored_training_rows(spark, folder)
    fitted = models.cross_validate(rows.where("is_train"), models.forest(numTrees=20), {"maxDepth": [10], "maxBins": [250]},
                                   folds=3)
    return models.holdout_metrics(fitted, rows.where("NOT is_train"))


def _naive_rmse(rows):
    """Held-out error of taking yesterday's value, from the training rows (one row: n, naive_rmse)."""
    yesterday = F.get(vector_to_array("features"), F.lit(1))
    return rows.where("NOT is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((yesterday - F.col("label")) ** 2)).alias("naive_rmse"))


def _quality(scored):
    """Rows, label total, the naive held-out error, and whether the model's is smaller and its predictions vary."""
    test = scored.where("NOT is_train")
    model = test.agg(
        F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"), F.stddev_pop("prediction").alias("spread"))
    naive = _naive_rmse(scored)
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"), F.count_if(F.col("prediction").isNull()).alias("unscored")
    ).withColumns({
        "naive_rmse": F.round(naive.select("naive_rmse").scalar(), 6),
        "better_than_naive": model.select("rmse").scalar() < naive.select("naive_rmse").scalar(),
        "varies": model.select("spread").scalar() > 0,
    })


_QUALITY = with_views("country_panel", """
    WITH lagged AS (SELECT *, coalesce(max("Confirmed") OVER (PARTITION BY "Country" ORDER BY "Date"
        RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS yesterday,
        CAST('0x' || substr(md5("Country" || '|' || CAST("Date" AS VARCHAR) || '|1234'), 1, 8) AS BIGINT) % 1000 < 900 AS is_train
        FROM country_panel)
    SELECT count(*) AS n, CAST(sum("Confirmed") AS DOUBLE) AS label_sum, CAST(0 AS BIGINT) AS unscored,
           round(sqrt(avg((yesterday - "Confirmed") ** 2) FILTER (WHERE NOT is_train)), 6) AS naive_rmse,
           true AS better_than_naive, true AS varies FROM lagged""")


@query("gbt_quality", _QUALITY)
def gbt_quality(spark, folder):
    rows = stored_training_rows(spark, folder)
    return _quality(models.gbt(maxIter=20, maxDepth=10, maxBins=190, stepSize=0.05).fit(rows.where("is_train")).transform(rows))


@query("rf_quality", _QUALITY)
def rf_quality(spark, folder):
    rows = stored_training_rows(spark, folder)
    return _quality(models.forest(numTrees=20, maxDepth=10, maxBins=250).fit(rows.where("is_train")).transform(rows))


@query("cv_grid_points", """
    SELECT * FROM (VALUES (0, 'maxBins=250, maxDepth=10', true), (1, 'maxBins=300, maxDepth=10', true))
        AS t(point, params, scored)""")
def cv_grid_points(spark, folder):
    return cv_grid_metrics(spark, folder).select("point", "params", (F.col("rmse") > 0).alias("scored"))


def _glm_grid(spark, folder):
    """Stored training rows with folds, and every gaussian point of the fixed grid."""
    rows = materialise(features.time_folds(stored_training_rows(spark, folder), 3), "glm_grid")
    train = rows.where("is_train")
    grid = models.ridge_grid(train, HORIZON + 1, models.GLM_GRID["regParam"], models.GLM_GRID["fitIntercept"])
    return rows, materialise(grid, "glm_points")


_HELD = """CAST('0x' || substr(md5("Country" || '|' || CAST("Date" AS VARCHAR) || '|1234'), 1, 8) AS BIGINT) % 1000 >= 900"""
_POINTS = ", ".join(f"({reg}, {str(intercept).lower()})"
                    for reg in models.GLM_GRID["regParam"] for intercept in models.GLM_GRID["fitIntercept"])


@query("glm_grid_closed", with_views("country_panel", f"""
    WITH span AS (SELECT min("Date") AS a, date_diff('day', min("Date"), max("Date")) + 1 AS days FROM country_panel),
    folds AS (SELECT CAST(floor(date_diff('day', a, "Date") * 3 / days) AS INTEGER) AS fold, count(*) AS n
              FROM country_panel, span WHERE NOT ({_HELD}) GROUP BY 1)
    SELECT CAST(p.reg AS DOUBLE) AS reg_param, p.fit AS fit_intercept, f.fold,
           CAST((SELECT sum(n) FROM folds) - f.n AS BIGINT) AS n_train, f.n AS n_test,
           true AS residuals_met, true AS rmse_met
    FROM folds AS f, (VALUES {_POINTS}) AS p(reg, fit)"""))
def glm_grid_closed(spark, folder):
    """Every point and fold, held against the rows: the residual equations of the fit and the error on the fold."""
    rows, grid = _glm_grid(spark, folder)
    size = HORIZON + 1
    points = grid.where("fold IS NOT NULL").withColumnRenamed("fold", "held")
    # A row meets every point of the grid, whose number is fixed; sums are partial before the shuffle.
    every = points.agg(F.collect_list(F.struct("point", "held", "weights", "intercept")).alias("p")).select("p").scalar()
    met = rows.where("is_train").select("features", "label", "fold", F.explode(every).alias("p")).select("*", "p.*")
    error = F.col("label") - models.score_linear(F.col("weights"), F.col("intercept"))
    x = [F.get(vector_to_array("features"), F.lit(i)) for i in range(size)]
    trained, tested = F.col("fold") != F.col("held"), F.col("fold") == F.col("held")

    def mean(value):
        return F.avg(F.when(trained, value))

    spread = F.stddev_pop(F.when(trained, F.col("label")))
    sums = met.withColumn("error", error).groupBy("point", "held").agg(
        *[mean(v * F.col("error")).alias(f"g{i}") for i, v in enumerate(x)],
        *[F.var_pop(F.when(trained, v)).alias(f"v{i}") for i, v in enumerate(x)],
        *[mean(F.abs(v * F.col("label"))).alias(f"s{i}") for i, v in enumerate(x)],
        mean(F.col("error")).alias("bias"), spread.alias("spread"),
        F.sqrt(F.avg(F.when(tested, F.col("error") * F.col("error")))).alias("again"))
    both = points.join(sums, ["point", "held"])
    off = [F.abs(F.col(f"g{i}") - F.col("reg_param") / F.col("spread") * F.get("weights", F.lit(i)) * F.col(f"v{i}"))
           <= 1e-8 * (F.col(f"s{i}") + 1) for i in range(size)]
    centred = ~F.col("fit_intercept") | (F.abs("bias") <= 1e-8 * (F.col("spread") + 1))
    return both.select(
        "reg_param", "fit_intercept", F.col("held").alias("fold"), "n_train", "n_test",
        reduce(lambda a, b: a & b, off, centred).alias("residuals_met"),
        (F.abs(F.col("again") - F.col("rmse")) <= 1e-6 * F.col("rmse")).alias("rmse_met"))


@query("glm_grid_best", with_views("country_panel", f"""
    WITH lagged AS (SELECT *, coalesce(max("Confirmed") OVER (PARTITION BY "Country" ORDER BY "Date"
        RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS yesterday FROM country_panel)
    SELECT count(*) AS n, round(sqrt(avg((yesterday - "Confirmed") ** 2)), 6) AS naive_rmse, true AS least, true AS better_than_naive
    FROM lagged WHERE {_HELD}"""))
def glm_grid_best(spark, folder):
    """Held-out error of the point that the search chose, beside taking yesterday's value."""
    rows, grid = _glm_grid(spark, folder)
    best = models.best_point(grid).first()  # one row: the model
    least = grid.where("fold IS NOT NULL").groupBy("point").agg(F.avg("rmse").alias("m")).agg(F.min("m").alias("m"))
    held = rows.where("NOT is_train")
    scored = held.withColumn("prediction", models.score_linear(F.lit(best["weights"]), F.lit(best["intercept"])))
    naive = _naive_rmse(rows)
    return models.rmse_by_key(scored).select(
        "n", F.round(naive.select("naive_rmse").scalar(), 6).alias("naive_rmse"),
        (F.lit(best["mean_rmse"]) == least.select("m").scalar()).alias("least"),
        (F.col("rmse") < naive.select("naive_rmse").scalar()).alias("better_than_naive"))


@query("model_roundtrip", with_views("country_panel", """
    SELECT "Country", count(*) AS n, true AS same FROM country_panel GROUP BY "Country" """))
def model_roundtrip(spark, folder):
    rows = stored_training_rows(spark, folder)
    path = scratch_path(spark, "model")
    fitted = models.gbt(maxIter=5, maxDepth=10, maxBins=190).fit(rows)
    loaded = models.fit_if_absent(spark, path, GBTRegressionModel, lambda: fitted)
    again = fitted.transform(rows).withColumnRenamed("prediction", "before").drop("features")
    both = joins.null_safe_join(again, loaded.transform(rows).select("Country", "Date", "prediction"), ["Country", "Date"])
    return both.groupBy("Country").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("before") == F.col("prediction")).alias("same")
    )


@query("rmse_by_key", with_views("country_panel", """
    WITH scored AS (SELECT "Country", "Confirmed" AS label, coalesce(max("Confirmed") OVER (PARTITION BY "Country"
        ORDER BY "Date" RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS prediction
        FROM country_panel)
    SELECT "Country", count(*) AS n, round(sqrt(avg((prediction - label) * (prediction - label))), 6) AS rmse
    FROM scored GROUP BY "Country" """))
def rmse_by_key(spark, folder):
    # Scored by yesterday's value.
    lagged = lags.lag_features(country_panel(spark, folder), _KEY, "Confirmed", 1, fill=0)
    scored = lagged.select("Country", F.col("Confirmed").alias("label"), F.col("Confirmed_1").alias("prediction"))
    return models.rmse_by_key(scored, _KEY).withColumn("rmse", F.round("rmse", 6))


@query("per_key_trend", with_views("country_panel", """
    SELECT "Country", round(regr_slope("Confirmed", date_diff('day', DATE '1970-01-01', "Date")), 10) AS slope,
           round(regr_intercept("Confirmed", date_diff('day', DATE '1970-01-01', "Date")), 4) AS intercept,
           count(*) AS n, min("Date") AS first_day, max("Date") AS last_day
    FROM country_panel GROUP BY "Country" """))
def per_key_trend(spark, folder):
    fits = models.trend_per_key(country_panel(spark, folder), _KEY, "Confirmed")
    return fits.drop("sd").withColumns({"slope": F.round("slope", 10), "intercept": F.round("intercept", 4)})


@query("per_key_one_lag", with_views("events_daily", """
    WITH lagged AS (SELECT event_type, CAST(n AS DOUBLE) AS y, CAST(coalesce(max(n) OVER
        (PARTITION BY event_type ORDER BY "Date" RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
        0) AS DOUBLE) AS x FROM events_daily)
    SELECT event_type, round(regr_slope(y, x), 6) AS weight, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n
    FROM lagged GROUP BY event_type"""))
def per_key_one_lag(spark, folder):
    lagged = lags.lag_features(events_daily(spark, folder), ["event_type"], "n", 1, fill=0)
    fits = models.ridge_per_key(lagged, ["event_type"], "n", 1, penalty=0.0)
    weight = F.round(F.get("weights", F.lit(0)), 6).alias("weight")
    return fits.select("event_type", weight, F.round("intercept", 6).alias("intercept"), "n")


_LAGS = ", ".join(
    f"""CAST(coalesce(max("Confirmed") OVER (PARTITION BY "Country" ORDER BY "Date"
        RANGE BETWEEN INTERVAL {h} DAYS PRECEDING AND INTERVAL {h} DAYS PRECEDING), 0) AS DOUBLE)"""
    for h in range(1, HORIZON + 1))
STUMP_BINS = 16


def _lag_arrays(spark, folder):
    lagged = lags.lag_features(country_panel(spark, folder), _KEY, "Confirmed", HORIZON, fill=0)
    past = F.array(*[F.col(c).cast("double") for c in lags.lag_names("Confirmed", HORIZON)])
    rows = lagged.select("Country", "Date", past.alias("features"), F.col("Confirmed").cast("double").alias("label"))
    return materialise(features.hash_split(rows, ["Country", "Date"]), "lag-arrays")


@query("per_key_stump", with_views("country_panel", f"""
    WITH rows AS (SELECT "Country", CAST("Confirmed" AS DOUBLE) AS y, [{_LAGS}] AS x FROM country_panel),
    long AS (SELECT "Country", y, f, x[f + 1] AS v FROM rows, range({HORIZON}) AS t(f)),
    span AS (SELECT "Country", f, min(v) AS lo, max(v) AS hi, count(*) AS nt, sum(y) AS st FROM long GROUP BY ALL),
    cuts AS (SELECT *, lo + b * (hi - lo) / {STUMP_BINS} AS cut FROM span, range(1, {STUMP_BINS}) AS t(b)),
    sides AS (SELECT "Country", f, cut, nt, st, count(*) AS nl, sum(y) AS sl
              FROM cuts JOIN long USING ("Country", f) WHERE v <= cut GROUP BY ALL),
    gains AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain FROM sides WHERE nl < nt),
    best AS (SELECT * FROM gains WHERE gain > st * st / nt
             QUALIFY row_number() OVER (PARTITION BY "Country" ORDER BY gain DESC, f, cut) = 1)
    SELECT s."Country", s.nt AS n, CAST(b.f AS INTEGER) AS feature, round(b.cut, 9) AS cut, round(s.st / s.nt, 9) AS mean,
           round(b.sl / b.nl, 9) AS left_mean, round((b.st - b.sl) / (b.nt - b.nl), 9) AS right_mean
    FROM span AS s LEFT JOIN best AS b USING ("Country") WHERE s.f = 0"""))
def per_key_stump(spark, folder):
    fits = trees.boost_per_key(_lag_arrays(spark, folder), _KEY, trees=1, depth=1, bins=STUMP_BINS, cuts="width")
    nodes = F.get("trees", F.lit(0))["n"]
    root = F.get(nodes, F.lit(0))
    value = [F.round(F.get(nodes, F.lit(i))["v"], 9) for i in range(3)]
    return fits.select(
        "Country", "n", F.when(root["l"] > 0, root["f"]).alias("feature"), F.round(F.get(root["c"], F.lit(0)), 9).alias("cut"),
        value[0].alias("mean"), value[1].alias("left_mean"), value[2].alias("right_mean"))


@query("per_key_trees", with_views("country_panel", f"""
    WITH lagged AS (SELECT *, coalesce(max("Confirmed") OVER (PARTITION BY "Country" ORDER BY "Date"
        RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS yesterday FROM country_panel)
    SELECT "Country", count(*) AS n, count(*) FILTER (WHERE {_HELD}) AS n_held, round(sqrt(avg((yesterday - "Confirmed") ** 2)), 6) AS naive_rmse,
           true AS better_than_naive, true AS better_than_one_tree
    FROM lagged GROUP BY "Country" """))
def per_key_trees(spark, folder):
    """Boosted trees of every country, trained on its training days; errors over all its days."""
    rows, depth = _lag_arrays(spark, folder), 2
    fits = trees.boost_per_key(rows.where("is_train"), _KEY, trees=5, depth=depth, step=0.3).select("Country", "trees")
    scored = joins.null_safe_join(rows, materialise(fits, "fits"), _KEY)
    ensembles = {"prediction": F.col("trees"), "first": F.slice("trees", 1, 1)}
    scored = scored.withColumns({n: trees.score_trees(t, F.col("features"), depth) for n, t in ensembles.items()})

    def rmse(prediction):
        return F.sqrt(F.avg((prediction - F.col("label")) ** 2))

    errors = scored.groupBy("Country").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_train")).alias("n_held"),
        rmse(F.get("features", F.lit(0))).alias("naive"), rmse(F.col("prediction")).alias("rmse"), rmse(F.col("first")).alias("one"))
    return errors.select("Country", "n", "n_held", F.round("naive", 6).alias("naive_rmse"),
                         (F.col("rmse") < F.col("naive")).alias("better_than_naive"),
                         (F.col("rmse") <= F.col("one")).alias("better_than_one_tree"))


@query("compiled_trees", with_views("country_panel", """
    SELECT model, "Country", count(*) AS n, true AS same FROM country_panel, (VALUES ('boosted'), ('forest')) AS t(model)
    GROUP BY ALL"""))
def compiled_trees(spark, folder):
    """Scores of the ensembles as one expression, held against the models' own on every row."""
    rows = stored_training_rows(spark, folder)
    results = []
    for name, estimator in (("boosted", models.gbt(maxIter=5, maxDepth=6, maxBins=190)),
                            ("forest", models.forest(numTrees=10, maxDepth=8, maxBins=250))):
        fitted = estimator.fit(rows.where("is_train"))
        again = trees.compile_trees(fitted).score(vector_to_array("features"))
        same = F.abs(again - F.col("prediction")) <= 1e-9 * (1 + F.abs("prediction"))
        results.append(fitted.transform(rows).groupBy("Country").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.coalesce(same, F.lit(False))).alias("same")).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, results)


@query("per_key_models")
def per_key_models(spark, folder):
    lagged = lags.lag_features(country_panel(spark, folder), _KEY, "Confirmed", 15, fill=0)
    fits = models.ridge_per_key(lagged, _KEY, "Confirmed", 15)
    return fits.select("Country", F.posexplode("weights").alias("lag", "weight"), "intercept", "n")
