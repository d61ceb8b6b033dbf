"""Queries of the recursive, seasonal and trend forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.operators import calendar, features, forecast, joins, lags, models, panel
from dayloom.plans.catalogue import query
from dayloom.plans.model_queries import HORIZON, stored_training_rows
from dayloom.plans.views import PANEL_METRICS, country_panel, events_daily, with_views
from dayloom.plans.views import panel as panel_view
from dayloom.session import materialise

_EVENTS = ["event_type"]


def stored_days(spark, folder):
    """The daily event panel, stored: history, last day and forecast read it instead of the events."""
    return materialise(events_daily(spark, folder), "daily")


def stored_countries(spark, folder):
    return materialise(country_panel(spark, folder), "daily")



def _state_sql(metric: str, horizon: int, source: str = "events_daily", key: str = "event_type") -> str:
    days = ", ".join(
        f"""CAST(coalesce(sum("{metric}") FILTER (WHERE "Date" = last - {h}), 0) AS DOUBLE)""" for h in range(horizon)
    )
    return f"""
    seen AS (SELECT *, (SELECT max("Date") FROM {source}) AS last FROM {source}),
    start AS (SELECT "{key}", last, [{days}] AS state FROM seen GROUP BY "{key}", last
              HAVING count(*) FILTER (WHERE "Date" = last) > 0)"""


def _roll_sql(metric: str, horizon: int, periods: int, source: str = "events_daily", key: str = "event_type",
              score: str = "{mean}") -> str:
    mean = f"list_sum(state[1:{horizon}]) / {horizon}.0"
    return f"""{_state_sql(metric, horizon, source, key)},
    roll AS (SELECT "{key}", last, 0 AS step, state FROM start
             UNION ALL SELECT "{key}", last, step + 1,
                list_prepend({score.format(mean=mean)}, state)[1:{horizon}] FROM roll WHERE step < {periods})"""


@query("history_state", with_views("events_daily", f"""
    WITH {_state_sql("n", 5)}
    SELECT event_type, last AS last_day, array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN state], ',') AS state
    FROM start"""))
def history_state(spark, folder):
    state = forecast.history_state(stored_days(spark, folder), _EVENTS, "n", 5)
    listed = F.transform("state", lambda x: x.cast("bigint").cast("string"))
    return state.withColumn("state", F.concat_ws(",", listed))


@query("recursive_forecast", with_views("events_daily", f"""
    WITH RECURSIVE {_roll_sql("n", 7, 30)}
    SELECT event_type, last + step AS "Date", round(state[1], 6) AS n FROM roll WHERE step > 0"""))
def recursive_forecast(spark, folder):
    ahead = forecast.recursive_forecast(stored_days(spark, folder), _EVENTS, "n", 7, 30)
    return ahead.withColumn("n", F.round("n", 6))


@query("recursive_forecast_rounded", with_views("country_panel", f"""
    WITH RECURSIVE {_roll_sql("Confirmed", 20, 14, "country_panel", "Country",
                              "CAST(floor({mean} + 0.5) AS DOUBLE)")}
    SELECT "Country", last + step AS "Date", state[1] AS "Confirmed" FROM roll WHERE step > 0"""))
def recursive_forecast_rounded(spark, folder):
    return forecast.recursive_forecast(
        stored_countries(spark, folder), ["Country"], "Confirmed", 20, 14, round_feedback=True
    )


@query("recursive_forecast_all_keys", with_views("country_panel", f"""
    WITH RECURSIVE {_state_sql("Confirmed", 20, "country_panel", "Country").replace("HAVING", "HAVING true OR")},
    roll AS (SELECT "Country", last, 0 AS step, state FROM start
             UNION ALL SELECT "Country", last, step + 1,
                list_prepend(CAST(floor(list_sum(state[1:20]) / 20.0 + 0.5) AS DOUBLE), state)[1:20] FROM roll WHERE step < 14)
    SELECT "Country", last + step AS "Date", state[1] AS "Confirmed" FROM roll WHERE step > 0"""))
def recursive_forecast_all_keys(spark, folder):
    # Every country ever seen, not only those with rows on the last day.
    return forecast.recursive_forecast(
        stored_countries(spark, folder), ["Country"], "Confirmed", 20, 14, round_feedback=True, cover="all"
    )


@query("recursive_forecast_nullkey", with_views("country_panel", f"""
    WITH RECURSIVE keyed AS (SELECT CASE WHEN "Country" = 'NATION_0' THEN NULL ELSE "Country" END AS "Country",
                                    "Date", "Confirmed" FROM country_panel),
    {_state_sql("Confirmed", 7, "keyed", "Country").replace("HAVING", "HAVING true OR")},
    scale AS (SELECT "Country", avg("Confirmed") AS w FROM keyed GROUP BY "Country"),
    roll AS (SELECT s."Country", last, 0 AS step, state, w FROM start s JOIN scale c ON s."Country" IS NOT DISTINCT FROM c."Country"
             UNION ALL SELECT "Country", last, step + 1, list_prepend(w + state[1] * 0.5, state)[1:7], w FROM roll WHERE step < 5)
    SELECT "Country", last + step AS "Date", round(state[1], 6) AS "Confirmed" FROM roll WHERE step > 0"""))
def recursive_forecast_nullkey(spark, folder):
    # Parameters of a null key reach its state.
    days = stored_countries(spark, folder).withColumn("Country", F.nullif("Country", F.lit("NATION_0")))
    scale = days.groupBy("Country").agg(F.avg("Confirmed").alias("w"))
    ahead = forecast.recursive_forecast(
        days, ["Country"], "Confirmed", 7, 5, lambda past: F.col("w") + F.get(past, F.lit(0)) * F.lit(0.5),
        parameters=scale, cover="all")
    return ahead.withColumn("Confirmed", F.round("Confirmed", 6))


@query("recursive_forecast_per_key")
def recursive_forecast_per_key(spark, folder):
    daily = stored_days(spark, folder)
    weights = models.ridge_per_key(lags.lag_features(daily, _EVENTS, "n", 7, fill=0), _EVENTS, "n", 7, penalty=1e-3)
    return forecast.recursive_forecast(
        daily, _EVENTS, "n", 7, 30, forecast.weighted_lags(), parameters=weights.drop("n")
    )


@query("recursive_forecast_gbt")
def recursive_forecast_gbt(spark, folder):
    rows = stored_training_rows(spark, folder)
    fitted = models.gbt(maxIter=10, maxDepth=10, maxBins=190).fit(rows)
    # The states carry the country index, the first feature of the model.
    history = rows.select("Country", "CountryIndex", "Date", F.col("label").alias("Confirmed"))
    return forecast.recursive_forecast(
        history, ["Country", "CountryIndex"], "Confirmed", HORIZON, 14, fitted, codes=["CountryIndex"], store_every=7, cover="all"
    )


_WINDOW_SQL = """,
    both_parts AS (
        SELECT event_type, "Date", CAST(n AS DOUBLE) AS n, false AS is_forecast FROM seen {past}
        UNION ALL SELECT event_type, last + step, state[1], true FROM roll WHERE step > 0)
    SELECT event_type, "Date", round(sum(n) OVER (PARTITION BY event_type ORDER BY "Date"), 6) AS n, is_forecast
    FROM both_parts"""


@query("forecast_metric", with_views("events_daily", f"""
    WITH RECURSIVE {_roll_sql("n", 7, 10)}{_WINDOW_SQL.format(past='WHERE "Date" >= last - 10')}"""))
def forecast_metric(spark, folder):
    totals = forecast.forecast_metric(stored_days(spark, folder), _EVENTS, "n", 7, 10)
    return totals.withColumn("n", F.round("n", 6))


@query("forecast_metric_full", with_views("events_daily", f"""
    WITH RECURSIVE {_roll_sql("n", 7, 10)}{_WINDOW_SQL.format(past="")}"""))
def forecast_metric_full(spark, folder):
    totals = forecast.forecast_metric(stored_days(spark, folder), _EVENTS, "n", 7, 10, history="full")
    return totals.withColumn("n", F.round("n", 6))


@query("forecast_metric_opening", with_views("events_daily", f"""
    WITH RECURSIVE {_roll_sql("n", 7, 10)}{_WINDOW_SQL.format(past="")}
    QUALIFY "Date" >= (SELECT max(last) FROM start) - 10"""))
def forecast_metric_opening(spark, folder):
    totals = forecast.forecast_metric(stored_days(spark, folder), _EVENTS, "n", 7, 10, history="opening")
    return totals.withColumn("n", F.round("n", 6))


@query("submission_join", with_views("events_daily", f"""
    WITH RECURSIVE {_roll_sql("n", 7, 10)},
    both_parts AS (
        SELECT event_type, "Date", CAST(n AS DOUBLE) AS n FROM seen WHERE "Date" >= last - 10
        UNION ALL SELECT event_type, last + step, state[1] FROM roll WHERE step > 0),
    totals AS (SELECT event_type, "Date", sum(n) OVER (PARTITION BY event_type ORDER BY "Date") AS n FROM both_parts),
    request AS (SELECT event_type, CAST(unnest(generate_series(CAST(min("Date") AS TIMESTAMP),
        CAST(max("Date") + 12 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM events_daily GROUP BY event_type)
    SELECT event_type || '_' || CAST("Date" AS VARCHAR) AS "ForecastId", round(n, 6) AS n
    FROM request LEFT JOIN totals USING (event_type, "Date")"""))
def submission_join(spark, folder):
    daily = stored_days(spark, folder)
    request = calendar.extend_calendar(daily, _EVENTS, 12).withColumn(
        "ForecastId", F.concat_ws("_", "event_type", F.col("Date").cast("string"))
    )
    totals = forecast.forecast_metric(daily, _EVENTS, "n", 7, 10)
    filled = joins.fill_request(request, totals, ["event_type", "Date"], ["n"])
    return filled.select("ForecastId", F.round("n", 6).alias("n"))


@query("backfill_missing", with_views("events_daily", f"""
    WITH RECURSIVE older AS (SELECT * FROM events_daily WHERE "Date" <= DATE '2024-01-16'),
    newer AS (SELECT * FROM events_daily WHERE "Date" >= DATE '2024-01-16' AND event_type NOT IN ('click', 'error')),
    absent AS (SELECT * FROM older WHERE event_type NOT IN (SELECT event_type FROM newer)),
    gap AS (SELECT CAST((SELECT max("Date") FROM newer) - (SELECT max("Date") FROM older) AS BIGINT) AS days),
    {_state_sql("n", 7, "absent")},
    roll AS (SELECT event_type, last, 0 AS step, state FROM start
             UNION ALL SELECT event_type, last, step + 1, list_prepend(list_sum(state[1:7]) / 7.0, state)[1:7] FROM roll
             WHERE step < (SELECT days FROM gap))
    SELECT event_type, "Date", CAST(n AS DOUBLE) AS n FROM older
    UNION SELECT event_type, "Date", CAST(n AS DOUBLE) FROM newer
    UNION SELECT event_type, last + step, round(state[1], 6) FROM roll WHERE step > 0"""))
def backfill_missing(spark, folder):
    daily = stored_days(spark, folder)
    older = daily.where("Date <= DATE'2024-01-16'")
    newer = daily.where("Date >= DATE'2024-01-16' AND event_type NOT IN ('click', 'error')")
    filled = forecast.backfill_missing(older, newer, _EVENTS, _EVENTS, ["n"], 7)
    return filled.withColumn("n", F.round("n", 6))


@query("shifted_forecast", with_views("country_panel", """
    WITH recent AS (SELECT * FROM country_panel WHERE "Date" >= (SELECT max("Date") FROM country_panel) - 30),
    frame AS (SELECT * FROM country_panel
              UNION ALL SELECT "Country", "Date" + 30, "Confirmed", "Deaths", "Recovered" FROM recent),
    fit AS (SELECT "Country", regr_slope("Confirmed", date_diff('day', DATE '1970-01-01', "Date")) AS s,
                   regr_intercept("Confirmed", date_diff('day', DATE '1970-01-01', "Date")) AS i
            FROM country_panel GROUP BY "Country")
    SELECT "Country", "Date", "Confirmed", round(day("Date") / CAST(1.3 AS DOUBLE) + 30 * month("Date"), 6) AS "DateInt",
           round(i + s * date_diff('day', DATE '1970-01-01', "Date"), 4) AS "Predicted"
    FROM frame JOIN fit USING ("Country")"""))
def shifted_forecast(spark, folder):
    known = stored_countries(spark, folder)
    frame = calendar.future_by_shift(known, 30)
    fits = models.trend_per_key(known, ["Country"], "Confirmed").select("Country", "slope", "intercept")
    scored = joins.null_safe_join(frame, fits, ["Country"])
    return scored.select(
        "Country", "Date", "Confirmed",
        F.round(dates.month_scaled_day(F.col("Date")), 6).alias("DateInt"),
        F.round(F.col("intercept") + F.col("slope") * F.unix_date("Date"), 4).alias("Predicted"),
    )


@query("shifted_forecast_scored")
def shifted_forecast_scored(spark, folder):
    # The shifted frame with lags over both halves, scored by a model of index + lags.
    rows = stored_training_rows(spark, folder)
    fitted = models.forest(numTrees=20, maxDepth=10, maxBins=250).fit(rows)
    known = rows.select("Country", "CountryIndex", "Date", F.col("label").alias("Confirmed"))
    frame = calendar.future_by_shift(known, HORIZON, by=HORIZON - 1)
    lagged = lags.lag_features(
        panel.sum_panel(frame, ["Country", "CountryIndex"], ["Confirmed"]), ["Country", "CountryIndex"], "Confirmed",
        HORIZON, fill=0,
    )
    scored = fitted.transform(features.assemble_lags(lagged, ["CountryIndex"], "Confirmed", HORIZON))
    return scored.select("Country", "Date", "Confirmed", F.col("prediction").alias("Predicted_Confirmed"))


# --- trend forecasts -----------------------------------------------------------------------

_DAY = """date_diff('day', DATE '1970-01-01', "Date")"""


def _trend_sql(key: str, metric: str, source: str, periods: int) -> str:
    return f"""
    fit AS (SELECT {key}, regr_slope({metric}, {_DAY}) AS s, regr_intercept({metric}, {_DAY}) AS i,
                   sqrt(greatest(var_pop({metric}) - regr_slope({metric}, {_DAY}) * covar_pop({metric}, {_DAY}), 0)) AS sd,
                   max("Date") AS b FROM {source} GROUP BY {key}),
    days AS (SELECT {key}, s, i, sd, "Date" AS ds FROM {source} JOIN fit USING ({key})
             UNION ALL SELECT {key}, s, i, sd, b + CAST(unnest(range(1, {periods} + 1)) AS INTEGER) FROM fit),
    fitted AS (SELECT {key}, ds, i + s * date_diff('day', DATE '1970-01-01', ds) AS yhat, sd FROM days)"""


@query("trend_forecast", with_views("country_panel", f"""
    WITH {_trend_sql('"Country"', '"Confirmed"', "country_panel", 30)}
    SELECT "Country", ds, round(yhat, 4) AS yhat, round(yhat - 1.2816 * sd, 4) AS yhat_lower,
           round(yhat + 1.2816 * sd, 4) AS yhat_upper FROM fitted"""))
def trend_forecast(spark, folder):
    fitted = forecast.trend_forecast(stored_countries(spark, folder), ["Country"], "Confirmed", 30)
    return fitted.withColumns({c: F.round(c, 4) for c in ("yhat", "yhat_lower", "yhat_upper")})


@query("insample_fit", with_views("country_panel", f"""
    WITH {_trend_sql('"Country"', '"Confirmed"', "country_panel", 0)}
    SELECT f."Country", ds, round(yhat, 4) AS yhat, CAST("Confirmed" AS DOUBLE) AS y
    FROM fitted f JOIN country_panel p ON f."Country" = p."Country" AND ds = "Date" """))
def insample_fit(spark, folder):
    fitted = forecast.insample_fit(stored_countries(spark, folder), ["Country"], "Confirmed")
    return fitted.select("Country", "ds", F.round("yhat", 4).alias("yhat"), "y")


_WORLD = """
    world AS (SELECT "Date", CAST(sum("Confirmed") AS BIGINT) AS "Confirmed", CAST(sum("Deaths") AS BIGINT) AS "Deaths",
                     CAST(sum("Recovered") AS BIGINT) AS "Recovered" FROM panel GROUP BY "Date")"""


def _world(spark, folder):
    return materialise(panel.sum_panel(panel_view(spark, folder), [], PANEL_METRICS), "world")


@query("forecast_vs_actual", with_views("panel", f"""
    WITH {_WORLD}, keyed AS (SELECT 'world' AS k, * FROM world),
    {_trend_sql("k", '"Confirmed"', "keyed", 30)}
    SELECT ds, round(yhat, 4) AS yhat, "Confirmed" FROM fitted LEFT JOIN world ON ds = "Date" """))
def forecast_vs_actual(spark, folder):
    world = _world(spark, folder)
    fitted = forecast.trend_forecast(world, [], "Confirmed", 30)
    actual = world.select(F.col("Date").alias("ds"), "Confirmed")
    return joins.with_actuals(fitted.select("ds", F.round("yhat", 4).alias("yhat")), actual)


def _bands_sql(metric: str) -> str:
    return (
        f"""max(round(yhat, 4)) FILTER (WHERE metric = '{metric}') AS "{metric}_yhat",
            max(round(yhat - 1.2816 * sd, 4)) FILTER (WHERE metric = '{metric}') AS "{metric}_yhat_lower",
            max(round(yhat + 1.2816 * sd, 4)) FILTER (WHERE metric = '{metric}') AS "{metric}_yhat_upper" """
    )


@query("forecast_table", with_views("panel", f"""
    WITH {_WORLD}, long AS (
        SELECT "Date", 'Confirmed' AS metric, "Confirmed" AS value FROM world
        UNION ALL SELECT "Date", 'Deaths', "Deaths" FROM world UNION ALL SELECT "Date", 'Recovered', "Recovered" FROM world),
    {_trend_sql("metric", "value", "long", 30)},
    wide AS (SELECT ds, {", ".join(_bands_sql(m) for m in PANEL_METRICS)} FROM fitted GROUP BY ds)
    SELECT wide.*, "Confirmed", "Deaths", "Recovered" FROM wide LEFT JOIN world ON ds = "Date" """))
def forecast_table(spark, folder):
    table = forecast.forecast_table(_world(spark, folder), PANEL_METRICS, 30)
    return table.withColumns({c: F.round(c, 4) for c in table.columns if "_yhat" in c})


@query("additive_forecast")
def additive_forecast(spark, folder):
    world = _world(spark, folder)
    return forecast.forecast_table(world, PANEL_METRICS, 30, forecaster=forecast.additive_forecast)


def _residual_check(rows, keys, inputs, ridge, weights="weights"):
    """Per key the mean fit, and whether the residuals meet the normal equations: sum of residual times input
    equals ridge times weight, for every input."""
    gap = F.col("y") - F.col("yhat")
    long = rows.select(*keys, "y", "yhat", gap.alias("gap"), F.posexplode(F.arrays_zip(
        F.array(*inputs).alias("x"), F.col(weights).alias("w"), F.expr(ridge).alias("r"))).alias("i", "t"))
    sums = long.groupBy(*keys, "i").agg(
        F.avg("yhat").alias("mean"), F.avg(F.abs("y")).alias("scale"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("gap") * F.col("t.x")).alias("left"), F.first(F.col("t.w") * F.col("t.r")).alias("right"))
    close = F.abs(F.col("left") - F.col("right")) < F.col("scale") * F.col("n") * 1e-6
    return sums.groupBy(*keys).agg(F.round(F.max("mean") + F.lit(1e-7), 4).alias("fitted_mean"), F.min(close).alias("meets"))


@query("additive_normal_equations", with_views("country_panel", """
    SELECT "Country", round(avg("Confirmed") + 1e-7, 4) AS fitted_mean, true AS meets FROM country_panel GROUP BY "Country" """))
def additive_normal_equations(spark, folder):
    days = stored_countries(spark, folder)
    fits = forecast.additive_fit(days, ["Country"], "Confirmed").select("Country", "_first", "_last", "weights")
    fitted = forecast.insample_fit(days, ["Country"], "Confirmed", forecaster=forecast.additive_forecast)
    rows = joins.null_safe_join(fitted, fits, ["Country"])
    inputs = forecast.design(F.unix_date("ds").cast("double"), F.col("_first"), F.col("_last"), 5, 3, 10)
    ridge = f"concat(array_repeat(1e-9D, 2), array_repeat(1e-2D, {len(inputs) - 2}))"
    return _residual_check(rows, ["Country"], inputs, ridge)


@query("per_key_normal_equations", with_views("country_panel", """
    SELECT "Country", round(avg("Confirmed") + 1e-7, 4) AS fitted_mean, true AS meets FROM country_panel GROUP BY "Country" """))
def per_key_normal_equations(spark, folder):
    lagged = materialise(lags.lag_features(stored_countries(spark, folder), ["Country"], "Confirmed", 15, fill=0), "lagged")
    fits = models.ridge_per_key(lagged, ["Country"], "Confirmed", 15)
    rows = joins.null_safe_join(lagged, fits, ["Country"])
    inputs = [F.lit(1.0), *[F.col(c).cast("double") for c in lags.lag_names("Confirmed", 15)]]
    every = F.concat(F.array("intercept"), F.col("weights"))
    rows = rows.withColumn("every", every).withColumns({
        "yhat": F.aggregate(F.zip_with(F.array(*inputs), "every", lambda a, w: a * w), F.lit(0.0), lambda t, v: t + v),
        "y": F.col("Confirmed").cast("double")})
    ridge = "concat(array(0D), array_repeat(1e-6D * n, 15))"
    return _residual_check(rows, ["Country"], inputs, ridge, "every")


@query("additive_insample_fit")
def additive_insample_fit(spark, folder):
    return forecast.insample_fit(
        stored_countries(spark, folder), ["Country"], "Confirmed", forecaster=forecast.additive_forecast
    )


@query("additive_contract", with_views("panel", f"""
    WITH {_WORLD}, days AS (
        SELECT "Date" AS ds, true AS known FROM world
        UNION ALL SELECT (SELECT max("Date") FROM world) + CAST(unnest(range(1, 31)) AS INTEGER), false)
    SELECT ds, known, true AS ordered FROM days"""))
def additive_contract(spark, folder):
    world = _world(spark, folder)
    fitted = forecast.additive_forecast(world, [], "Confirmed", 30)
    last = world.agg(F.max("Date")).scalar()
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return fitted.select("ds", (F.col("ds") <= last).alias("known"), ordered.alias("ordered"))


@query("recursive_gbt_contract", with_views("country_panel", """
    WITH bounds AS (SELECT "Country", max("Confirmed") AS top FROM country_panel GROUP BY "Country")
    SELECT "Country", (SELECT max("Date") FROM country_panel) + CAST(unnest(range(1, 15)) AS INTEGER) AS "Date",
           true AS scored, (SELECT max("Confirmed") FROM country_panel) AS top FROM bounds"""))
def recursive_gbt_contract(spark, folder):
    # Every country, and predictions within the range of the labels (as means of labels, corrected by boosting).
    ahead = materialise(recursive_forecast_gbt(spark, folder), "ahead")
    top = stored_countries(spark, folder).agg(F.max("Confirmed")).scalar()
    within = F.col("Confirmed").between(-1.0 * top, 2.0 * top)
    return ahead.select("Country", "Date", within.alias("scored"), top.alias("top"))


@query("recursive_gbt_compiled", with_views("country_panel", """
    SELECT DISTINCT "Country", (SELECT max("Date") FROM country_panel) + CAST(step AS INTEGER) AS "Date", true AS same
    FROM country_panel, range(1, 31) AS t(step)"""))
def recursive_gbt_compiled(spark, folder):
    """Thirty days rolled in one expression, held against one scoring step per day."""
    rows = stored_training_rows(spark, folder)
    fitted = models.gbt(maxIter=5, maxDepth=5, maxBins=190).fit(rows)
    history = rows.select("Country", "CountryIndex", "Date", F.col("label").alias("Confirmed"))

    def ahead(compiled):
        return forecast.recursive_forecast(history, ["Country", "CountryIndex"], "Confirmed", HORIZON, 30, fitted,
                                           codes=["CountryIndex"], cover="all", compiled=compiled)

    steps = ahead(False).select("Country", "Date", F.col("Confirmed").alias("step"))
    both = joins.null_safe_join(ahead(True), steps, ["Country", "Date"], "left")
    same = F.abs(F.col("Confirmed") - F.col("step")) <= 1e-9 * (1 + F.abs("step"))
    return both.select("Country", "Date", F.coalesce(same, F.lit(False)).alias("same"))


@query("shifted_scored_contract", with_views("country_panel", """
    SELECT DISTINCT "Country", "Date", true AS scored, (SELECT max("Confirmed") FROM country_panel) AS top FROM (
        SELECT "Country", "Date" FROM country_panel UNION ALL SELECT "Country", "Date" + 6 FROM country_panel
        WHERE "Date" >= (SELECT max("Date") FROM country_panel) - 7)"""))
def shifted_scored_contract(spark, folder):
    # A forest predicts means of labels: between none and the greatest.
    scored = materialise(shifted_forecast_scored(spark, folder), "scored")
    top = stored_countries(spark, folder).agg(F.max("Confirmed")).scalar()
    within = F.col("Predicted_Confirmed").between(F.lit(0.0), top)
    return scored.select("Country", "Date", within.alias("scored"), top.alias("top"))


_TREND = {"knots": 8, "weekly": 2, "yearly": 1}
_TREND_SIZE = 16


@query("sparse_trend_optimal", with_views("country_panel", f"""
    SELECT "Country", CAST(place AS INTEGER) AS place, count(*) AS n, true AS optimal
    FROM country_panel, range({_TREND_SIZE}) AS t(place) GROUP BY ALL"""))
def sparse_trend_optimal(spark, folder):
    """Every weight of every country against the rows: no gradient for free inputs and one of the limit's size for slope
    changes in use, and one within it for those that are 0."""
    daily = stored_countries(spark, folder)
    fits = materialise(forecast.sparse_trend_fit(daily, ["Country"], "Confirmed", **_TREND), "trend")
    day = F.unix_date("Date").cast("double")
    rows = joins.null_safe_join(daily, fits, ["Country"]).withColumn(
        "x", F.array(*forecast.design(day, F.col("_first"), F.col("_last"), **_TREND)))
    yhat = F.aggregate(F.zip_with("x", "weights", lambda a, w: a * w), F.lit(0.0), lambda total, v: total + v)
    terms = rows.withColumn("error", F.col("Confirmed") - yhat).select(
        "Country", "error", "weights", "limit", F.posexplode("x").alias("place", "v"))
    sums = terms.groupBy("Country", "place").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("v") * F.col("error")).alias("g"), F.stddev_pop("error").alias("sd"),
        F.first(F.get("weights", F.col("place"))).alias("w"), F.first("limit").alias("limit"))
    near = 1e-7 * (1 + F.col("sd"))
    penalised = F.col("place").between(2, 1 + _TREND["knots"])
    wanted = F.when(penalised, F.signum("w") * F.col("limit")).otherwise(0.0)
    slack = F.when(penalised & (F.col("w") == 0), F.col("limit")).otherwise(0.0)
    return sums.select("Country", "place", "n", (F.abs(F.col("g") - wanted) <= slack + near).alias("optimal"))


@query("sparse_trend_forecast", with_views("country_panel", """
    WITH ends AS (SELECT "Country", max("Date") AS last FROM country_panel GROUP BY "Country")
    SELECT "Country", "Date" AS ds, true AS known, true AS in_order, true AS wide_enough FROM country_panel
    UNION ALL SELECT "Country", last + CAST(step AS INTEGER), false, true, true FROM ends, range(1, 31) AS t(step)"""))
def sparse_trend_forecast(spark, folder):
    """Known days and thirty ahead of every country; the band is never narrower than before the end of the known days."""
    daily = stored_countries(spark, folder)
    fitted = materialise(forecast.sparse_trend_forecast(daily, ["Country"], "Confirmed", 30, **_TREND), "trend-days")
    last = daily.groupBy("Country").agg(F.max("Date").alias("last"))
    known = F.col("ds") <= F.col("last")
    width = F.col("yhat_upper") - F.col("yhat_lower")
    rows = joins.null_safe_join(fitted, last, ["Country"]).withColumns({"known": known, "width": width})
    past = rows.where("known").groupBy("Country").agg(F.max("width").alias("past"))
    rows = joins.null_safe_join(rows, past, ["Country"])
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return rows.select("Country", "ds", "known", ordered.alias("in_order"),
                       (F.col("known") | (F.col("width") >= F.col("past") - 1e-9)).alias("wide_enough"))
