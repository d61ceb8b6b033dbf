"""Recursive, seasonal and trend forecasts for every key at once."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dayloom.operators.columns import as_day, unpivot_metrics
from dayloom.operators.features import check_feature_size, state_vector
from dayloom.operators.joins import join_targets, null_safe_join
from dayloom.operators.models import trend_per_key
from dayloom.operators.panel import cumulate, days_between
from dayloom.operators.trees import compile_trees, is_tree_model
from dayloom.session import materialise

# Two-sided 80 % point of the normal distribution.
BAND_80 = 1.2816

Scorer = Callable[[Column], Column]


def mean_of_lags(horizon: int) -> Scorer:
    """Mean of the last H days."""
    return lambda past: F.aggregate(past, F.lit(0.0), lambda total, x: total + x) / F.lit(float(horizon))


def weighted_lags(weights: str = "weights", intercept: str = "intercept") -> Scorer:
    """Linear model of the lags; weights (lag 1 first) and intercept are columns of the state."""
    return lambda past: F.aggregate(
        F.zip_with(past, F.col(weights), lambda x, w: x * w), F.col(intercept), lambda total, x: total + x
    )


def history_state(
    df: DataFrame,
    keys: Sequence[str],
    metric: str,
    horizon: int,
    date: str = "Date",
    as_of: Column | dt.date | None = None,
    cover: str = "last_day",
) -> DataFrame:
    """Per key the last H daily values, newest first, 0 where a day is absent.

    ``cover="last_day"`` takes the keys present on the last known day, ``"all"`` every key seen up to
    it. One aggregate with one partial sum per day: the buffer of a key has H numbers whatever its
    number of rows. Output: keys, ``last_day``, ``state`` array<double>.
    """
    if cover not in ("last_day", "all"):
        raise ValueError(f"unknown cover: {cover}")
    last = as_day(df, as_of, date)
    known = F.col(date) <= last
    if cover == "last_day":
        known = known & (F.col(date) > F.date_sub(last, horizon))
    recent = df.where(known).withColumn("_age", F.datediff(last, F.col(date)))
    value = F.col(metric).cast("double")
    days = [F.coalesce(F.sum(F.when(F.col("_age") == h, value)), F.lit(0.0)) for h in range(horizon)]
    return (
        recent.groupBy(*keys)
        .agg(F.min("_age").alias("_newest"), F.max(date).alias("_last"), F.array(*days).alias("state"))
        .where("_newest = 0" if cover == "last_day" else "true")
        .select(*keys, F.date_add("_last", F.col("_newest")).alias("last_day"), "state")
    )


def _roll(state: Column, horizon: int, periods: int, scorer: Scorer, round_feedback: bool) -> Column:
    """Newest-first values after ``periods`` steps; one expression, whatever the number of steps."""

    def step(past: Column, _: Column) -> Column:
        score = scorer(F.slice(past, 1, horizon))
        if round_feedback:
            score = F.floor(score + F.lit(0.5)).cast("double")
        return F.concat(F.array(score), past)

    return F.aggregate(F.sequence(F.lit(1), F.lit(periods)), state, step)


def _roll_with_model(
    states: DataFrame, codes: Sequence[str], horizon: int, periods: int, model: Model, round_feedback: bool,
    store_every: int,
) -> DataFrame:
    """One narrow scoring step per day; every few steps the frame is stored to keep the plan short."""
    check_feature_size(model, len(codes) + horizon)
    rolled = states
    for day in range(1, periods + 1):
        vector = state_vector(codes, F.slice("state", 1, horizon))
        scored = model.transform(rolled.withColumn("features", vector))
        score = F.col("prediction")
        if round_feedback:
            score = F.floor(score + F.lit(0.5)).cast("double")
        rolled = scored.withColumn("state", F.concat(F.array(score), "state")).drop("features", "prediction")
        if day % store_every == 0 and day < periods:
            rolled = materialise(rolled, "forecast")
    return rolled


def recursive_forecast(
    df: DataFrame,
    keys: Sequence[str],
    metric: str,
    horizon: int,
    periods: int,
    scorer: Scorer | Model | None = None,
    codes: Sequence[str] = (),
    parameters: DataFrame | None = None,
    date: str = "Date",
    as_of: Column | dt.date | None = None,
    round_feedback: bool = False,
    store_every: int = 10,
    cover: str = "last_day",
    compiled: bool = True,
) -> DataFrame:
    """Forecast day after day, feeding each prediction back as the next day's lag 1.

    ``scorer`` is a column builder over the newest-first past values (default:
    mean of lags) or a fitted Spark ML model over ``codes`` + lags. Tree models roll as one expression over
    their nodes; other models, and all with ``compiled=False``, by one scoring step per day. ``parameters``
    joins per-key columns (such as ``weights``) to the state. The only shuffle is
    the one that builds the state. Output: keys, date, metric.
    """
    states = history_state(df, keys, metric, horizon, date, as_of, cover)
    if parameters is not None:
        states = null_safe_join(states, parameters, list(keys))
    if isinstance(scorer, Model) and compiled and is_tree_model(scorer):
        check_feature_size(scorer, len(codes) + horizon)
        scorer = compile_trees(scorer).scorer(codes)
    if isinstance(scorer, Model):
        rolled = _roll_with_model(states, codes, horizon, periods, scorer, round_feedback, store_every)
    else:
        past = _roll(F.col("state"), horizon, periods, scorer or mean_of_lags(horizon), round_feedback)
        rolled = states.withColumn("state", past)
    ahead = F.posexplode(F.reverse(F.slice("state", 1, periods))).alias("_step", metric)
    return rolled.select(*keys, "last_day", ahead).select(
        *keys, F.date_add("last_day", F.col("_step") + 1).alias(date), metric
    )


def forecast_metric(
    df: DataFrame,
    keys: Sequence[str],
    metric: str,
    horizon: int,
    periods: int,
    history: str = "window",
    date: str = "Date",
    as_of: Column | dt.date | None = None,
    **options,
) -> DataFrame:
    """History and forecast of a daily metric as running totals.

    ``history="window"`` starts the totals max(H, P) days before the last known
    day; ``"full"`` starts them at the first day; ``"opening"`` gives the days of the
    window with the totals of the full history. Output: keys, date, metric (running
    total), ``is_forecast``.
    """
    if history not in ("window", "full", "opening"):
        raise ValueError(f"unknown history: {history}")
    last = as_day(df, as_of, date)
    ahead = recursive_forecast(df, keys, metric, horizon, periods, date=date, as_of=as_of, **options)
    past = df.select(*keys, date, F.col(metric).cast("double").alias(metric))
    in_window = F.col(date) >= F.date_sub(last, max(horizon, periods))
    if history == "window":
        past = past.where(in_window)
    both = past.withColumn("is_forecast", F.lit(False)).unionByName(
        ahead.withColumn("is_forecast", F.lit(True))
    )
    totals = cumulate(both, keys, [metric], date)
    return totals.where(in_window) if history == "opening" else totals


def _is_closed_form(scorers: Mapping[str, Scorer | Model | None]) -> bool:
    """Whether one column builder (or the default) serves every target."""
    distinct = set(scorers.values())
    return len(distinct) <= 1 and not any(isinstance(s, Model) for s in distinct)


def forecast_targets(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    horizon: int,
    periods: int,
    scorers: Mapping[str, Scorer | Model | None] | None = None,
    codes: Sequence[str] = (),
    date: str = "Date",
    totals: str | None = None,
    **options,
) -> DataFrame:
    """Forecasts of several metrics next to each other: keys, date, metrics.

    With one closed-form scorer the metrics become rows and share one plan; with a
    model per metric they are forecast one by one and joined. ``totals``
    (``"window"``, ``"full"``, ``"opening"``) gives history and forecast as running totals (``forecast_metric``).
    """
    scorers = {m: (scorers or {}).get(m) for m in metrics}

    def run(rows: DataFrame, by: Sequence[str], metric: str, scorer) -> DataFrame:
        extra = {"codes": codes} if isinstance(scorer, Model) else {}
        if totals is None:
            return recursive_forecast(rows, by, metric, horizon, periods, scorer, date=date, **extra, **options)
        return forecast_metric(
            rows, by, metric, horizon, periods, totals, date, scorer=scorer, **extra, **options
        ).drop("is_forecast")

    if _is_closed_form(scorers):
        doubles = df.select(*keys, date, *[F.col(m).cast("double").alias(m) for m in metrics])
        long = unpivot_metrics(doubles, [*keys, date], metrics)
        ahead = run(long, [*keys, "metric"], "value", scorers[metrics[0]])
        return join_targets(ahead, [*keys, date], metrics).select(*keys, date, *metrics)
    joined = run(df, keys, metrics[0], scorers[metrics[0]])
    for m in metrics[1:]:
        joined = null_safe_join(joined, run(df, keys, m, scorers[m]), [*keys, date])
    return joined.select(*keys, date, *metrics)


def backfill_missing(
    older: DataFrame,
    newer: DataFrame,
    entity: Sequence[str],
    keys: Sequence[str],
    metrics: Sequence[str],
    horizon: int,
    date: str = "Date",
    scorers: Mapping[str, Scorer | Model | None] | None = None,
    codes: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Both sources, plus forecasts for the entities that the newer one lacks.

    Missing entities (found by an anti join) are forecast from the older source's
    last day to the newer source's last day; equal rows are kept once.
    """
    columns = [*keys, date, *metrics]
    past = older.select(*keys, date, *[F.col(m).cast("double").alias(m) for m in metrics])
    fresh = newer.select(*keys, date, *[F.col(m).cast("double").alias(m) for m in metrics])
    union = past.unionByName(fresh)
    gap = days_between(newer, older, date).first()["days"]
    if gap is not None and gap > 0:
        absent = null_safe_join(past, newer.select(*entity).distinct(), list(entity), "left_anti")
        last = as_day(older, None, date)
        filled = forecast_targets(absent, keys, metrics, horizon, gap, scorers, codes, date, as_of=last, **options)
        union = union.unionByName(filled.select(*columns))
    return union.distinct()


# --- trend forecasts ---------------------------------------------------------------

def trend_forecast(df: DataFrame, keys: Sequence[str], metric: str, periods: int, date: str = "Date") -> DataFrame:
    """Fitted line over the known days and ``periods`` days ahead with an 80 % band.

    Output: keys, ``ds``, ``yhat``, ``yhat_lower``, ``yhat_upper``. The known days of
    a key travel with its fit as a set, which the calendar bounds, so that neither
    a join nor a second pass is needed.
    """
    fits = trend_per_key(df, keys, metric, date, [F.collect_set(date).alias("_days")])
    days = F.col("_days")
    if periods > 0:
        days = F.concat(days, F.sequence(F.date_add("last_day", 1), F.date_add("last_day", periods)))
    calendar = F.explode(days).alias("ds")
    yhat = F.col("intercept") + F.col("slope") * F.unix_date("ds")
    return (
        fits.select(*keys, "slope", "intercept", "sd", calendar)
        .select(*keys, "ds", yhat.alias("yhat"), "sd")
        .select(
            *keys,
            "ds",
            "yhat",
            (F.col("yhat") - F.lit(BAND_80) * F.col("sd")).alias("yhat_lower"),
            (F.col("yhat") + F.lit(BAND_80) * F.col("sd")).alias("yhat_upper"),
        )
    )


def insample_fit(df: DataFrame, keys: Sequence[str], metric: str, date: str = "Date", forecaster=trend_forecast,
                 periods: int = 0) -> DataFrame:
    """Fitted values of every entity next to its actuals (``y``)."""
    fitted = forecaster(df, keys, metric, periods, date)
    actual = df.select(*keys, F.col(date).alias("ds"), F.col(metric).cast("double").alias("y"))
    return null_safe_join(fitted, actual, [*keys, "ds"], "left" if periods else "inner")


def forecast_table(df: DataFrame, metrics: Sequence[str], periods: int, date: str = "Date",
                   forecaster=trend_forecast) -> DataFrame:
    """World series forecast, wide: ds, actuals, and yhat / lower / upper per metric."""
    long = unpivot_metrics(df.withColumns({m: F.col(m).cast("double") for m in metrics}), [date], metrics)
    fitted = forecaster(long, ["metric"], "value", periods, date)
    wide = fitted.groupBy("ds").pivot("metric", list(metrics)).agg(
        F.first("yhat").alias("yhat"),
        F.first("yhat_lower").alias("yhat_lower"),
        F.first("yhat_upper").alias("yhat_upper"),
    )
    actuals = df.select(F.col(date).alias("ds"), *metrics)
    bands = [f"{m}_{b}" for m in metrics for b in ("yhat", "yhat_lower", "yhat_upper")]
    return wide.join(actuals, "ds", "left").select("ds", *metrics, *bands)


# --- additive trend and season ---------------------------------------------------

def design(day: Column, first: Column, last: Column, knots: int, weekly: int, yearly: int) -> list[Column]:
    """Inputs of a day: level, slope, slope changes over the first 80 % of the span, seasons."""
    t = (day - first) / F.greatest(last - first, F.lit(1.0))
    columns = [F.lit(1.0), t]
    columns += [F.greatest(t - F.lit(float(0.8 * k / (knots + 1))), F.lit(0.0)) for k in range(1, knots + 1)]
    for length, order in ((7.0, weekly), (365.25, yearly)):
        for n in range(1, order + 1):
            angle = day * F.lit(2 * math.pi * n / length)
            columns += [F.sin(angle), F.cos(angle)]
    return columns


def _design_matrix(day: np.ndarray, first: float, last: float, knots: int, weekly: int, yearly: int) -> np.ndarray:
    """``design`` over an array of days."""
    t = (day - first) / max(last - first, 1.0)
    columns = [np.ones_like(t), t] + [np.maximum(t - 0.8 * k / (knots + 1), 0.0) for k in range(1, knots + 1)]
    for length, order in ((7.0, weekly), (365.25, yearly)):
        for n in range(1, order + 1):
            angle = day * (2 * math.pi * n / length)
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def additive_fit(
    df: DataFrame, keys: Sequence[str], metric: str, date: str = "Date", knots: int = 5, weekly: int = 3,
    yearly: int = 10, penalty: float = 1e-2,
) -> DataFrame:
    """Weights of the additive model per series: keys, ``_first``, ``_last``, ``_days``, ``weights``, ``sd``.

    One shuffle by key and no group function: the rows of a partition stream through in key order, and a
    series, which has one row per day, adds up its normal equations and is solved when its last row has passed.
    ``penalty`` damps all inputs but level and slope, terms that a short series cannot carry among them.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys)
    known = df.where(F.col(metric).isNotNull()).select(
        *keys, F.unix_date(F.col(date)).cast("double").alias("_day"), F.col(metric).cast("double").alias("_y"))
    known = known.withColumns({"_first": F.min("_day").over(by), "_last": F.max("_day").over(by)})
    if keys:
        known = known.sortWithinPartitions(*keys)
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(
        "_first double, _last double, _days array<double>, weights array<double>, sd double").fields)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        open_key: tuple | None = None
        days: list[float] = []
        values: list[float] = []
        span = (0.0, 0.0)

        def fitted() -> list:
            day, y = np.array(days), np.array(values)
            x = _design_matrix(day, *span, knots, weekly, yearly)
            ridge = np.diag([1e-9, 1e-9] + [penalty] * (x.shape[1] - 2))
            w = np.linalg.lstsq(x.T @ x + ridge, x.T @ y, rcond=None)[0]
            return [*open_key, *span, list(dict.fromkeys(days)), w.tolist(), float(np.std(y - x @ w))]

        def table(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key, (day, y, first, last) = row[:-4], row[-4:]
                if key != open_key:
                    if days:
                        done.append(fitted())
                    open_key, days, values, span = key, [], [], (first, last)
                days.append(day)
                values.append(y)
            yield table(done)
        if days:
            yield table([fitted()])

    return known.mapInArrow(solve, schema)


def additive_forecast(
    df: DataFrame, keys: Sequence[str], metric: str, periods: int, date: str = "Date",
    knots: int = 5, penalty: float = 1e-2, weekly: int = 3, yearly: int = 10,
) -> DataFrame:
    """Piecewise-linear trend plus weekly and yearly season per series, with an 80 % band.

    ``knots``, ``weekly`` and ``yearly`` (orders of the seasons) set the model, whatever the length of a
    series. Output: keys, ``ds``, ``yhat``, ``yhat_lower``, ``yhat_upper`` over the known days and ``periods``
    days ahead, scored by a column expression.
    """
    fits = additive_fit(df, keys, metric, date, knots, weekly, yearly, penalty)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.col("_last") + i) if periods > 0 else (
        F.array().cast("array<double>"))
    days = fits.select(*keys, "_first", "_last", "weights", "sd", F.explode(F.concat("_days", ahead)).alias("_day"))
    inputs = F.array(*design(F.col("_day"), F.col("_first"), F.col("_last"), knots, weekly, yearly))
    yhat = F.aggregate(F.zip_with(inputs, "weights", lambda a, w: a * w), F.lit(0.0), lambda total, v: total + v)
    fitted = days.select(*keys, F.date_from_unix_date(F.col("_day").cast("int")).alias("ds"), yhat.alias("yhat"), "sd")
    return fitted.select(
        *keys, "ds", "yhat",
        (F.col("yhat") - F.lit(BAND_80) * F.col("sd")).alias("yhat_lower"),
        (F.col("yhat") + F.lit(BAND_80) * F.col("sd")).alias("yhat_upper"),
    )


# --- trend with few changes --------------------------------------------------------


def _lasso(square: np.ndarray, right: np.ndarray, free: np.ndarray, limit: float, rounds: int = 20000) -> np.ndarray:
    """Least w'Sw/2 - r'w + limit * sum|w| over the inputs that are not ``free``, by coordinate descent.

    The free inputs are eliminated first. Once signs settle, the inputs in use are solved for exactly; that
    solution is taken where it keeps the signs and leaves the gradient of the others within the limit.
    """
    held = ~free
    inverse = np.linalg.pinv(square[np.ix_(free, free)], hermitian=True)
    across = square[np.ix_(held, free)]
    s = square[np.ix_(held, held)] - across @ inverse @ across.T
    r = right[held] - across @ inverse @ right[free]
    usable = np.diag(s) > 1e-12 * np.maximum(np.diag(square)[held], 1e-300)
    w = np.zeros(len(r))
    for done in range(1, rounds + 1):
        before = w.copy()
        for j in np.flatnonzero(usable):
            pull = r[j] - s[j] @ w + s[j, j] * w[j]
            w[j] = np.sign(pull) * max(abs(pull) - limit, 0.0) / s[j, j]
        if done % 20 == 0 or np.array_equal(w, before):
            used = w != 0
            exact = np.zeros(len(r))
            if used.any():
                exact[used] = np.linalg.lstsq(s[np.ix_(used, used)], r[used] - limit * np.sign(w[used]), rcond=None)[0]
            rest = np.abs(r - s @ exact)[usable & ~used]
            if np.array_equal(np.sign(exact), np.sign(w)) and (rest <= limit * (1 + 1e-9)).all():
                w = exact
                break
    weights = np.zeros(len(right))
    weights[held] = w
    weights[free] = inverse @ (right[free] - across.T @ w)
    return weights


def sparse_trend_fit(df: DataFrame, keys: Sequence[str], metric: str, date: str = "Date", knots: int = 8, weekly: int = 2,
                     yearly: int = 1, penalty: float = 0.01) -> DataFrame:
    """Additive model whose slope changes carry an L1 penalty, so that most are 0; per series, for every key at once.

    The normal equations are summed by Spark, partially before the shuffle; one row of sums per key reaches the
    solver, however long a series is. The weights minimise the mean squared error / 2 plus ``limit`` x the sum of the absolute
    slope changes, ``limit`` being ``penalty`` standard deviations of the series. Level, slope and seasons are free.
    Rows without a value are left out; a constant series gets its level. Output: keys, ``_first``, ``_last``, ``n``,
    ``weights`` in the order of ``design``, ``sd`` of the residuals, ``limit``.
    """
    keys, size = list(keys), 2 + knots + 2 * (weekly + yearly)
    known = df.where(F.col(metric).isNotNull()).select(
        *keys, F.unix_date(F.col(date)).cast("double").alias("_day"), F.col(metric).cast("double").alias("_y"))
    span = known.groupBy(*keys).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    ends = [*keys, "_first", "_last"]
    inputs = design(F.col("_day"), F.col("_first"), F.col("_last"), knots, weekly, yearly)
    rows = null_safe_join(known, span, keys).select(*ends, "_y", F.array(*inputs).alias("_x"))
    x = [F.get("_x", F.lit(i)) for i in range(size)]
    sums = rows.groupBy(*ends).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x[i] * x[j]) for i in range(size) for j in range(i, size)]).alias("xx"),
        F.array(*[F.sum(v * F.col("_y")) for v in x]).alias("xy"), F.sum(F.col("_y") * F.col("_y")).alias("yy")
    ).where("_first IS NOT NULL")
    upper = np.triu_indices(size)
    free = np.array([not 2 <= i < 2 + knots for i in range(size)])

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            out = batch[[*ends, "n"]].copy()
            fits = []
            for n, xx, xy, yy in zip(batch["n"], batch["xx"], batch["xy"], batch["yy"]):
                square = np.zeros((size, size))
                square[upper] = np.asarray(xx) / n
                square += np.triu(square, 1).T
                right = np.asarray(xy) / n
                # The last term keeps rounding from counting as a change where the series is constant.
                limit = penalty * math.sqrt(max(yy / n - right[0] ** 2, 0.0)) + 1e-12 * math.sqrt(yy / n)
                w = _lasso(square, right, free, limit)
                left = max(yy / n - 2 * w @ right + w @ square @ w, 0.0)
                fits.append((w, math.sqrt(left), limit))
            out["weights"], out["sd"], out["limit"] = ([f[i] for f in fits] for i in range(3))
            yield out

    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{kept}{', ' if keys else ''}_first double, _last double, n bigint, "
                                   "weights array<double>, sd double, limit double")


def sparse_trend_forecast(df: DataFrame, keys: Sequence[str], metric: str, periods: int, date: str = "Date", knots: int = 8,
                          weekly: int = 2, yearly: int = 1, penalty: float = 0.01) -> DataFrame:
    """Forecast of ``sparse_trend_fit`` with an 80 % band that widens with the days ahead.

    Future slope changes are taken to come as often and to be as large (on average, either sign) as those of the past, so
    the variance of the trend grows with the third power of the days ahead. Output: keys, ``ds``, ``yhat``,
    ``yhat_lower``, ``yhat_upper`` over the known days and ``periods`` days ahead.
    """
    fits = materialise(sparse_trend_fit(df, keys, metric, date, knots, weekly, yearly, penalty), "sparse-trend")
    past = df.where(F.col(metric).isNotNull()).select(*keys, F.unix_date(F.col(date)).cast("double").alias("_day")).distinct()
    days = null_safe_join(past, fits, keys)
    if periods > 0:
        ahead = F.explode(F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.col("_last") + i))
        days = days.unionByName(fits.withColumn("_day", ahead))
    inputs = F.array(*design(F.col("_day"), F.col("_first"), F.col("_last"), knots, weekly, yearly))
    yhat = F.aggregate(F.zip_with(inputs, "weights", lambda a, w: a * w), F.lit(0.0), lambda total, v: total + v)
    change = F.aggregate(F.slice("weights", 3, knots), F.lit(0.0), lambda total, w: total + F.abs(w)) / F.lit(float(max(knots, 1)))
    beyond = F.greatest(F.col("_day") - F.col("_last"), F.lit(0.0)) / F.greatest(F.col("_last") - F.col("_first"), F.lit(1.0))
    # Changes come at the rate knots / 0.8 per span; a Laplace draw of mean size m has the variance 2 m^2.
    spread = F.sqrt(F.col("sd") * F.col("sd") + F.lit(knots / 0.8 * 2 / 3) * change * change * F.pow(beyond, F.lit(3.0)))
    fitted = days.select(*keys, F.date_from_unix_date(F.col("_day").cast("int")).alias("ds"), yhat.alias("yhat"),
                         (F.lit(BAND_80) * spread).alias("_band"))
    return fitted.select(*keys, "ds", "yhat", (F.col("yhat") - F.col("_band")).alias("yhat_lower"),
                         (F.col("yhat") + F.col("_band")).alias("yhat_upper"))
