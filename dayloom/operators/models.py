"""Regressors, grid search, evaluation and per-key models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.operators.lags import lag_names
from dayloom.session import path_exists

SEED = 1234

# The grids the four trainers search.
GBT_GRID = {"maxBins": [190], "maxDepth": [10]}
GBT_KEYED_GRID = {"maxDepth": [10, 20]}
FOREST_GRID = {"maxBins": [250, 300, 350, 400], "maxDepth": [10, 20, 30]}
GLM_GRID = {
    "regParam": [0.2, 0.3, 0.5, 0.7, 0.9],
    "maxIter": [10, 20, 30],
    "fitIntercept": [True, False],
    "family": ["gaussian", "tweedie", "poisson"],
}


def gbt(**params) -> GBTRegressor:
    return GBTRegressor(seed=SEED, **params)


def forest(**params) -> RandomForestRegressor:
    return RandomForestRegressor(seed=SEED, **params)


def glm(**params) -> GeneralizedLinearRegression:
    """Generalised linear model, with identity link unless told otherwise (None: the family's own)."""
    chosen = {"link": "identity", **params}
    return GeneralizedLinearRegression(**{k: v for k, v in chosen.items() if v is not None})


def param_grid(estimator: Estimator, grid: Mapping[str, Iterable]) -> list[dict]:
    """All combinations of distinct values."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(dict.fromkeys(values)))
    return builder.build()


def rmse_evaluator() -> RegressionEvaluator:
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse")


def cross_validate(
    train: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Iterable],
    folds: int = 3,
    parallelism: int = 2,
    fold_col: str | None = None,
) -> CrossValidatorModel:
    """Grid search by RMSE over random folds, or over the folds of ``fold_col``."""
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=param_grid(estimator, grid),
        evaluator=rmse_evaluator(),
        numFolds=folds,
        seed=SEED,
        parallelism=parallelism,
    )
    if fold_col:
        validator = validator.setFoldCol(fold_col)
    return validator.fit(train)


def grid_metrics(spark: SparkSession, fitted: CrossValidatorModel) -> DataFrame:
    """One row per grid point with its mean RMSE (as many rows as the grid has points)."""
    rows = []
    for number, (point, rmse) in enumerate(zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)):
        text = ", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda i: i[0].name))
        rows.append((number, text, float(rmse)))
    return spark.createDataFrame(rows, "point int, params string, rmse double")


def holdout_metrics(fitted: Model, test: DataFrame) -> DataFrame:
    """RMSE on held-out rows with the parameters of the (best) model, one row."""
    best = getattr(fitted, "bestModel", fitted)
    params = ", ".join(
        f"{p.name}={v}" for p, v in sorted(best.extractParamMap().items(), key=lambda i: i[0].name)
    )
    return rmse_by_key(fitted.transform(test)).withColumn("params", F.lit(params))


def rmse_by_key(df: DataFrame, keys: Sequence[str] = (), label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    error = F.col(prediction) - F.col(label)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


# --- grid search from sums -----------------------------------------------------

def ridge_sums(df: DataFrame, size: int, fold: str = "fold", features: str = "features", label: str = "label") -> DataFrame:
    """Per fold the sums that a least-squares fit needs, in one pass: n, x, xx (upper triangle row by row), xy, y, yy.

    Sums are partial before the shuffle, so a row per fold and task moves, whatever share of the rows a fold has.
    """
    x = [F.get("_x", F.lit(i)) for i in range(size)]
    y = F.col(label).cast("double")
    known = df.select(fold, label, vector_to_array(F.col(features)).alias("_x"))
    return known.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("x"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(size) for j in range(i, size)]).alias("xx"),
        F.array(*[F.sum(v * y) for v in x]).alias("xy"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"))


class _Sums:
    """Sums of some rows as numpy arrays; they add and subtract like the rows they come from."""

    def __init__(self, n, x, xx, xy, y, yy):
        self.parts = (n, x, xx, xy, y, yy)

    @classmethod
    def of(cls, row, size: int) -> _Sums:
        xx = np.zeros((size, size))
        xx[np.triu_indices(size)] = row["xx"]
        return cls(float(row["n"]), np.array(row["x"]), xx + np.triu(xx, 1).T, np.array(row["xy"]), row["y"], row["yy"])

    def __add__(self, other: _Sums) -> _Sums:
        return _Sums(*(a + b for a, b in zip(self.parts, other.parts)))

    def ridge(self, penalty: float, intercept: bool) -> tuple[np.ndarray, float]:
        """Weights and intercept of least squares whose penalty acts on inputs and label scaled to unit deviation."""
        n, x, xx, xy, y, yy = self.parts
        mean, level = x / n, y / n
        spread = np.sqrt(np.maximum(np.diag(xx) / n - mean * mean, 0.0))
        scale = np.sqrt(max(yy / n - level * level, 0.0))
        used = spread > 0
        if not used.any() or scale == 0:
            return np.zeros(len(x)), float(level if intercept else 0.0)
        left, right = xx / n, xy / n
        if intercept:
            left, right = left - np.outer(mean, mean), right - mean * level
        left = left[np.ix_(used, used)] + np.diag(penalty / scale * spread[used] ** 2)
        weights = np.zeros(len(x))
        weights[used] = np.linalg.lstsq(left, right[used], rcond=None)[0]
        return weights, float(level - mean @ weights) if intercept else 0.0

    def rmse(self, weights: np.ndarray, intercept: float) -> float:
        n, x, xx, xy, y, yy = self.parts
        squares = (yy - 2 * (weights @ xy + intercept * y) + weights @ xx @ weights + 2 * intercept * (weights @ x)
                   + n * intercept * intercept)
        return float(np.sqrt(max(squares, 0.0) / n))


def ridge_grid(df: DataFrame, size: int, reg_params: Iterable[float], intercepts: Iterable[bool], fold: str = "fold",
               features: str = "features", label: str = "label") -> DataFrame:
    """Every point of a gaussian, identity-link GLM grid under cross-validation, from one pass over the rows.

    A fold's training sums are the sums of the other folds, so neither points nor folds read the rows again; the
    optimum is that of ``glm(family="gaussian")``, whose maxIter does not matter, as the fit is closed. Only
    one row of sums per fold reaches the driver. Output, one row per point and fold and one per point without a fold, fitted
    on all rows: ``point``, ``reg_param``, ``fit_intercept``, ``fold``, ``n_train``, ``n_test``, ``rmse`` on
    the fold, ``weights``, ``intercept``. Rows without a fold are left out; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = ridge_sums(df.where(F.col(fold).isNotNull()), size, fold, features, label).orderBy(fold).collect()
    sums = {r[fold]: _Sums.of(r, size) for r in rows}
    out = []
    for point, (penalty, intercept) in enumerate(product(dict.fromkeys(reg_params), dict.fromkeys(intercepts))):
        for held in ([*sums, None] if sums else []):
            train = [s for k, s in sums.items() if held is None or k != held]
            if not train:
                continue
            whole = train[0]
            for more in train[1:]:
                whole = whole + more
            weights, level = whole.ridge(penalty, intercept)
            test = sums.get(held) if held is not None else None
            out.append((point, float(penalty), bool(intercept), held, int(whole.parts[0]), int(test.parts[0]) if test else 0,
                        test.rmse(weights, level) if test else None, weights.tolist(), level))
    return spark.createDataFrame(out, "point int, reg_param double, fit_intercept boolean, fold int, n_train bigint, "
                                      "n_test bigint, rmse double, weights array<double>, intercept double")


def best_point(grid: DataFrame) -> DataFrame:
    """The point of least mean RMSE over its folds (ties: the first), fitted on all rows: one row of ``ridge_grid``."""
    means = grid.where("fold IS NOT NULL").groupBy("point").agg(F.avg("rmse").alias("mean_rmse"))
    chosen = means.agg(F.min_by("point", F.struct("mean_rmse", "point")).alias("point"), F.min("mean_rmse").alias("mean_rmse"))
    return grid.where("fold IS NULL").join(chosen, "point")


def score_linear(weights: Column, intercept: Column, features: str = "features") -> Column:
    """Prediction of a linear model whose weights are an array column."""
    terms = F.zip_with(vector_to_array(F.col(features)), weights, lambda x, w: x * w)
    return F.aggregate(terms, intercept, lambda total, t: total + t)


# --- storage -------------------------------------------------------------------

def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def fit_if_absent(spark: SparkSession, path: str, loader: type, fit: Callable[[], Model]) -> Model:
    """Load a stored model, or fit and store it."""
    if not path_exists(spark, f"{path}/metadata"):
        save_model(fit(), path)
    return loader.load(path)


# --- one model per key -----------------------------------------------------------

def fit_listed_keys(
    train: DataFrame,
    key: str,
    values: Sequence,
    estimator: Callable[[], Estimator],
    grid: Mapping[str, Iterable],
    folder: str,
    threads: int = 4,
    folds: int = 3,
) -> dict:
    """Cross-validated ML model for each listed key value, stored below ``folder``.

    Fits run as concurrent Spark jobs; keys with a stored model are skipped. For
    every key of a large table use ``ridge_per_key``.
    """
    spark = train.sparkSession

    def one(value):
        path = f"{folder}/{key}_{value}"
        rows = train.where(F.col(key).eqNullSafe(F.lit(value)))
        return value, fit_if_absent(
            spark, path, CrossValidatorModel, lambda: cross_validate(rows, estimator(), grid, folds)
        )

    with ThreadPoolExecutor(threads) as pool:
        return dict(pool.map(one, values))


def ridge_per_key(
    df: DataFrame, keys: Sequence[str], metric: str, horizon: int, penalty: float = 1e-6
) -> DataFrame:
    """Least-squares weights of the lags 1..H for every key at once.

    The normal equations are sums of products, so they are aggregated by Spark
    with partial sums; only one small square system per key reaches Python.
    Output: keys, ``weights`` array<double> (lag 1 first), ``intercept``, ``n``.
    """
    inputs = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)).cast("double") for c in lag_names(metric, horizon)]]
    label = F.col(metric).cast("double")
    size = horizon + 1
    upper = [(i, j) for i, j in product(range(size), repeat=2) if i <= j]
    sums = df.groupBy(*keys).agg(
        F.array(*[F.sum(inputs[i] * inputs[j]) for i, j in upper]).alias("xx"),
        F.array(*[F.sum(x * label) for x in inputs]).alias("xy"),
    )

    sums = sums.withColumn("n", F.get("xx", F.lit(0)).cast("bigint"))
    scaled = [0.0] + [penalty] * horizon
    solved = solve_normal_equations(sums.withColumn("yy", F.lit(0.0)), scaled, by_count=True)
    split = F.slice("weights", 2, horizon).alias("weights"), F.get("weights", F.lit(0)).alias("intercept")
    return solved.select(*keys, *split, "n")


def solve_normal_equations(sums: DataFrame, ridge: Sequence[float], by_count: bool = False) -> DataFrame:
    """Add ``weights`` and ``sd`` to rows that hold the sums of a least-squares fit.

    ``xx`` is the upper triangle of the inputs' products row by row, ``xy`` the products with the label, ``yy``
    the label's squares, ``n`` the rows. ``ridge`` is added to the diagonal, times n with ``by_count``. ``sd`` is
    the population standard deviation of the residuals.
    """
    size = len(ridge)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    kept = [f for f in sums.schema if f.name not in ("xx", "xy", "yy")]

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            out = batch[[f.name for f in kept]].copy()
            weights, spread = [], []
            for xx, xy, yy, n in zip(batch["xx"], batch["xy"], batch["yy"], batch["n"]):
                matrix = np.zeros((size, size))
                for (i, j), v in zip(upper, xx):
                    matrix[i, j] = matrix[j, i] = v
                damped = matrix + np.diag(np.array(ridge) * (max(n, 1.0) if by_count else 1.0))
                label = np.asarray(xy, float)
                w = np.linalg.lstsq(damped, label, rcond=None)[0]
                weights.append(w)
                squares = max(float(yy) - 2 * w @ label + w @ matrix @ w, 0.0) / max(n, 1)
                mean = (label[0] - matrix[0] @ w) / max(n, 1)
                spread.append(float(np.sqrt(max(squares - mean * mean, 0.0))))
            out["weights"], out["sd"] = weights, spread
            yield out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return sums.mapInPandas(solve, f"{ddl}, weights array<double>, sd double")


def trend_per_key(
    df: DataFrame, keys: Sequence[str], metric: str, date: str = "Date", extra: Sequence[Column] = ()
) -> DataFrame:
    """Least-squares line of a metric over the day number, per key.

    ``sd`` is the population standard deviation of the residuals; ``extra`` adds
    aggregates of the same groups.
    """
    x, y = F.unix_date(F.col(date)).cast("double"), F.col(metric).cast("double")
    return (
        df.where(F.col(metric).isNotNull())
        .groupBy(*keys)
        .agg(
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_syy(y, x).alias("_syy"),
            F.regr_sxy(y, x).alias("_sxy"),
            F.count(F.lit(1)).alias("n"),
            F.min(date).alias("first_day"),
            F.max(date).alias("last_day"),
            *extra,
        )
        .withColumn("sd", F.sqrt(F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0)) / F.col("n")))
        .drop("_syy", "_sxy")
    )
