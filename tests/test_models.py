import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dayloom.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for k in range(400):
        x = [float(v) for v in rng.normal([5, -2, 0], [1, 3, 10])]
        data.append((k % 3, [*x, 7.0], float(2 * x[0] - x[1] + 0.3 * x[2] + rng.normal() + 4)))
    frame = spark.createDataFrame(data, "fold int, x array<double>, label double")
    return frame.select("fold", array_to_vector("x").alias("features"), "label").cache()


def test_grid_from_sums_equals_the_fits(rows):
    grid = models.ridge_grid(rows, 4, [0.2, 0.9], [True, False]).collect()
    assert len(grid) == 2 * 2 * 4
    for r in grid:
        if r["fold"] in (0, None):
            train = rows.where(F.col("fold") != r["fold"]) if r["fold"] is not None else rows
            fitted = models.glm(family="gaussian", regParam=r["reg_param"], fitIntercept=r["fit_intercept"]).fit(train)
            assert r["n_train"] == train.count()
            # The constant input carries nothing where there is an intercept.
            if r["fit_intercept"]:
                assert np.allclose(fitted.coefficients.toArray()[:3], r["weights"][:3], rtol=1e-6, atol=1e-9)
                assert abs(fitted.intercept + 7 * fitted.coefficients[3] - r["intercept"]) < 1e-6
        if r["fold"] == 0 and r["fit_intercept"]:
            test = fitted.transform(rows.where("fold = 0"))
            assert abs(models.rmse_by_key(test).first()["rmse"] - r["rmse"]) < 1e-6


def test_chosen_point_has_the_least_error(rows):
    grid = models.ridge_grid(rows, 4, [0.2, 0.5, 0.9], [True, False])
    means = {}
    for r in grid.where("fold IS NOT NULL").collect():
        means.setdefault(r["point"], []).append(r["rmse"])
    best = models.best_point(grid).collect()
    assert len(best) == 1 and best[0]["fold"] is None
    assert best[0]["point"] == min(means, key=lambda p: (np.mean(means[p]), p))


def test_grid_of_odd_tables(spark, rows):
    assert models.ridge_grid(rows.limit(0), 4, [0.2], [True]).count() == 0
    one = models.ridge_grid(rows.where("fold = 1"), 4, [0.2], [True]).collect()
    assert [r["fold"] for r in one] == [None]
    flat = spark.createDataFrame([(k % 2, [1.0], 3.0) for k in range(6)], "fold int, x array<double>, label double")
    flat = flat.select("fold", array_to_vector("x").alias("features"), "label")
    got = models.ridge_grid(flat, 1, [0.2], [True, False]).where("fold IS NULL").orderBy("fit_intercept").collect()
    assert [(r["weights"], r["intercept"]) for r in got] == [([0.0], 0.0), ([0.0], 3.0)]
