import math
import random

import pytest
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from dayloom.operators import forecast, models, trees
from dayloom.session import materialise

SCHEMA = "k string, id int, features array<double>, label double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        x = [float(rng.randrange(6)), rng.uniform(-3, 3), rng.uniform(0, 100)]
        key = ("a", "b", None)[i % 3]
        data.append((key, i, x, float(round(3 * x[0] - x[1] * x[1] + (x[2] > 40) * 9 + rng.random(), 2))))
    return materialise(spark.createDataFrame(data, SCHEMA), "rows")


@pytest.mark.parametrize("estimator", [
    lambda: models.gbt(maxIter=8, maxDepth=5), lambda: models.forest(numTrees=7, maxDepth=6),
    lambda: DecisionTreeRegressor(maxDepth=4), lambda: DecisionTreeRegressor(maxDepth=0)], ids=["boosted", "forest", "tree", "root"])
def test_compiled_scores_equal_transform(rows, estimator):
    vectors = rows.select("id", "label", array_to_vector("features").alias("features"))
    fitted = estimator().fit(vectors)
    again = trees.compile_trees(fitted).score(vector_to_array("features"))
    both = fitted.transform(vectors).withColumn("again", again)
    assert both.where(F.abs(F.col("again") - F.col("prediction")) > 1e-9).isEmpty()
    assert both.where("again IS NULL").isEmpty()
    assert "from_json" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_compiled_categories(rows):
    vectors = rows.select("id", "label", array_to_vector("features").alias("raw"))
    indexed = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=8).fit(vectors).transform(vectors)
    fitted = models.gbt(maxIter=4, maxDepth=4).fit(indexed)
    both = fitted.transform(indexed).withColumn("again", trees.compile_trees(fitted).score(vector_to_array("features")))
    assert both.where(F.abs(F.col("again") - F.col("prediction")) > 1e-9).isEmpty()


def test_only_tree_models_compile(rows):
    fitted = LinearRegression().fit(rows.select("label", array_to_vector("features").alias("features")))
    with pytest.raises(TypeError):
        trees.compile_trees(fitted)


def test_recursion_compiled_and_by_steps(spark, rows):
    history = spark.createDataFrame(
        [(k, float(c), f"2020-01-{d:02d}", (d * 7 + c * 3) % 11) for c, k in enumerate("xyz") for d in range(1, 29)],
        "k string, c double, d string, v int").select("k", "c", F.to_date("d").alias("Date"), "v")
    fitted = models.gbt(maxIter=5, maxDepth=4).fit(rows.select(
        "label", array_to_vector(F.concat("features", F.slice("features", 1, 1))).alias("features")))
    runs = [forecast.recursive_forecast(history, ["k", "c"], "v", 3, 12, fitted, codes=["c"], compiled=c, store_every=5)
            for c in (True, False)]
    both = runs[0].join(runs[1].withColumnRenamed("v", "w"), ["k", "c", "Date"])
    assert both.count() == 36
    assert both.where(F.abs(F.col("v") - F.col("w")) > 1e-9).isEmpty()


def brute(rows, count, depth, step, bins):
    """Boosted trees of one key by plain loops: a function from features to the score."""
    size = len(rows[0][0])
    cuts = []
    for f in range(size):
        values = [x[f] for x, _ in rows]
        lo, hi = min(values), max(values)
        cuts.append(sorted({lo + b * (hi - lo) / bins for b in range(1, bins)}))

    def grow(part, level):
        value = sum(y for _, y in part) / len(part)
        best = None
        if level < depth:
            for f in range(size):
                for c in cuts[f]:
                    left = [y for x, y in part if x[f] <= c]
                    right = [y for x, y in part if not x[f] <= c]
                    if left and right:
                        gain = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right)
                        if gain > sum(y for _, y in part) ** 2 / len(part) + 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, c
        if best is None:
            return value
        _, f, c = best
        return f, c, grow([p for p in part if p[0][f] <= c], level + 1), grow([p for p in part if not p[0][f] <= c], level + 1)

    def score(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    grown, left = [], list(rows)
    for t in range(count):
        weight = 1.0 if t == 0 else step
        tree = grow(left, 0)
        grown.append((weight, tree))
        left = [(x, y - weight * score(tree, x)) for x, y in left]
    return lambda x: sum(w * score(tree, x) for w, tree in grown)


def test_trees_per_key_equal_plain_loops(rows):
    fits = trees.boost_per_key(rows, ["k"], trees=3, depth=3, step=0.5, bins=8, cuts="width")
    fits = materialise(fits, "fits")
    assert {(r["k"], r["n"]) for r in fits.collect()} == {("a", 200), ("b", 200), (None, 200)}
    scored = rows.join(fits.withColumnRenamed("k", "q"), F.col("k").eqNullSafe(F.col("q"))).withColumn(
        "score", trees.score_trees(F.col("trees"), F.col("features"), 3)).collect()
    for key in ("a", "b", None):
        mine = [r for r in scored if r["k"] == key]
        plain = brute([(r["features"], r["label"]) for r in mine], 3, 3, 0.5, 8)
        assert all(math.isclose(r["score"], plain(r["features"]), abs_tol=1e-8) for r in mine)


def test_trees_per_key_edge_cases(spark):
    nan = float("nan")
    data = [("const", 1, [1.0, 1.0], 4.0), ("const", 2, [1.0, 1.0], 6.0), ("one", 3, [2.0, 5.0], 7.0),
            ("gaps", 4, [None, 1.0], 10.0), ("gaps", 5, [nan, 2.0], 10.0), ("gaps", 6, [0.0, 1.0], 0.0),
            ("gaps", 7, [1.0, 2.0], 0.0), ("gaps", 8, [0.5, 1.5], None), ("void", 9, [None, None], 3.0),
            ("tie", 10, [0.0, 0.0], 0.0), ("tie", 11, [1.0, 1.0], 1.0), ("tie", 11, [1.0, 1.0], 1.0)]
    frame = spark.createDataFrame(data, SCHEMA)
    for cuts in ("width", "quantile"):
        fits = materialise(trees.boost_per_key(frame, ["k"], trees=2, depth=2, step=1.0, bins=4, cuts=cuts), "fits")
        scores = frame.join(fits, "k").select("id", trees.score_trees(F.col("trees"), F.col("features"), 2).alias("s"))
        got = {r["id"]: round(r["s"], 9) for r in scores.collect()}
        assert (got[1], got[2], got[3], got[9]) == (5.0, 5.0, 7.0, 3.0)
        assert (got[10], got[11]) == (0.0, 1.0)
        assert fits.where("k = 'tie'").first()["trees"][0]["n"][0]["f"] == 0
        if cuts == "width":
            assert (got[4], got[5], got[6], got[7]) == (10.0, 10.0, 0.0, 0.0)
    assert trees.boost_per_key(frame.limit(0), ["k"], trees=1, depth=1).isEmpty()
    for wrong in ({"trees": 0}, {"bins": 1}, {"cuts": "other"}):
        with pytest.raises(ValueError):
            trees.boost_per_key(frame, ["k"], **wrong)


def test_levels_send_partial_sums(spark, rows):
    at = rows.select("k", F.col("label").alias("_r"), F.array(F.lit(0), F.lit(1)).alias("_bins"), F.lit(0).alias("_node"))
    text = trees._best_splits(at, ["k"], 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_sum(_r") > text.index("Window")
