"""Tree ensembles as column expressions, and boosted trees for every key in one plan.

An ensemble is an array of (weight ``w``, nodes ``n``), a node ``f`` (feature), ``c`` (cut, or the categories
that go left), ``k`` (number of categories, negative for a cut), ``l`` and ``r`` (places of its children, negative for a leaf) and ``v`` (value).
A value goes left where it is at most the cut; null and NaN go right.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.operators.joins import null_safe_join
from dayloom.session import delete_path, materialise, scratch_path

NODE = "struct<f:int,c:array<double>,k:int,l:int,r:int,v:double>"
ENSEMBLE = f"array<struct<w:double,n:array<{NODE}>>>"


def is_tree_model(model: Model) -> bool:
    model = getattr(model, "bestModel", model)
    return isinstance(model, (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _leaf_value(nodes: Column, features: Column, depth: int) -> Column:
    def step(place: Column, _: Column) -> Column:
        def down(node: Column) -> Column:
            x = F.get(features, node["f"])
            left = F.when(node["k"] < 0, x <= F.get(node["c"], F.lit(0))).otherwise(F.array_contains(node["c"], x))
            return F.when(node["l"] < 0, place).when(left, node["l"]).otherwise(node["r"])

        return _bound(F.get(nodes, place), down)

    return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step))["v"]


def score_trees(trees: Column, features: Column, depth: int) -> Column:
    """Weighted sum of the trees' leaf values; ``features`` is an array of doubles, ``depth`` that of the deepest tree."""
    def total(x: Column) -> Column:
        return F.aggregate(trees, F.lit(0.0), lambda t, tree: t + tree["w"] * _leaf_value(tree["n"], x, depth))

    return _bound(features, total)


@dataclass(frozen=True)
class CompiledTrees:
    """A fitted Spark ML tree model as one expression."""

    text: str
    depth: int
    divisor: float

    def score(self, features: Column) -> Column:
        # The text is a constant, which the optimiser parses once.
        return score_trees(F.from_json(F.lit(self.text), ENSEMBLE), features, self.depth) / F.lit(self.divisor)

    def scorer(self, codes: Sequence[str] = ()) -> Callable[[Column], Column]:
        """Scorer of ``recursive_forecast`` over code columns and the newest-first past values."""
        code_values = [F.col(c).cast("double") for c in codes]
        return lambda past: self.score(F.concat(F.array(*code_values), past) if code_values else past)


def compile_trees(model: Model) -> CompiledTrees:
    """The expression of a fitted decision tree, forest or boosted ensemble (or of the best model of a search).

    The nodes come from the stored form of the model. They pass through the driver, which holds the fitted model
    anyway: their number is bounded by the model's trees and depth, not by the data.
    """
    model = getattr(model, "bestModel", model)
    if not is_tree_model(model):
        raise TypeError(f"no tree regressor: {type(model).__name__}")
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" not in stored.columns:
        stored = stored.select(F.lit(0).alias("treeID"), F.struct(*stored.columns).alias("nodeData"))
    node = stored.select("treeID", "nodeData.*").select(
        "treeID", "id", F.struct(
            F.col("split.featureIndex").alias("f"), F.col("split.leftCategoriesOrThreshold").alias("c"),
            F.col("split.numCategories").alias("k"), F.col("leftChild").alias("l"), F.col("rightChild").alias("r"),
            F.col("prediction").alias("v")).alias("node"))
    per_tree = node.groupBy("treeID").agg(F.array_sort(F.collect_list(F.struct("id", "node"))).alias("n"))
    texts = per_tree.orderBy("treeID").select(F.to_json(F.col("n.node")).alias("n")).collect()
    delete_path(spark, path)
    trees = [json.loads(r["n"]) for r in texts]
    weights = getattr(model, "treeWeights", [1.0])
    divisor = float(len(trees)) if isinstance(model, RandomForestRegressionModel) else 1.0
    text = json.dumps([{"w": float(w), "n": nodes} for w, nodes in zip(weights, trees)])
    return CompiledTrees(text, max(_depth(nodes) for nodes in trees), divisor)


def _depth(nodes: Sequence[dict]) -> int:
    """Levels below the root; children stand after their parents."""
    level = [0] * len(nodes)
    for place, node in enumerate(nodes):
        if node["l"] >= 0:
            level[node["l"]] = level[node["r"]] = level[place] + 1
    return max(level)


# --- boosted trees for every key ------------------------------------------------------------------


def _key_cuts(rows: DataFrame, keys: Sequence[str], bins: int, cuts: str) -> DataFrame:
    """Per key the rising cuts of every feature: keys, ``_cuts`` array<array<double>>.

    The last is the greatest value, which parts the values from those that are missing.
    """
    long = rows.select(*keys, F.posexplode("_x").alias("_f", "_v"))
    value = F.when(~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf"))), F.col("_v"))
    if cuts == "width":
        low, high = F.min(value), F.max(value)
        span = F.col("_hi") - F.col("_lo")
        inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda b: F.col("_lo") + b * span / F.lit(bins))
        per = long.groupBy(*keys, "_f").agg(low.alias("_lo"), high.alias("_hi")).withColumn("_c", F.concat(inner, F.array("_hi")))
    else:
        shares = [b / bins for b in range(1, bins + 1)]
        per = long.groupBy(*keys, "_f").agg(F.percentile_approx(value, shares, 100 * bins).alias("_c"))
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce("_c", F.array().cast("array<double>")), lambda c: c.isNotNull())))
    per = per.select(*keys, F.struct("_f", clean.alias("_c")).alias("_fc"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list("_fc")).alias("_s")).select(*keys, F.col("_s._c").alias("_cuts"))


def _best_splits(rows: DataFrame, keys: Sequence[str], level: int, min_rows: int) -> DataFrame:
    """Per key and open node of a level: rows ``_n``, sum ``_s`` and the best split ``_split`` (null where none gains).

    One aggregate over (key, node, feature, bin), partial before the shuffle: a key of any size sends at most
    one row per node, feature and bin from each task.
    """
    node = [*keys, "_node"]
    open_rows = rows.where(F.col("_node") >= 2 ** level - 1)
    bins = open_rows.select(*node, "_r", F.posexplode("_bins").alias("_f", "_b"))
    sums = bins.groupBy(*node, "_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_s"))
    whole = Window.partitionBy(*node, "_f")
    below = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*node, "_f", "_b", F.sum("_n").over(below).alias("_nl"), F.sum("_s").over(below).alias("_sl"),
                       F.sum("_n").over(whole).alias("_nt"), F.sum("_s").over(whole).alias("_st"))
    more, rest = F.col("_nt") - F.col("_nl"), F.col("_st") - F.col("_sl")
    gain = F.col("_sl") * F.col("_sl") / F.col("_nl") + F.try_divide(rest * rest, more)
    valid = (F.col("_nl") >= min_rows) & (more >= min_rows) & (gain > F.col("_st") * F.col("_st") / F.col("_nt"))
    return sums.groupBy(*node).agg(
        F.max("_nt").alias("_n"), F.min_by("_st", F.struct("_f", "_b")).alias("_s"),
        F.max_by(F.struct("_f", "_b", "_nl", "_sl"), F.when(valid, F.struct(gain, -F.col("_f"), -F.col("_b")))).alias("_split"))


def _descend(rows: DataFrame, splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows moved to the children of the nodes that were split."""
    joined = null_safe_join(rows, splits.select(*keys, "_node", "_split"), [*keys, "_node"], "left")
    left = F.get("_bins", F.col("_split._f")) <= F.col("_split._b")
    child = F.when(left, 2 * F.col("_node") + 1).otherwise(2 * F.col("_node") + 2)
    return joined.withColumn("_node", F.when(F.col("_split").isNull(), F.col("_node")).otherwise(child)).drop("_split")


def _tree_nodes(levels: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All nodes of a tree from its levels' splits: keys, ``_node``, ``_v``, ``_n``, ``_split``."""
    inner = [f.select(*keys, "_node", (F.col("_s") / F.col("_n")).alias("_v"), "_n", "_split") for f in levels]
    last, split = levels[-1].where("_split IS NOT NULL"), F.col("_split")
    sides = [(1, split["_nl"], split["_sl"]), (2, F.col("_n") - split["_nl"], F.col("_s") - split["_sl"])]
    leaves = [last.select(*keys, (2 * F.col("_node") + side).alias("_node"), (s / n).alias("_v"), n.alias("_n"),
                          F.lit(None).cast(last.schema["_split"].dataType).alias("_split")) for side, n, s in sides]
    return reduce(DataFrame.unionByName, [*inner, *leaves])


def boost_per_key(df: DataFrame, keys: Sequence[str], features: str = "features", label: str = "label", trees: int = 10,
                  depth: int = 3, step: float = 0.1, bins: int = 32, cuts: str = "quantile", min_rows: int = 1) -> DataFrame:
    """Boosted regression trees (squared error) for every key at once: keys, ``n``, ``trees`` for ``score_trees``.

    Each level of each tree is one aggregate for all keys, so the number of jobs is trees x (depth + 1) whatever the number
    of keys. ``features`` is an array of doubles. The first tree fits the label, later ones the residuals, weighted by
    ``step``. Cuts are the key's own: ``"quantile"`` (approximate) or ``"width"`` (equal spans). Of equal gains the
    smaller feature, then the smaller cut is taken. Rows without a label are left out; null keys are a key; a null or NaN value
    goes right; a key whose features are constant gets the mean. An empty table gives an empty result. Levels join the rows with a
    table of one row per key and node, which is broadcast only below the session's threshold and else split by
    adaptive execution where a key is hot. Intermediate tables stay until ``clear_scratch``.
    """
    if trees < 1 or depth < 1 or bins < 2:
        raise ValueError("trees and depth must be 1 or more, bins 2 or more")
    if cuts not in ("quantile", "width"):
        raise ValueError(f"unknown cuts: {cuts}")
    inputs = F.transform(F.col(features), lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    known = df.where(F.col(label).isNotNull()).select(*keys, inputs.alias("_x"), F.col(label).cast("double").alias("_r"))
    key_cuts = materialise(_key_cuts(known, keys, bins, cuts), "tree-cuts")
    places = F.zip_with("_x", "_cuts", lambda x, edges: F.size(F.filter(edges, lambda c: c < x)))
    rows = null_safe_join(known, key_cuts, keys).select(*keys, "_r", places.alias("_bins"))
    rows = materialise(rows, "tree-rows")
    grown = []
    for tree in range(trees):
        at, levels = rows.withColumn("_node", F.lit(0)), []
        for level in range(depth):
            levels.append(materialise(_best_splits(at, keys, level, min_rows), "tree-level"))
            at = _descend(at, levels[-1], keys)
        weight = 1.0 if tree == 0 else step
        nodes = _tree_nodes(levels, keys)
        grown.append(nodes.withColumns({"_tree": F.lit(tree), "_w": F.lit(weight)}))
        if tree + 1 < trees:
            left = F.col("_r") - F.lit(weight) * F.col("_v")
            at = null_safe_join(at, nodes.select(*keys, "_node", "_v"), [*keys, "_node"])
            rows = materialise(at.select(*keys, left.alias("_r"), "_bins"), "tree-rows")
    return _ensembles(reduce(DataFrame.unionByName, grown), key_cuts, keys, depth)


def _ensembles(nodes: DataFrame, key_cuts: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    split = F.col("_split")
    cut = F.get(F.get("_cuts", split["_f"]), split["_b"])
    is_leaf = split.isNull()
    node = F.struct(
        F.when(is_leaf, -1).otherwise(split["_f"]).alias("f"), F.when(~is_leaf, F.array(cut)).alias("c"), F.lit(-1).alias("k"),
        F.when(is_leaf, -1).otherwise(2 * F.col("_node") + 1).alias("l"),
        F.when(is_leaf, -1).otherwise(2 * F.col("_node") + 2).alias("r"), F.col("_v").alias("v"))
    placed = null_safe_join(nodes, key_cuts, keys).select(*keys, "_tree", "_w", "_n", "_node", node.alias("_nd"))
    # At most 2^(depth + 1) - 1 nodes a tree.
    per_tree = placed.groupBy(*keys, "_tree", "_w").agg(
        F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_node", "_nd"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(2 ** (depth + 1) - 2)), lambda i: F.try_element_at("_m", i))
    whole = per_tree.select(*keys, "_n", F.struct("_tree", F.struct(F.col("_w").alias("w"), dense.alias("n")).alias("t")).alias("_t"))
    return whole.groupBy(*keys).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list("_t")).alias("_t")).select(
        *keys, "n", F.col("_t.t").alias("trees"))
