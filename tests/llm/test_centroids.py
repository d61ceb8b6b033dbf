"""Centroid clustering against plain integers, and rows that are out of the ordinary."""

import hashlib
import math
import random
from collections import Counter

from dayloom.llm import centroids

DDL = "vec_id bigint, embedding array<float>, label int, x string, d double, cluster string"


def brute(rows, k, rounds, size, scale, salt):
    """Clusters of (vec_id, vector) rows in Python integers."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    middles = [x for _, x in first[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(middles)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                middles[j] = [sum(c) // len(own) for c in zip(*own)]
    if not middles:
        return Counter()
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(d for _, _, d in found)
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return Counter((i, j, d, inertia[j], total, sha[j]) for i, j, d in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 0.5, "c") for i, v in rows], DDL)


def agreed(spark, rows, k=8, rounds=10, size=64, scale=1024, salt=3):
    got = centroids.clusters(frame(spark, rows), k, rounds, size, scale, salt)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, k, rounds, size, scale, salt)


def vectors(spark, seed, n, size):
    """Floats of single precision, as the table holds them."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(size)]) for i in range(n)]
    return [(r["vec_id"], r["embedding"]) for r in frame(spark, rows).collect()]


def test_equal_to_brute_force(spark):
    agreed(spark, vectors(spark, 1, 300, 64))


def test_small_vectors_with_ties_and_copies(spark):
    """Coordinates of few values: many equal distances, equal first centroids and empty clusters."""
    rng = random.Random(2)
    rows = [(i // 2, [float(rng.randrange(2)) for _ in range(3)]) for i in range(60)]
    agreed(spark, rows, k=6, rounds=4, size=3, scale=1)
    agreed(spark, rows + [(100 + i, [0.0, 1.0, 0.0]) for i in range(40)], k=9, rounds=3, size=3, scale=1)


def test_rows_that_do_not_qualify(spark):
    good = vectors(spark, 3, 12, 4)
    bad = [(90, None), (91, []), (92, [1.0, 2.0, 3.0]), (93, [1.0, None, 2.0, 3.0]), (94, [float("nan")] * 4),
           (95, [float("inf"), 0.0, 0.0, 0.0]), (96, [0.0] * 5), (97, [float("-inf")] * 4)]
    agreed(spark, good + bad + [(None, [0.25, -0.5, 0.0, -0.0]), (None, [0.25, -0.5, 0.0, -0.0]), good[0]], size=4)


def test_fewer_vectors_than_clusters_and_none(spark):
    agreed(spark, vectors(spark, 4, 3, 64))
    agreed(spark, [])
    assert centroids.clusters(frame(spark, [(1, None), (None, [0.0] * 64)])).count() == 0


def test_numbers_beyond_a_long(spark):
    """Distances that no long holds are null; the clusters stay those of exact arithmetic."""
    rows = [(i, [c, 0.0]) for i, c in enumerate((0.0, 1.0, 2.0, 3.0e8, 3.1e8, 3.0e12, 1e30, -1e30))]
    got = {r["vec_id"]: r for r in centroids.clusters(frame(spark, rows), 2, 3, 2).collect()}
    assert len(got) == 8 and got[6]["cluster"] != got[7]["cluster"]
    assert all(r["inertia"] is None for r in got.values())
    medium = [(r["vec_id"], r["embedding"]) for r in frame(spark, [(i, [i * 1e6, 7.0]) for i in range(9)]).collect()]
    assert centroids.number_type(centroids.integer_vectors(frame(spark, medium), 2, 1024, "vec_id", "embedding"), 2) != "bigint"
    agreed(spark, medium, 3, 4, 2)


def test_a_round_is_one_aggregate_without_python(spark):
    stored = centroids.integer_vectors(frame(spark, vectors(spark, 5, 20, 64)), 64, 1024, "vec_id", "embedding")
    plan = stored.select(centroids.nearest([[0] * 64, [1] * 64], "bigint").alias("near"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan
