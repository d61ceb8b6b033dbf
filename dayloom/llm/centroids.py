"""Centroid clustering of embeddings in exact integers, by column expressions only.

Components become integers, so that every distance, sum and mean is exact and a run gives the
same clusters however its rows are dealt. A round is one aggregate over the stored vectors:
``zip_with`` and ``aggregate`` give the squared distance to each centroid, a literal array in the
plan; ``array_min`` of (distance, number) picks the nearest, the smaller number on ties; one sum
per component and cluster, partial in every task, brings ``k`` rows back, from which the next
literals are made. No vector leaves the JVM and none is shuffled.

Vectors that are null, have another length than ``size`` or hold a null, NaN or infinite
component are dropped. Rows of equal vectors or equal ids count one by one. A null id gives no
first centroid but takes part otherwise; where fewer than ``k`` vectors can be first centroids,
there are fewer clusters, and none and no rows where there is no such vector. Components beyond
2^58 are held there. Numbers that do not fit a long are null in the result. Columns
other than the two named are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch

#: Integers up to here can be squared and summed as decimals of 38 digits.
LARGEST = 1 << 58


def integer_vectors(vectors: DataFrame, size: int, scale: int, id_column: str, column: str) -> DataFrame:
    """The vectors that qualify, as (vec_id, x array<bigint>) with x = floor(scale * component)."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(column, lambda c: F.floor(F.least(F.greatest(
        F.lit(float(scale)) * c.cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("bigint"))
    kept = vectors.filter((F.size(column) == size) & ~bad)
    return kept.select(F.col(id_column).alias("vec_id"), whole.alias("x"))


def first_centroids(stored: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest sha256 of "salt:id", in that order."""
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = stored.filter("vec_id is not null").select(draw.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [list(r["x"]) for r in rows]


def nearest(centroids: list[list[int]], number: str) -> Column:
    """(d, cluster) of the nearest centroid of ``x``: squared distance, and the smallest number that has it.

    Built as one SQL text, since a call for each of the literals would take longer than the round.
    """
    x = "x" if number == "bigint" else f"cast(x as array<{number}>)"
    squares = f"(a, b) -> cast((a - b) * (a - b) as {number})"
    total = f"cast(0 as {number}), (t, s) -> cast(t + s as {number})"
    each = (f"named_struct('d', aggregate(zip_with({x}, cast(array({', '.join(f'{v}L' for v in c)}) as array<{number}>), "
            f"{squares}), {total}), 'cluster', {i})" for i, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(each)}))")


def number_type(stored: DataFrame, size: int) -> str:
    """bigint where no distance and no sum can leave it, else decimals."""
    top = stored.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))), F.count(F.lit(1))).first()
    largest, rows = int(top[0] or 0), int(top[1])
    return "bigint" if 4 * size * largest**2 < 1 << 63 and rows * largest < 1 << 63 else "decimal(38,0)"


def updated(stored: DataFrame, centroids: list[list[int]], number: str) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; an empty cluster keeps its centroid."""
    sums = ", ".join(f"sum(cast(get(x, {i}) as {number})) as s{i}" for i in range(len(centroids[0])))
    assigned = stored.select("x", nearest(centroids, number)["cluster"].alias("cluster"))
    rows = stored.sparkSession.sql(f"SELECT cluster, count(*) AS n, {sums} FROM {{assigned}} GROUP BY cluster", assigned=assigned)
    found = {r["cluster"]: r for r in rows.collect()}
    return [[int(found[i][f"s{j}"]) // found[i]["n"] for j in range(len(c))] if i in found else c
            for i, c in enumerate(centroids)]


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: int = 3,
             id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``rounds`` rounds of assignment and update, then one more assignment. Intermediate tables stay below the
    scratch folder until ``clear_scratch``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    stored = scratch.store(integer_vectors(vectors, size, scale, id_column, column), "vectors")
    kind = stored.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(stored, k, salt)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    number = number_type(stored, size)
    for _ in range(rounds):
        centroids = updated(stored, centroids, number)
    assigned = scratch.store(stored.select("vec_id", nearest(centroids, number).alias("near")).select(
        "vec_id", F.col("near.cluster").alias("cluster"), F.col("near.d").alias("d")), "assigned")
    scratch.drop("vectors")
    totals = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(
        F.try_sum(F.col("d").cast("decimal(38,0)")).alias("s")).collect()}
    known = [v for v in totals.values() if v is not None]
    whole = int(sum(known)) if len(known) == len(totals) else None
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    facts = spark.createDataFrame(
        [(i, fits(totals[i]), fits(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for i, c in enumerate(centroids) if i in totals],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid, all of them literals of the plan already.
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", F.expr("try_cast(d as bigint)").alias("distance"), "cluster_inertia", "inertia",
        "centroid_sha256")
