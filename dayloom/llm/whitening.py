"""Whitening of embeddings on their leading components, without ever forming the covariance.

The vectors become integers, each distinct one is stored once (the fit list), and the covariance is known
by its products only: a pass over the fit list centres every vector, multiplies and sums within tasks, and
brings back one number per dimension and column. ``eigen.largest`` (Jacobi-Davidson: correction equations
solved by MINRES, Rayleigh-Ritz in a subspace, locking at double precision) asks for those products. What the
driver holds is of the vectors' dimension, never of their number.

Sums are exact integers; centring subtracts the mean's whole part exactly before its fraction, so a mean that is large
beside the spread costs no digits. Vectors that are null or hold a null, NaN or infinite entry are dropped, and so are
those of another length than ``size`` (by default the length that most of the others have, the smaller on ties) and of
length 0. Repeated rows and ids, and null ids, are returned row by row. Components whose eigenvalue is 0 to double
precision cannot be scaled to 1 and are not returned: fewer distinct vectors than components + 1, or constant entries, give
fewer components, one distinct vector and empty tables no rows. Entries beyond 2^52 are held there. A ``deviation`` that no
long holds is null. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dayloom.llm import eigen
from dayloom.llm.common import Scratch, map_arrow, struct

#: Whole numbers up to here are doubles too.
LARGEST = 1 << 52
LONG = 1 << 63


@dataclass(frozen=True)
class Centre:
    """n distinct vectors, their exact sums, and the mean as a whole part and a fraction."""

    n: int
    sums: tuple[int, ...]

    def subtract(self, x: np.ndarray) -> np.ndarray:
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        part = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]
        return (x - np.array(whole, np.int64)).astype(float) - np.array(part)


def integer_vectors(vectors: DataFrame, scale: int, id_column: str, column: str, size: int | None) -> DataFrame:
    """The vectors that qualify, as (vec_id, x array<bigint>) with x = floor(scale * entry)."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("v")).filter(
        F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)
    if size is None:
        counts = kept.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("c"))
        top = counts.orderBy(F.desc("c"), "size").limit(1).collect()
        size = top[0]["size"] if top else 0
    limit = F.lit(float(LARGEST))
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(
        F.lit(float(scale)) * c.cast("double"), -limit), limit)).cast("bigint"))
    return kept.filter(F.size("v") == size).select("vec_id", whole.alias("x"))


def blocks(column: pa.Array, rows: int = 8192) -> Iterator[np.ndarray]:
    """The vectors of a column of lists as integer matrices of bounded height."""
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def summed(fit: DataFrame, add, width: int, number: str = "double") -> list[tuple]:
    """Rows (i, v0, v1, ...) of the matrices that ``add`` makes of every block, summed over all blocks and tasks."""
    names = [f"v{j}" for j in range(width)]
    schema = struct("i int, " + ", ".join(f"{c} {number}" for c in names))

    def run(batches):
        arrow = to_arrow_schema(schema)
        total = None
        for batch in batches:
            for x in blocks(batch.column(0)):
                part = add(x)
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(np.arange(len(total)), pa.int32())]
            columns += [pa.array(total[:, j].tolist(), f.type) for j, f in enumerate(list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    sums = map_arrow(fit.select("x"), run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    return sorted(tuple(r) for r in sums.collect())


def centre_of(fit: DataFrame) -> Centre | None:
    """Exact sums of the fit list; None where it is empty."""
    def add(x: np.ndarray) -> np.ndarray:
        # A block's sums fit a long: 8192 entries of at most 2^52 reach 2^65 only, so they are added in halves.
        high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
        return np.array([[(int(h) << 26) + int(v), len(x)] for h, v in zip(high, low)], object)

    def exact(x: np.ndarray) -> np.ndarray:
        from decimal import Decimal

        return np.vectorize(Decimal, otypes=[object])(add(x))

    found = summed(fit, exact, 2, "decimal(38,0)")
    return Centre(int(found[0][2]), tuple(int(r[1]) for r in found)) if found else None


def product_of(fit: DataFrame, centre: Centre):
    """The covariance of the fit list as a product: matrix -> matrix, one pass each."""
    def product(block: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            c = centre.subtract(x)
            return c.T @ (c @ block)

        return np.array([r[1:] for r in summed(fit, add, block.shape[1])]) / centre.n

    return product


def identity_error(fit: DataFrame, centre: Centre, scaled: np.ndarray) -> tuple[float, float]:
    """(largest entry of the whitened fit list's covariance minus the identity, trace of the covariance)."""
    k = scaled.shape[1]

    def add(x: np.ndarray) -> np.ndarray:
        c = centre.subtract(x)
        w = c @ scaled
        return np.hstack([np.vstack([w.T @ w, w.sum(axis=0)]), np.full((k + 1, 1), (c * c).sum())])

    found = np.array([r[1:] for r in summed(fit, add, k + 1)]) / centre.n
    mean = found[k, :k]
    return float(np.abs(found[:k, :k] - np.outer(mean, mean) - np.eye(k)).max()), float(found[0, k])


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """Per vector the exact sum of (n * x - sum)^2; None beyond a long."""
    top = max(int(np.abs(x).max(initial=0)) * centre.n, 0) + max(map(abs, centre.sums))
    if len(centre.sums) * top**2 < LONG:
        moved = x * centre.n - np.array(centre.sums, np.int64)
        return (moved * moved).sum(axis=1).tolist()
    moved = x.astype(object) * centre.n - np.array(centre.sums, object)
    return [int(d) if d < LONG else None for d in (moved * moved).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, size: int | None = None,
           id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per kept row and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error.

    The vectors' table stays below the scratch folder until ``clear_scratch``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    stored = scratch.store(integer_vectors(vectors, scale, id_column, column, size), "vectors")
    fit = scratch.store(stored.select("x").distinct(), "fit")
    kind = stored.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    centre = centre_of(fit)
    values, vectors_ = np.empty(0), np.empty((0, 0))
    if centre and centre.n > 1:
        dimension = len(centre.sums)
        values, vectors_ = eigen.largest(product_of(fit, centre), dimension, components)
        real = values > 64 * dimension * eigen.EPS * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
        values, vectors_ = values[real], vectors_[:, real]
    if not len(values):
        return spark.createDataFrame([], ddl)
    scaled = vectors_ / np.sqrt(values)
    error, trace = identity_error(fit, centre, scaled)
    scratch.drop("fit")
    k, schema = len(values), struct(ddl)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            at = 0
            for x in blocks(batch.column(1), 2048):
                rows = len(x)
                ids = batch.column(0).slice(at, rows).take(pa.array(np.repeat(np.arange(rows), k)))
                at += rows
                off = deviations(x, centre)
                columns = [ids, np.tile(np.arange(1, k + 1), rows), np.full(rows * k, centre.n),
                           [d for d in off for _ in range(k)], (centre.subtract(x) @ scaled).ravel(),
                           np.tile(values / trace, rows), np.full(rows * k, error)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if c is not ids else c for c, f in zip(columns, arrow)], schema=arrow)

    return map_arrow(stored, run, schema)
