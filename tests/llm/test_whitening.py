"""Whitening against dense eigenvectors and exact integers, the eigen solver, and rows out of the ordinary."""

import math
import random

import numpy as np
import pytest

from dayloom.llm import eigen, whitening

DDL = "vec_id bigint, embedding array<float>, label int, x string, n double, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 0.5, "c") for i, v in rows], DDL)


def agreed(spark, rows, size, components=4, scale=256):
    """Compare every value with a dense computation over the rows that qualify."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[v - s / n for v, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    rank = int((values > 1e-11 * values[0]).sum())
    k = min(components, rank)
    got = whitening.whiten(frame(spark, rows), components, scale).collect()
    assert len(got) == k * len(kept)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    for i, x in kept:
        own = [r for r in by_id[i]]
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        assert {r["n"] for r in own} == {n} and deviation in {r["deviation"] for r in own}
    assert {r["component"] for r in got} == set(range(1, k + 1))
    for r in got:
        assert r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    # The projections of all rows have unit covariance over the fit list and are eigenvectors of it.
    ids = [i for i, _ in kept]
    if len(set(ids)) == len(ids):
        table = np.zeros((len(kept), k))
        place = {i: j for j, i in enumerate(ids)}
        for r in got:
            table[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        dense = np.array([[v - s / n for v, s in zip(x, sums)] for _, x in kept])
        vectors = np.linalg.eigh(covariance)[1][:, ::-1]
        for j in range(k):
            if (j == 0 or values[j - 1] - values[j] > 1e-3 * values[0]) and (
                    j + 1 == len(values) or values[j] - values[j + 1] > 1e-3 * values[0]):
                want = dense @ vectors[:, j] / math.sqrt(values[j])
                assert np.abs(table[:, j] * np.sign(want @ table[:, j]) - want).max() < 1e-8
    return got


def floats(spark, rows):
    return [(r["vec_id"], r["embedding"]) for r in frame(spark, rows).collect()]


def test_equal_to_dense_eigenvectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + 3 / (j + 1)) for j in range(24)]) for i in range(400)]
    agreed(spark, floats(spark, rows), 24)


def test_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    agreed(spark, [(r["vec_id"], r["embedding"]) for r in table.collect()], 64)


def test_copies_count_once_in_the_fit(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(300)]
    agreed(spark, floats(spark, rows), 6)


def test_rows_that_do_not_qualify(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0, None, 2.0, 3.0, 4.0]), (94, [float("nan")] * 5),
           (95, [float("inf")] * 5), (96, [0.0] * 9)]
    agreed(spark, floats(spark, rows + bad + [(None, [-0.0] * 5), rows[3], rows[3]]), 5)


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, float(i % 2)]) for i in range(12)]
    assert {r["component"] for r in agreed(spark, rows, 4)} == {1, 2}
    agreed(spark, [(i, [float(i * i)]) for i in range(9)], 1)
    agreed(spark, [(0, [0.0, 1.0, 2.0]), (1, [3.0, 1.0, 0.0])], 3)


def test_no_rows_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        got = whitening.whiten(frame(spark, rows))
        assert got.count() == 0
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_mean_far_from_zero_costs_no_digits(spark):
    """Entries near 2^40 that differ by a few units."""
    rng = random.Random(4)
    rows = [(i, [float(2**23 + rng.randrange(9)) for _ in range(4)]) for i in range(60)]
    kept = floats(spark, rows)
    got = whitening.whiten(frame(spark, kept), 4, 1 << 17).collect()
    near = whitening.whiten(frame(spark, [(i, [c - 2**23 for c in v]) for i, v in kept]), 4, 1 << 17).collect()
    sizes = lambda found: sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 7)) for r in found)
    assert sizes(got) == sizes(near)
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted(
        (r["vec_id"], r["deviation"]) for r in near if r["component"] == 1)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [1e12, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1e30, -1e30])]
    assert all(r["deviation"] is None for r in whitening.whiten(frame(spark, rows)).collect())


@pytest.mark.parametrize("size,seed", [(1, 0), (3, 1), (10, 2), (40, 3), (90, 4)])
def test_largest_eigenpairs(size, seed):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    for spectrum in (rng.random(size), np.ones(size), np.repeat([3.0, 1.0], [size - size // 2, size // 2]),
                     np.zeros(size), 1 + 1e-4 * rng.random(size), 10.0 ** -np.arange(size)):
        matrix = turn * spectrum @ turn.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = eigen.largest(lambda u: matrix @ u, size, 4)
        k = min(4, size)
        top = max(np.sort(spectrum)[-1], 1e-15)
        assert np.abs(values - np.sort(spectrum)[::-1][:k]).max() < 1e-12 * top + 1e-15
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
        assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * top + 1e-15


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    matrix = np.diag(np.concatenate([np.linspace(1, 2, 10), np.linspace(-2, -1, 10)]))
    right = rng.standard_normal((20, 3))
    found = eigen.minres(lambda v: matrix @ v, right, 60, 1e-13)
    assert np.abs(matrix @ found - right).max() < 1e-10
    assert not eigen.minres(lambda v: matrix @ v, np.zeros((20, 2)), 5, 1e-9).any()
