"""Near copies by signatures against comparing all pairs, the index against all distances, and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from dayloom.llm import minhash, ngrams
from tests.llm.test_ngrams import brute, near_copies, shingles


def agreed(spark, rows, n=5, percent=85):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_copy_groups(frame, n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    expected = Counter((d, len(shingles(t, n)), c, d == c) for (d, t), c in zip(rows, brute(rows, n, percent)))
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_groups_equal_brute_force(spark):
    agreed(spark, near_copies(11, 20, 12))


def test_other_widths_and_thresholds(spark):
    agreed(spark, near_copies(12, 10, 10), 3, 70)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    """Texts around the threshold that share most of their words: cells instead of joins, cut small."""
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "CELL", 6)
    monkeypatch.setattr(minhash, "FAN", 3)
    monkeypatch.setattr(minhash, "STRIP", 2)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(4):
        base = [rng.choice(words) for _ in range(90)]
        for i in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    agreed(spark, rows)


@pytest.mark.parametrize("small", [0, 16, 10**6])
def test_the_rest_alone_is_whole(spark, monkeypatch, small):
    """The join and the cells find every link without stars and nearest ones."""
    real = minhash.confirmed
    calls = []

    def last_only(pairs, texts, n, percent):
        calls.append(1)
        return real(pairs.limit(0) if len(calls) <= minhash.NEAREST + 1 else pairs, texts, n, percent)

    monkeypatch.setattr(minhash, "confirmed", last_only)
    monkeypatch.setattr(minhash, "SMALL", small)
    agreed(spark, near_copies(14, 8, 30))
    assert len(calls) == minhash.NEAREST + 2


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = Counter((r["doc_id"], r["component_id"]) for r in minhash.near_copy_groups(edge_docs).collect())
    assert got == Counter(zip([d for d, _ in rows], brute(rows, 5, 85)))
    assert minhash.near_copy_groups(no_docs).count() == 0
    nulls = [(None, None), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, None)]
    agreed(spark, nulls[:1] + nulls[3:])
    got = minhash.near_copy_groups(spark.createDataFrame(nulls, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter(
        {(None, None, True): 3, (4, 4, True): 1})


def test_texts_without_an_id_join_groups(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(None, base + " x"), (7, base + " y"), (9, base + " z"), (None, "quite another text that stands alone here")]
    got = minhash.near_copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter(
        [(None, 7, False), (7, 7, True), (9, 7, False), (None, None, True)])


def test_given_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    agreed(spark, rows)


@pytest.mark.parametrize("distance", [1, 2, 5, 24, 25, 40])
def test_pairs_within_the_distance_share_a_key(distance):
    rng = np.random.default_rng(distance)
    for _ in range(60):
        a = rng.integers(0, 1 << 16, minhash.INDEXED).astype(np.uint16)
        b = a.copy()
        # Errors dealt as evenly over the chunks as can be are the hardest to index.
        places = [p for step in range(64) for low, high in minhash.chunk_bounds(distance)
                  for p in range(low, high) if p - low == step]
        b[places[:distance] if rng.random() < 0.5 else rng.permutation(64)[:distance]] ^= 1
        keys = minhash.keys_of(np.stack([a, b]), distance)
        shared = np.flatnonzero(keys[0] == keys[1])
        assert len(shared) and minhash.first_shared((a != b)[None], distance)[0] in shared


def test_the_distance_loses_less_than_one_pair_in_a_million():
    for percent in (70, 80, 85, 90, 95):
        for n in (minhash.INDEXED, minhash.POSITIONS):
            miss, most = 1 - percent / 100, minhash.errors(percent, n)
            lost = sum(math.comb(n, k) * miss**k * (1 - miss) ** (n - k) for k in range(most + 1, n + 1))
            assert lost < 1e-6, (percent, n, most, lost)


def test_signatures_estimate_similarity_and_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    sets = [np.unique(pool[:5000]), np.unique(pool[1000:]), np.unique(pool[:3])]
    whole = minhash.signatures(sets)
    monkeypatch.setattr(minhash, "GRAMS_AT_ONCE", 700)
    assert (minhash.signatures(sets) == whole).all()
    apart = minhash._apart_by(whole[[0, 0]], whole[[1, 2]]) / minhash.POSITIONS
    assert abs(apart[0] - 2000 / 6000) < 0.1 and apart[1] > 0.9


def test_a_group_of_copies_costs_no_pairs(spark, monkeypatch):
    """Of 400 near copies about one comparison each, not 80,000."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    pairs = []
    real = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda p, *rest: (pairs.append(p.count()), real(p, *rest))[1])
    got = minhash.near_copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and sum(pairs) < 1200


def alike(count, changed, seed):
    """Texts that each differ from one base in one word of their own for every number in ``changed``."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(count):
        own = list(base)
        for c in range(changed[i % len(changed)]):
            own[rng.randrange(100)] = f"x{i}-{c}"
        rows.append((i, " ".join(own)))
    return rows


def test_texts_alike_below_the_threshold_cost_no_pairs(spark, monkeypatch):
    """150 texts of similarity 0.8: 11,175 pairs within the distance, none of which leaves a task or is confirmed by a join."""
    rows = alike(150, [1], 16)
    pairs, cells = [], []
    confirmed, inside = minhash.confirmed, minhash._cells
    monkeypatch.setattr(minhash, "confirmed", lambda p, *rest: (pairs.append(p.count()), confirmed(p, *rest))[1])
    monkeypatch.setattr(minhash, "_cells", lambda *a: (cells.append(out := inside(*a)), pairs.append(out.count()), out)[2])
    agreed(spark, rows)
    assert cells and sum(pairs) < 1500


@pytest.mark.parametrize("heavy", [10, 1024])
def test_cells_of_long_texts_are_smaller_and_lose_nothing(spark, monkeypatch, heavy):
    monkeypatch.setattr(minhash, "HEAVY", heavy)
    monkeypatch.setattr(minhash, "CELL", 64)
    agreed(spark, alike(80, [0, 1, 1, 2], 17) + [(None, None), (200, "")])


def test_components_helper_is_shared():
    assert minhash.components is ngrams.components
