import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dayloom.llm import ngrams
from dayloom.llm.common import Scratch


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(rows, n, percent):
    """Component of every row index, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [doc if not sets[i] else least.get(root(i)) for i, (doc, _) in enumerate(rows)]


def near_copies(seed, groups=12, members=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((doc, " ".join(own)))
            doc += 1
    return rows


def agreed(spark, rows, n, percent):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngrams.jaccard_groups(frame, n, percent).collect()
    expected = Counter(zip([d for d, _ in rows], [len(shingles(t, n)) for _, t in rows], brute(rows, n, percent)))
    assert Counter((r["doc_id"], r["n_grams"], r["component_id"]) for r in got) == expected


def test_groups_equal_brute_force(spark):
    agreed(spark, near_copies(1), 3, 90)


def test_groups_of_the_stage_equal_brute_force(spark):
    agreed(spark, near_copies(2, 8, 10), 5, 80)


def test_long_lists_equal_brute_force(spark, monkeypatch):
    """Every gram that two texts share counts as a long list, cut into small blocks."""
    classes = ngrams.frequency_classes
    monkeypatch.setattr(ngrams, "frequency_classes", lambda c: np.maximum(classes(c), (c > 1).astype(np.uint8)))
    monkeypatch.setattr(ngrams, "BLOCK_GRAMS", 150)
    agreed(spark, near_copies(3, 6, 16), 3, 90)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = ngrams.jaccard_groups(edge_docs, 3, 90).collect()
    expected = Counter(zip([d for d, _ in rows], brute(rows, 3, 90)))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == expected
    assert ngrams.jaccard_groups(no_docs, 3, 90).count() == 0


def test_drop_near_copies(edge_docs, no_docs):
    kept = ngrams.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 3, 4, 5, None, 6, 7, 8, 8])
    assert ngrams.drop_near_copies(no_docs).count() == 0


def test_drop_near_copies_with_unique_ids(spark):
    rows = near_copies(4, 6, 8)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in ngrams.drop_near_copies(frame, 3, 90).collect()}
    assert kept == set(brute(rows, 3, 90))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 120), (7, 7)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in ngrams.components(frame, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 120: 99}


def test_no_pair_of_a_common_gram_is_joined_per_row(spark):
    """Texts that share one frequent passage and little else give no candidates of their own."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngrams.jaccard_groups(frame, 3, 90)
    assert got.filter(F.col("component_id") != F.col("doc_id")).count() == 0


def test_many_short_texts_stay_in_bounded_blocks(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    most = 400
    inner = ngrams.forest

    def bounded(keys, sets, percent, first):
        # Two blocks, and what chance adds to them.
        assert len(sets) <= most
        seen.add(1)
        return inner(keys, sets, percent, first)

    monkeypatch.setattr(ngrams, "BLOCK_MEMBERS", 100)
    monkeypatch.setattr(ngrams, "forest", bounded)
    rng = random.Random(9)
    rows = [(i, f"all of us share {rng.choice('abc')} w{rng.randrange(40)} x{rng.randrange(40)} this line ends") for i in range(1500)]
    agreed(spark, rows, 3, 40)
    assert seen.value > 1


def test_forest_joins_the_parts_of_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 12).astype(np.uint64)) for _ in range(700)]
    for first, percent in ((0, 45), (300, 45), (0, 60), (650, 60)):
        def parts(links):
            part = list(range(len(sets)))

            def root(i):
                while part[i] != i:
                    i = part[i]
                return i
            for a, b in links:
                part[root(a)] = root(b)
            groups = {}
            for i in range(len(sets)):
                groups.setdefault(root(i), []).append(i)
            return sorted(groups.values())
        pairs = [(i, j) for i in range(first or len(sets)) for j in range(first or i + 1, len(sets))]
        linked = []
        for i, j in pairs:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                linked.append((i, j))
        found = ngrams.forest(np.arange(len(sets)), sets, percent, first)
        assert set(found) <= set(linked) and parts(found) == parts(linked)
        assert len(found) == len(sets) - len(parts(linked))
