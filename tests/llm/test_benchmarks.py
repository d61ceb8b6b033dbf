import random

import numpy as np
import pytest

from dayloom.llm import benchmarks


def distance(item, text):
    """Least edits of the item against any part of the text, and with that the full table's word."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def letters(rng, n):
    return [rng.randint(97, 122) for _ in range(n)]


def test_alignment_equals_full_table():
    rng = random.Random(1)
    for _ in range(150):
        item = letters(rng, rng.randint(20, 60))
        inner = list(item)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(inner))
            inner[i:i + rng.randint(0, 1)] = letters(rng, rng.randint(0, 1))
        before = rng.randint(6, 30)
        text = letters(rng, before) + inner + letters(rng, rng.randint(0, 30))
        best = distance(item, text)
        got = benchmarks.align(np.array(item, np.uint32), np.array(text, np.uint32), before - 6, before + 6, 6)
        assert best <= 5 and got[0] == best
        assert distance(item, text[got[1]:got[2]]) == best


def plain(text):
    return [c for c in (text or "").lower() if c.isalnum()]


def test_matches_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "oran", "ge", "tion", "blue", "win", "dow", "ca", "ble", "st", "one", "river"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(8, 20))) for i in range(6)]
    docs = []
    for d in range(40):
        text = say(30)
        if d % 2:
            own = items[d % 6][1].split()
            for _ in range(d % 4):
                own[rng.randrange(len(own))] = say(1)
            text = say(9) + ". " + " ".join(own).upper() + "! " + say(9)
        docs.append((d, text))
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(
        items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmarks.matches(frame, bench, items_per_block=2).collect()}
    index = {i.key: i.edits for i in benchmarks.build_index(items).items}
    expected = {(d, i) for d, t in docs for i, q in items if distance(plain(q), plain(t)) <= index[i]}
    assert got == expected and len(expected) >= 10
    kept = {r["doc_id"] for r in benchmarks.drop_contaminated(frame, bench, items_per_block=4).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_positions_are_those_of_the_source(spark):
    item = "Every benchmark passage of some length is found again, whatever stands around it."
    text = "𝒳é  intro --- " + item.upper().replace(" ", "\n") + " tail"
    frame, bench = spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame(
        [(5, item)], "item_id bigint, text string")
    row = benchmarks.matches(frame, bench).collect()[0]
    assert text[row["start"]:row["end"]].replace("\n", " ") == item.upper().rstrip(".")


@pytest.mark.parametrize("short", ["ab1", "Seven c"])
def test_short_items(spark, edge_docs, no_docs, short):
    bench = spark.createDataFrame([(1, short), (2, None), (3, ""), (None, "x"), (4, "...")], "item_id bigint, text string")
    frame = spark.createDataFrame([(1, f"x {short} y"), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in benchmarks.matches(frame, bench).collect()] == [(1, 1)]
    assert benchmarks.drop_contaminated(edge_docs, bench).count() == edge_docs.count()
    assert benchmarks.matches(no_docs, bench).count() == 0
    assert benchmarks.matches(edge_docs, bench.limit(0)).count() == 0


def test_short_items_stand_as_whole_words(spark):
    """Items of a word or two are reported at all their places, and drop no prose."""
    texts = ["I said yes yesterday; YES!", "a banana and eyes", "yes-terday, no: yes\nno", "nothing here"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "a"), (3, "No. Yes")], "item_id bigint, text string")
    got = sorted(tuple(r) for r in benchmarks.matches(frame, bench).collect())
    assert [(d, i, texts[d][s:e], edits) for d, i, s, e, edits in got] == [
        (0, 1, "yes", 0), (0, 1, "YES", 0), (1, 2, "a", 0), (2, 1, "yes", 0), (2, 1, "yes", 0), (2, 3, "no: yes", 0)]
    assert benchmarks.drop_contaminated(frame, bench).count() == len(texts)


def test_items_take_the_whole_budget_of_the_lemma(spark):
    """40 letters at a tenth: four edits where the bound leaves a gram, none lost to a wider margin."""
    rng = random.Random(6)
    items = [(n, "".join(map(chr, letters(rng, n)))) for n in (8, 15, 16, 17, 24, 32, 39, 40, 41, 47, 48, 60)]
    index = {i.key: i for i in benchmarks.build_index(items).items}
    assert index[40].edits == 4 and index[40].least == 1 and index[16].edits == 1
    docs, expected = [], set()
    for n, item in items:
        for edits in range(0, n // 10 + 2):
            own = list(item)
            for place in sorted(rng.sample(range(n), edits)):
                own[place] = "0"
            text = "".join(map(chr, letters(rng, 30))) + "".join(own) + "".join(map(chr, letters(rng, 30)))
            docs.append((len(docs), text))
            expected |= {(docs[-1][0], k) for k, other in items if distance(other, text) <= index[k].edits}
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in benchmarks.matches(frame, bench).collect()} == expected
