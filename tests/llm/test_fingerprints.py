import hashlib
from collections import Counter

import pytest

from dayloom.llm import fingerprints as fp


def brute(rows):
    """The next text of every row: by doc_id (null first), then text, then round to the first."""
    order = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    out = []
    for (has, doc, text), (_, _, after) in zip(order, order[1:] + order[:1]):
        changed = fp.edited(text, after)
        out.append((doc if has else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.written(fp.sketch(text)),
                    fp.written(fp.sketch(changed))))
    return Counter(out)


def got(frame):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"])
                   for r in fp.fingerprints(frame).collect())


def test_every_row_meets_the_next(spark, documents, edge_docs, no_docs):
    rows = [(r["doc_id"] * 7 - 100, r["text"]) for r in documents.select("doc_id", "text").collect()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert got(frame) == brute(rows)
    assert got(edge_docs) == brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    one = spark.createDataFrame([(3, "only one text is here today")], "doc_id bigint, text string")
    assert got(one) == brute([(3, "only one text is here today")])
    assert fp.fingerprints(no_docs).count() == 0


def test_likeness_is_near_the_true_one(documents):
    texts = [r["text"] for r in documents.select("text").collect() if len(r["text"].split()) > 100]

    def true(a, b):
        sets = [{tuple(t.lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
        return len(sets[0] & sets[1]) / len(sets[0] | sets[1])

    errors = []
    for a, b in zip(texts, texts[1:]):
        changed = fp.edited(a, b)
        errors.append(abs(fp.likeness(fp.sketch(a), fp.sketch(changed)) - true(a, changed)))
    assert sum(errors) / len(errors) < 0.07


def test_sketches_merge_and_contain():
    a = " ".join(f"a{i}" for i in range(3000))
    b = " ".join(f"b{i}" for i in range(300))
    merged = fp.merge(fp.sketch(a), fp.sketch(b))
    assert fp.containment(fp.sketch(b), merged) == pytest.approx(1.0)
    assert 0.75 < fp.containment(merged, fp.sketch(a)) < 1
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1.0 and fp.likeness(fp.sketch(""), fp.sketch("x")) == 0.0
    assert fp.likeness(fp.sketch("Same Text"), fp.sketch("same  text")) == 1.0
