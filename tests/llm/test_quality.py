import zlib

from pyspark.sql import functions as F

from dayloom.llm import quality


def test_held_out_rows_are_those_of_crc32(spark):
    frame = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id bigint")
    got = {r["doc_id"]: r["h"] for r in frame.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)} | {None: False}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).join(labels, "doc_id")
    rows = scored.filter(quality.held_out(F.col("doc_id"))).select("score", "predicted", "quality").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    bad = [r["score"] for r in rows if r["quality"] == 0]
    good = [r["score"] for r in rows if r["quality"] == 1]
    ahead = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert right / len(rows) > 0.97 and ahead > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (7, 1), (6, 0), (None, 1), (8, None), (99, 1)],
                                   "doc_id bigint, quality int")
    model = quality.fit(edge_docs, labels)
    rows = quality.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(edge_docs, labels)
    assert kept.columns == edge_docs.columns and {r["score"] for r in kept.collect()} <= {1.0, 2.0, None}


def test_without_labels_scores_are_even(spark, edge_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(edge_docs, quality.fit(edge_docs, labels)).collect()} == {0.5}
