import zlib

from pyspark.sql import functions as F

from dayloom.llm import sharding


def test_shards_slots_and_growth(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(spark.range(1000, 9000).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    rows = sharding.assign(docs.repartition(6), sharding.uniform_tree(40), sharding.uniform_tree(41)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = len(rows) / 40
    assert all(0.7 * mean < len(s) < 1.3 * mean for s in slots.values())
    moved = sum(r["grown_shard"] == 40 for r in rows)
    assert 0.6 * len(rows) / 41 < moved < 1.4 * len(rows) / 41


def test_movement_is_confined_to_changed_subtrees(spark):
    tree = sharding.uniform_tree(20)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["region-0"]["rack-1"][7] = 3.0
    ids = spark.range(4000).withColumn("a", sharding.place(F.col("id"), tree)).withColumn(
        "b", sharding.place(F.col("id"), heavier))
    for r in ids.filter("a != b").collect():
        # Rows move into the region that grew, or within it towards the rack and shard that grew.
        assert r["b"] in range(10)
        if r["a"] in range(10):
            assert r["b"] in range(5, 10)
            if r["a"] in range(5, 10):
                assert r["b"] == 7
    share = ids.filter("b = 7").count() / 4000
    assert 0.09 < share < 0.19  # weight 3 of 22


def test_weights_and_edge_rows(edge_docs, no_docs):
    tree = {"r": {"k": {0: 0.0, 1: 1.0}}, "q": {"k": {2: 0.0}}}
    rows = sharding.assign(edge_docs, tree, tree).collect()
    assert {r["shard"] for r in rows} == {1} and sorted(r["slot"] for r in rows) == list(range(edge_docs.count()))
    assert min(r["size"] for r in rows) == 16
    assert sharding.assign(no_docs, tree, tree).count() == 0
