import zlib

import corpus_pipeline
from dayloom.llm import benchmarks, pii
from tests.llm.test_ngrams import brute
from tests.llm.test_tokens import whole

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        held[name] = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(held[name][1], docs.schema)
    before, after = held["quality_classifier"]
    kept = {r["doc_id"] for r in after}
    judged = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert sum((d in kept) == bool(labels[d]) for d in judged) >= 0.9 * len(judged)
    before, after = held["ngram_jaccard_join"]
    assert {r["doc_id"] for r in after} == set(brute([(r["doc_id"], r["text"]) for r in before], 5, 80))
    before, after = held["benchmark_decontamination"]
    hit = {f[0] for f in benchmarks._scan(benchmarks.build_index(items), [r["text"] for r in before])}
    assert [r["doc_id"] for i, r in enumerate(before) if i not in hit] == [r["doc_id"] for r in after]
    assert not any(q in r["text"] for r in after for _, q in items)
    before, after = held["mask_personal_data"]
    assert {r["doc_id"]: (pii.masked(r["text"]), len(pii.masked(r["text"]))) for r in before} == {
        r["doc_id"]: (r["text"], r["n_chars"]) for r in after}
    before, after = held["best_fit_packing"]
    whole(after, [(r["doc_id"], r["text"]) for r in before], 2048)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 50
    assert zlib.crc32(b"") == 0
