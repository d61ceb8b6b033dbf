"""The registered query of every operator: the operator over its whole table, with its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import (
    benchmarks,
    centroids,
    fingerprints,
    minhash,
    ngrams,
    packing,
    pages,
    pii,
    quality,
    secrets,
    sharding,
    token_counts,
    whitening,
)
from dayloom.llm.common import read


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), sharding.uniform_tree(40), sharding.uniform_tree(41))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.jaccard_groups(read(spark, sf_dir, "documents"), n=3, percent=90).select(
        "doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copy_groups(read(spark, sf_dir, "documents"), n=5, percent=85)


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_pii, op3_secrets, op4_quality, op5_packing, op6_sharding, op7_token_counts, op8_fingerprints,
    op9_jaccard_join, op10_decontamination, op11_centroids, op12_whitening, op13_minhash)}
#: The article of the given pages, whose markup is known: blocks are headings and paragraphs.
OP1_SQL = r"""
    WITH inside AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS a FROM pages),
    blocks AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(a, '</?p>|</?h1>'), lambda b:
        trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))),
        lambda b: b <> '') AS b FROM inside)
    SELECT page_id, url, array_to_string(b, chr(10)) AS text, CAST(length(array_to_string(b, chr(10))) AS BIGINT) AS n_chars
    FROM blocks"""

_GROUPS_SQL = r"""
    WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE
        list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END AS s
        FROM words),
    grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM documents
                UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id{more} FROM sets JOIN least USING (doc_id)"""
OP9_SQL = _GROUPS_SQL.format(n=3, percent=90, more="")
OP13_SQL = _GROUPS_SQL.format(n=5, percent=85, more=", doc_id = component_id AS kept")

_ROUND = """
    d{i} AS MATERIALIZED (SELECT v.row, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
        AS d FROM kept v CROSS JOIN c{i} c),
    a{i} AS MATERIALIZED (SELECT row, any_value(x) AS x, min(d) AS d, arg_min(cluster, (d, cluster)) AS cluster FROM d{i} GROUP BY row)"""
_UPDATE = """
    m{i} AS (SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS x FROM (
        SELECT cluster, place, CAST(sum(v) AS HUGEINT) - (CAST(sum(v) AS HUGEINT) % count(*) + count(*)) % count(*) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place) GROUP BY cluster),
    c{j} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster)),"""
#: Ten rounds spelled out; a sum is made divisible before it is divided, so that the floor is exact.
OP11_SQL = """
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding,
        lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x FROM (
        SELECT sha256('3:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 8)),""" + ",".join(
    _ROUND.format(i=i) + "," + _UPDATE.format(i=i, j=i + 1).rstrip(",") for i in range(10)) + "," + _ROUND.format(i=10) + """
    SELECT vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance,
        CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a10 a JOIN kept USING (row) JOIN c10 c ON a.cluster = c.cluster"""

#: The other operators rest on hashes, tokenizers, fits or alignments that SQL does not have; tests/llm holds them
#: against brute force.
ORACLE_SQL: dict[str, str] = {"op1_main_text": OP1_SQL, "op9_jaccard_join": OP9_SQL,
                              "op11_centroids": OP11_SQL, "op13_minhash": OP13_SQL}
