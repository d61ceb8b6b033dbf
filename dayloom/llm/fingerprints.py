"""Threshold-scaled sketches of texts: every shingle hash below a fixed fraction of the hash range.

A sketch keeps all 32-bit hashes of five-word shingles below ``FRACTION`` of the range, and
never fewer than the ``FEWEST`` smallest, so that short texts keep something to compare. It
carries the bound up to which it is complete. Two sketches are compared below the smaller of
their bounds, where both are complete; they merge by union below that bound, whatever the
sizes of the texts. From what is common below the bound follow containment in either
direction and Jaccard likeness.

Written as text a sketch is ``bound:hashes`` in hexadecimal, hashes ascending, eight digits
each; bound 100000000 means that all hashes were kept. Texts are words between white space,
in lower case; fewer than five words are one shingle; equal texts have equal sketches. A
null text counts as empty, and an empty text has no hashes; two empty sketches are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import map_arrow, struct

WIDTH = 5
FRACTION = 8
FEWEST = 32
RANGE = 1 << 32
WORD_CACHE = 600_000
MULTIPLIERS = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_words: dict[str, int] = {}
Sketch = tuple[int, np.ndarray]


def _shingles(words: np.ndarray) -> np.ndarray:
    """32-bit hashes of the shingles of a sequence of word hashes."""
    if not len(words):
        return np.empty(0, np.uint32)
    width = min(WIDTH, len(words))
    count = len(words) - width + 1
    h = np.zeros(count, np.uint64)
    for i in range(width):
        h = (h ^ words[i:i + count]) * MULTIPLIERS[i]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def word_hashes(text: str) -> np.ndarray:
    if len(_words) > WORD_CACHE:
        _words.clear()
    words = text.lower().split()
    codes = list(map(_words.get, words))
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = _words[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(codes, np.uint64)


def sketch(text: str) -> Sketch:
    """(bound, ascending hashes below it)."""
    hashes = _shingles(word_hashes(text))
    low = np.unique(hashes[hashes < RANGE // FRACTION])
    if len(low) >= FEWEST:
        return RANGE // FRACTION, low
    every = np.unique(hashes)
    if len(every) <= FEWEST:
        return RANGE, every
    return int(every[FEWEST]), every[:FEWEST]


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together, complete below the smaller bound."""
    bound = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return bound, both[both < bound]


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has too."""
    bound = min(a[0], b[0])
    x, y = a[1][a[1] < bound], b[1][b[1] < bound]
    if not len(x):
        return 1.0 if not len(a[1]) else 0.0
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard likeness."""
    bound = min(a[0], b[0])
    x, y = a[1][a[1] < bound], b[1][b[1] < bound]
    if not len(x) and not len(y):
        return 1.0 if len(a[1]) == len(b[1]) else 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def written(s: Sketch) -> str:
    return f"{s[0]:x}:" + s[1].astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the next text, or all it has."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id, each followed by the first row of the next range (the last by the very first).

    Range ends are doc_ids that exist, so a range's first rows are known by their doc_id, and only the
    first row of a range has to be in two of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    ids = rows.select("doc_id").filter("doc_id is not null")
    found = ids.agg(F.percentile_approx("doc_id", shares, 100 * parts).alias("cuts"), F.min("doc_id").alias("low")).first()
    nulls = rows.filter("doc_id is null").limit(1).count() > 0
    low = None if nulls else found["low"]
    cuts = sorted({c for c in (found["cuts"] or []) if low is None or c > low})
    if not cuts:
        part, is_cut = F.lit(0), F.lit(False)
    else:
        edges = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        # Number of cuts at or below the id, by halving over the sorted cuts.
        part = F.coalesce(_below(F.col("doc_id"), cuts, 0, len(cuts)), F.lit(0))
        is_cut = F.coalesce(F.array_contains(edges, F.col("doc_id")), F.lit(False))
    last = len(cuts)
    first = F.col("doc_id").isNull() if low is None else F.col("doc_id") == F.lit(low)
    copies = F.when(is_cut, F.array(F.struct(part.alias("part"), F.lit(False).alias("ahead")),
                                    F.struct((part - 1).alias("part"), F.lit(True).alias("ahead"))))
    copies = copies.when(first, F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("ahead")),
                                        F.struct(F.lit(last).alias("part"), F.lit(True).alias("ahead"))))
    copies = copies.otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("ahead"))))
    dealt = rows.withColumn("p_", F.explode(copies)).select("p_.part", "p_.ahead", "doc_id", "text")
    return dealt.repartition(parts, "part").sortWithinPartitions(
        "part", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def _below(x, cuts: list[int], low: int, high: int):
    """Expression for the number of cuts in [low, high) at or below x, plus low."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x >= F.lit(cuts[middle]), _below(x, cuts, middle + 1, high)).otherwise(_below(x, cuts, low, middle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next doc_id; rows that share a doc_id follow each other by text, rows
    without one come first, and after the last stands the first.
    """
    schema = struct("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double")
    names = schema.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, wrapped = None, None, False
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for p, ahead, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part:
                    part, waiting, wrapped = p, None, False
                if wrapped:
                    continue
                own = sketch(text)
                if waiting is not None:
                    before_doc, before, before_sketch = waiting
                    changed = edited(before, text)
                    changed_sketch = sketch(changed)
                    row = (before_doc, len(before), hashlib.sha256(changed.encode()).hexdigest(), written(before_sketch),
                           written(changed_sketch), likeness(before_sketch, changed_sketch), likeness(before_sketch, own))
                    for column, value in zip(out, row):
                        column.append(value)
                # Of rows that share the following range's first doc_id only the first counts.
                wrapped = ahead
                waiting = (doc, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                      pa.float64(), pa.float64()))], names=names)

    return map_arrow(_in_order(docs), work, schema)
