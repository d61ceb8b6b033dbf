"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

A document longer than the sequence is cut into full pieces and a rest. The number of
pieces of each length, at most one count per length, is all the plan needs: best-fit over
counts, longest first, fills the tightest open sequences that still take the length, many
sequences at a time. The plan is a list of runs (length, ranks, first sequence, offset);
pieces take their place by their rank within their length.

Ranks come from stored per-task numbers plus the tasks' counts, so that a length of any
share of the pieces is numbered without gathering it.

A null text is a document of the end mark only, as is an empty one. Repeated rows and
doc_ids are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dayloom.llm.common import Scratch, map_arrow, ranked, struct
from dayloom.llm.tokens import word_tokens

Run = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs (length, first rank, end rank, first sequence, offset) that place ``counts[length]`` pieces of each length.

    Open sequences with the same room and filling history stand together as (first, how
    many), so the work depends on the lengths, not on the number of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []
    runs: list[Run] = []
    sequence = 0

    def put(space: int, first: int, many: int) -> None:
        if many and space:
            room[space].append((first, many))

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left, rank = counts[length], 0
        space = length
        while left:
            while space <= capacity and not room[space]:
                space += 1
            if space <= capacity:
                first, many = room[space].pop()
            else:
                each = capacity // length
                first, many = sequence, -(-left // each)
                sequence += many
            inside = min(space, capacity)
            each = inside // length
            full = min(many, left // each)
            offset = capacity - inside
            for k in range(each if full else 0):
                runs.append((length, rank, rank + full, first, offset + k * length))
                rank += full
            left -= full * each
            put(inside - each * length, first, full)
            if full < many:
                # The last, partly filled sequence of this length; what is untouched stays as it was.
                for k in range(left):
                    runs.append((length, rank, rank + 1, first + full, offset + k * length))
                    rank += 1
                used = 1 if left else 0
                put(inside - left * length, first + full, used)
                left = 0
                put(inside, first + full + used, many - full - used)
            space = length
    return runs


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and its task and number among the task's pieces of that length."""
    schema = struct("doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, run int, nth bigint")
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        run = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        encode_all: Callable | None = None
        for batch in batches:
            encode_all = encode_all or word_tokens(tokenizer).encode_all
            out: list[list] = [[] for _ in arrow]
            for doc, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1))):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    length = len(part) // 4
                    for column, value in zip(out, (doc, number, at // 4, length, zlib.crc32(part), run, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    stored = Scratch(spark, "packing").store(pieces(docs, tokenizer, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "length int, low bigint, high bigint, first bigint, offset bigint")
    numbered = ranked(stored, ["length"], "nth", "run", "rank")
    # The plan grows with the number of lengths, not of pieces, and is cut from the histogram above.
    placed = numbered.join(F.broadcast(runs), "length").filter("rank >= low and rank < high")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
