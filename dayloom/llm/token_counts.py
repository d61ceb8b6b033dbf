"""Token counts of texts with the whole-token shortcut.

``tokens.TokenCounter`` holds the vocabulary strings proven to encode alone as one token;
pre-tokens among them count one and only the rest are merged. Counting needs no shuffle.

A null or empty text has no tokens. Repeated rows are counted one by one; texts of any
length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import map_arrow, struct
from dayloom.llm.tokens import token_counter


def count(docs: DataFrame, tokenizer: str, ranks: str, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or token_counter(tokenizer, ranks)
            texts = batch.column(1).fill_null("")
            found = counter.count_all(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(found, pa.int64()),
                pa.array([n > limit for n in found], pa.bool_()),
            ], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(narrow, work, struct("doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"))
