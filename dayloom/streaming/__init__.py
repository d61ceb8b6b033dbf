"""Structured Streaming forms of the daily roll-up, the incremental load and the upsert."""

from dayloom.streaming.counters import counting, observed, read_counters
from dayloom.streaming.jobs import (
    compact,
    daily_rollup,
    file_stream,
    read_store,
    read_upserted,
    remove_folded,
    rollup_table,
    start_incremental,
    start_rollup,
    start_upsert,
)

__all__ = [
    "compact",
    "counting",
    "daily_rollup",
    "file_stream",
    "observed",
    "read_counters",
    "read_store",
    "read_upserted",
    "remove_folded",
    "rollup_table",
    "start_incremental",
    "start_rollup",
    "start_upsert",
]
