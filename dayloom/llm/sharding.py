"""Shards from a hierarchical weighted hash tree.

A tree has regions, racks and shards, each shard with a weight; a rack weighs what its
shards weigh, a region what its racks weigh. A row descends level by level: every child of
the node it is at draws -ln(u) / weight, u a hash of the row's key and the child's name, and
the smallest draw wins. A child wins in proportion to its weight, and a draw depends on
that child alone, so a changed weight moves rows only to or from the changed child: no row
moves between two children that stay as they were. A shard is added as a rack and region
of its own; then only rows that the new region wins move, all into the new shard (law "key").

Everything is column expressions. The tree has as many entries as shards; rows are not
shuffled to be placed. Slots are numbered from the tasks' counts, so a shard of any size is
numbered in parallel. A null key is a key like others; rows that repeat a key share its
shard and get slots of their own. Sizes of null texts count 0 bytes. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch, ranked, text_or_empty, with_run

Tree = dict[str, dict[str, dict[int, float]]]
BASE_SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2


def uniform_tree(shards: int, base: int = BASE_SHARDS) -> Tree:
    """Shards 0 to ``shards`` - 1 of weight 1: up to ``base`` in racks of five and regions of two racks, each later
    one in a region of its own."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // SHARDS_PER_RACK
        region = f"region-{rack // RACKS_PER_REGION}" if shard < base else f"region-of-{shard}"
        name = f"rack-{rack}" if shard < base else f"rack-of-{shard}"
        tree.setdefault(region, {}).setdefault(name, {})[shard] = 1.0
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    """The child's draw for the key: smaller is better, and heavier children draw smaller."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What the child with the smallest draw leads to; of equal draws the first name wins."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("i")) for i, (name, weight, _) in
             enumerate(children)]
    best = F.least(*draws)["i"]
    return F.element_at(F.array(*[c for _, _, c in children]), best + 1)


def place(key: Column, tree: Tree) -> Column:
    """Shard of a key."""
    regions = []
    for region, racks in sorted(tree.items()):
        inner = []
        for rack, shards in sorted(racks.items()):
            leaves = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in sorted(shards.items()) if w > 0]
            if leaves:
                inner.append((f"{region}/{rack}", sum(w for _, w, _ in leaves), leaves))
        if inner:
            regions.append((region, sum(w for _, w, _ in inner), inner))

    def below_rack(leaves):
        return _winner(key, leaves)

    def below_region(inner):
        return _winner(key, [(name, w, below_rack(leaves)) for name, w, leaves in inner])

    return _winner(key, [(name, w, below_region(inner)) for name, w, inner in regions])


def assign(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and the shard under the grown tree."""
    text = text_or_empty().cast("binary")
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), place(F.col("doc_id"), tree).alias("shard"), place(F.col("doc_id"), grown).alias("grown_shard"))
    stored = Scratch(docs.sparkSession, "sharding").store(with_run(rows), "rows")
    within = Window.partitionBy("run_", "shard").orderBy("row_")
    numbered = stored.withColumn("nth_", (F.row_number().over(within) - 1).cast("bigint"))
    return ranked(numbered, ["shard"], "nth_", "run_", "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
