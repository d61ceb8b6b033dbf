"""N-gram Jaccard self-join by T-occurrence search, and the groups that its links form.

A text is the set of its word n-grams. Two texts link when their sets' Jaccard similarity
reaches ``percent`` / 100. A text of n grams can only link to texts that stand in at least
T = ceil(n * percent / 100) of its n inverted lists. As in DivideSkip, lists are divided:

* grams are put in one order for the whole corpus, rare before frequent (a fixed-size
  counting sketch of all texts gives the frequency class, the hash breaks ties). Of n lists
  only the first n - T + r need merging: any partner is in r of them at least.
* *short lists* (class 0) are merged by a join on the gram; pairs met in at least
  min(r, T) of them become candidates and the rest of the overlap is probed in the sorted
  gram arrays of both texts.
* *long lists* are not merged. Each is cut into blocks of bounded size, every two blocks of
  a list meet in one task, and the overlaps of all their members are counted there at once;
  only links that join parts still apart are returned, so a group of n near copies gives
  at most n - 1 rows for each pair of blocks.

Both paths are exact for any lists; the sketch decides only which path a gram takes.

Texts with the same set form one class (a 64-bit key of the sorted gram hashes and their
count); only classes are joined. Components are found by star contraction over stored
tables. Nulls and texts without words have an empty set and link with nothing; a text with
fewer than n words is one gram. Repeated rows are members of the same class. A null doc_id
takes part in links, and its component is the smallest doc_id that is not null (null when
there is none). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dayloom.llm.common import Scratch, map_arrow, map_columns, slices, struct

SKETCH_BITS = 20
SKETCH_ROWS = 2
SKETCH_PARTS = 16
SHARED = 3
BLOCK_GRAMS = 200_000
BLOCK_MEMBERS = 2_000
STRIP = 256
CLASS_UNIT = 64
WORD_CACHE = 250_000
COUNT_AT_ONCE = 500_000
PRIMES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
    dtype=np.uint64,
)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; words are cut at ASCII white space, A-Z lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    known = _words.get
    codes = [known(w) for w in words]
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = _words[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    w = np.array(codes, dtype=np.uint64)
    width = min(n, len(w))
    count = len(w) - width + 1
    h = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        h = _mix(h * PRIMES[i % 5] + w[i:i + count])
    return np.unique(h)


def class_key(grams: np.ndarray) -> int | None:
    """Signed 64-bit key of a set; None for the empty one."""
    if not len(grams):
        return None
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63)


def least_shared(n: int, percent: int) -> int:
    """Grams that a partner of a text of n grams has in common with it at least."""
    return -(-n * percent // 100)


def _slots(grams: np.ndarray, row: int) -> np.ndarray:
    mixed = _mix(grams + PRIMES[row])
    return (mixed >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """One row per text (doc_id, n_grams, class) and, per task, blocks of the gram counts as packed arrays."""
    schema = struct("doc_id bigint, n_grams bigint, class bigint, part int, counts binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        waiting: list[np.ndarray] = []
        held = 0
        seen = False

        def count() -> None:
            for row in range(SKETCH_ROWS):
                np.add.at(counts[row], _slots(np.concatenate(waiting), row), 1)
            waiting.clear()

        for batch in (part for whole in batches for part in slices(whole)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes, classes = [], []
            for text in texts:
                grams = gram_set(text, n)
                sizes.append(len(grams))
                classes.append(class_key(grams))
                waiting.append(grams)
                held += len(grams)
                if held >= COUNT_AT_ONCE:
                    count()
                    seen, held = True, 0
            k = len(ids)
            cols = [ids, sizes, classes, [None] * k, [None] * k]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
        if held:
            count()
        if seen or held:
            parts = counts.reshape(SKETCH_PARTS, -1)
            packed = [zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in parts]
            k = SKETCH_PARTS
            cols = [[None] * k, [None] * k, [None] * k, list(range(k)), packed]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def _sketch(stored: DataFrame) -> np.ndarray:
    """Sum the tasks' counts, part by part, and bring the fixed-size sketch to the driver."""
    blobs = stored.filter("part is not null").select("part", "counts")

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                total[part] = total[part] + values if part in total else values
        for part, values in total.items():
            packed = zlib.compress(np.minimum(values, 2**32 - 1).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                              "counts": pa.array([packed], pa.binary())})

    ddl = struct("part int, counts binary")
    # Two levels of partial sums, so that one task adds up only a share of the tasks' arrays.
    spread = blobs.repartition(SKETCH_PARTS, "part", F.pmod(F.xxhash64("counts"), F.lit(4)))
    rows = map_arrow(map_arrow(spread, add, ddl).repartition(SKETCH_PARTS, "part"), add, ddl).collect()
    out = np.zeros((SKETCH_PARTS, (SKETCH_ROWS << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out.reshape(SKETCH_ROWS, -1)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Class of every counter: 0 up to CLASS_UNIT above the mean load, then one more at each doubling."""
    load = counts.mean(axis=1, keepdims=True)
    excess = np.maximum(counts - load, 1) / CLASS_UNIT
    return np.clip(np.floor(np.log2(np.maximum(excess, 0.5))) + 1, 0, 60).astype(np.uint8)


def _prefixes(docs: DataFrame, classes, n: int, percent: int) -> DataFrame:
    """The first n - T + r grams of every text in the corpus order, each with its frequency class."""

    def start():
        table = classes.value

        def work(c):
            gram, cls, size, long = [], [], [], []
            for text in c["text"]:
                grams = gram_set(text, n)
                if not len(grams):
                    continue
                least = least_shared(len(grams), percent)
                take = len(grams) - least + min(SHARED, least)
                level = np.minimum.reduce([table[row][_slots(grams, row)] for row in range(SKETCH_ROWS)])
                scrambled = _mix(grams + PRIMES[4])
                first = np.lexsort((scrambled, level))[:take]
                gram.append(grams[first].view(np.int64))
                cls.append(np.full(take, class_key(grams), np.int64))
                size.append(np.full(take, len(grams), np.int32))
                long.append(level[first] > 0)
            names = {"gram": (gram, np.int64), "class": (cls, np.int64), "n": (size, np.int32), "long": (long, bool)}
            return {k: np.concatenate(v) if v else np.empty(0, t) for k, (v, t) in names.items()}
        return work

    return map_columns(docs.select("text"), start, "gram bigint, class bigint, n int, long boolean")


def _fits(a: str, b: str, percent: int):
    """Whether two set sizes can reach the similarity at all."""
    small, large = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return F.lit(100) * small.cast("bigint") >= F.lit(percent) * large.cast("bigint")


def _short_candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Merge the short lists: pairs of classes that meet in at least min(r, T) of them."""
    a = postings.select("gram", F.col("class").alias("a"), F.col("n").alias("na"))
    b = postings.select("gram", F.col("class").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "gram").filter((F.col("a") < F.col("b")) & _fits("na", "nb", percent))
    small = F.least("na", "nb").cast("bigint")
    needed = F.least(F.lit(SHARED), F.ceil(small * percent / F.lit(100)))
    return met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= needed).select(
        "a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Gram arrays of one member of every wanted class (class, doc_id)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        wanted.select("doc_id", "class"), "doc_id")

    def start():
        def work(c):
            sets = [gram_set(t, n) for t in c["text"]]
            # A repeated doc_id may bring another text along; only the class's own counts.
            kept = [(k, s) for k, s in zip(c["class"], sets) if class_key(s) == k]
            return {"class": [k for k, _ in kept], "grams": [s.view(np.int64) for _, s in kept],
                    "n": [len(s) for _, s in kept]}
        return work

    found = map_columns(texts.select("class", "text"), start, "class bigint, grams array<bigint>, n int")
    return found.dropDuplicates(["class"])


def _probed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Probe the whole gram arrays of candidate pairs and keep those that reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("class").alias("b"), F.col("grams").alias("gb"))

    def start():
        def work(c):
            keep = []
            for x, y in zip(c["ga"], c["gb"]):
                x, y = np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64)
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                both = int((long[at] == short).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            return {k: [v for v, ok in zip(c[k], keep) if ok] for k in ("a", "b")}
        return work

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    return map_columns(joined, start, "a bigint, b bigint")


def forest(keys: np.ndarray, sets: list[np.ndarray], percent: int, first: int) -> list[tuple[int, int]]:
    """Links among sets that join parts still apart. Only pairs of one before and one from ``first`` on count,
    or all pairs where ``first`` is 0.

    Overlaps of all members are counted together: the incidence of members and grams is
    multiplied with itself, over blocks of grams, and links are read off row by row.
    """
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), sizes)
    grams, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    renamed = np.cumsum(times > 1) - 1
    owner, column = owner[shared], renamed[column[shared]]
    width, top = 2048, int((times > 1).sum())
    overlap = np.zeros((k, k), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, top, width):
        lo, hi = np.searchsorted(column, [low, low + width])
        block = np.zeros((k, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - low] = 1
        overlap += block @ block.T
    part = np.arange(k)
    out = []
    for low in range(0, first or k, STRIP):
        strip = overlap[low:min(low + STRIP, first or k)].astype(np.int64)
        linked = 100 * strip >= percent * (sizes[low:low + len(strip), None] + sizes[None, :] - strip)
        for i, row in enumerate(linked, low):
            begin = first or i + 1
            others = begin + np.flatnonzero(row[begin:] & (part[begin:] != part[i]))
            if len(others):
                # One link to each part that is still apart; all of them become the part of i.
                met, at = np.unique(part[others], return_index=True)
                out += [(int(keys[i]), int(keys[j])) for j in others[at]]
                part[np.isin(part, met)] = part[i]
    return out


def _long_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare the members of every long list, block against block.

    Members of a list are divided by set size into ranges of one quotient percent / 100; partners
    lie in the same range or the next. A range is cut into blocks of about BLOCK_GRAMS grams and
    BLOCK_MEMBERS members, whichever gives more blocks, so that neither the sets nor the matrix of a task grow.
    """
    step = math.log(100 / percent) if percent < 100 else 1e-9
    sized = members.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9)))
    blocks = sized.groupBy("gram", "range").agg(
        F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_GRAMS), F.count(F.lit(1)) / F.lit(BLOCK_MEMBERS))).cast("int").alias(
            "blocks"), F.count(F.lit(1)).alias("count"))
    # Every member of range g goes to the pairs (g, g) and, if range g + 1 or g - 1 has members, to those too.
    upper = blocks.select("gram", (F.col("range") - 1).alias("range"), F.col("blocks").alias("above"))
    lower = blocks.select("gram", (F.col("range") + 1).alias("range"), F.col("blocks").alias("below"))
    plan = blocks.join(upper, ["gram", "range"], "left").join(lower, ["gram", "range"], "left")
    plan = plan.filter("count > 1 or above is not null or below is not null")
    placed = sized.join(plan, ["gram", "range"]).withColumn(
        "block", F.pmod(F.xxhash64("class", "gram"), F.col("blocks")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(
        F.col("range").alias("r1"), F.least(F.col("block"), i).alias("b1"),
        F.col("range").alias("r2"), F.greatest(F.col("block"), i).alias("b2"),
        (F.col("block") > i).alias("second")))
    up = F.transform(F.sequence(F.lit(0), F.coalesce("above", F.lit(1)) - 1), lambda i: F.struct(
        F.col("range").alias("r1"), F.col("block").alias("b1"), (F.col("range") + 1).alias("r2"), i.alias("b2"),
        F.lit(False).alias("second")))
    down = F.transform(F.sequence(F.lit(0), F.coalesce("below", F.lit(1)) - 1), lambda i: F.struct(
        (F.col("range") - 1).alias("r1"), i.alias("b1"), F.col("range").alias("r2"), F.col("block").alias("b2"),
        F.lit(True).alias("second")))
    none = F.array().cast(own_type := "array<struct<r1:bigint,b1:int,r2:bigint,b2:int,second:boolean>>")
    places = F.concat(
        own.cast(own_type), F.when(F.col("above").isNotNull(), up.cast(own_type)).otherwise(none),
        F.when(F.col("below").isNotNull(), down.cast(own_type)).otherwise(none))
    spread = placed.select("gram", "class", F.explode(places).alias("p")).select("gram", "class", "p.*")
    keyed = spread.withColumn("key", F.xxhash64("gram", "r1", "b1", "r2", "b2"))
    carried = keyed.join(sets.select("class", "grams"), "class").select("key", "second", "class", "grams")
    dealt = carried.repartition("key").sortWithinPartitions("key", "second")
    ddl = "a bigint, b bigint"

    def run(batches):
        key, group = None, []

        def links():
            if len(group) < 2:
                return []
            first = sum(1 for s, _, _ in group if not s)
            return forest(np.array([c for _, c, _ in group], np.int64), [g for _, _, g in group], percent,
                          first if 0 < first < len(group) else 0)

        for batch in batches:
            out = []
            values = [batch.column(i).to_pylist() for i in range(3)]
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ends = lists.offsets.to_numpy()
            for i, (k, second, cls) in enumerate(zip(*values)):
                if k != key:
                    out += links()
                    key, group = k, []
                group.append((second, cls, flat[ends[i]:ends[i + 1]].copy()))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()),
                                              "b": pa.array([y for _, y in out], pa.int64())})
        out = links()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()),
                                          "b": pa.array([y for _, y in out], pa.int64())})

    return map_arrow(dealt, run, struct(ddl))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (a, b): (node, root).

    Large-star and small-star steps alternate over stored tables until no edge changes;
    a step is one aggregate by node and one join, and no neighbourhood is gathered.
    """
    current = scratch.store(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
                            .filter("u != v").distinct(), "edges-0")
    turn, mark = 0, None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"),
                                                                                    F.col("m").alias("v")))
        turn += 1
        current = scratch.store(small.filter("u != v").distinct(), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_grams, class (null for an empty set), n_links, component_id.

    ``n_links`` counts the links found from the row's class to other classes; within a
    component they connect it, though not every link inside a long list is returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    stored = scratch.store(_summaries(docs, n), "summaries")
    rows = stored.filter("part is null").select("doc_id", "n_grams", "class")
    classes = spark.sparkContext.broadcast(frequency_classes(_sketch(stored)))
    members = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    postings = scratch.store(_prefixes(docs, classes, n, percent).distinct(), "postings")
    pairs = scratch.store(_short_candidates(postings.filter("not long").drop("long"), percent), "pairs")
    long = postings.filter("long").drop("long")
    several = long.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram")
    long = scratch.store(long.join(several, "gram"), "long")
    scratch.drop("postings")
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).unionByName(
        long.select("class")).distinct()
    sets = scratch.store(_sets(docs, members.join(wanted, "class"), n), "sets")
    links = scratch.store(_probed(pairs, sets, percent).unionByName(_long_links(long, sets, percent)).distinct(),
                          "links")
    scratch.drop("pairs", "long", "sets")
    roots = components(links, scratch)
    degree = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy(
        "class").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = scratch.store(rooted.select("class", "root").join(lowest, "root").join(degree, "class", "left").select(
        "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id"), "known")
    return rows.join(known, "class", "left").select(
        "doc_id", "n_grams", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Keep one row of each group, one with the smallest doc_id; rows of an empty set and rows without a doc_id all stay.

    Where doc_ids repeat, rows are told apart by their class as well, so a row goes only if its own
    text has a copy.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    groups = scratch.store(jaccard_groups(docs, n, percent).select("doc_id", "class", "component_id"), "groups")
    lost = groups.filter("class is not null and doc_id is not null and component_id < doc_id").select("doc_id", "class")
    repeated = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not repeated.limit(1).count():
        return docs.join(lost.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

    def start():
        def work(c):
            return c | {"class_of_": [class_key(gram_set(t, n)) for t in c["text"]]}
        return work

    ddl = ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes), "class_of_ bigint"])
    classed = map_columns(docs, start, ddl)
    left = classed.join(lost.distinct().withColumnRenamed("class", "class_of_"), ["doc_id", "class_of_"], "left_anti")
    alone = F.col("doc_id").isNull() | F.col("class_of_").isNull()
    firsts = left.filter(~alone).dropDuplicates(["doc_id", "class_of_"])
    return firsts.unionByName(left.filter(alone)).select(*[F.col(f"`{c}`") for c in docs.columns])
