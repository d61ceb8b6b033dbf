"""Near copies by MinHash signatures and a multi-index Hamming join, confirmed on full sets.

A text is the set of its distinct word n-grams. Its signature has ``INDEXED`` symbols of 16 bits and ``FURTHER``
symbols of 8 bits, one per hash function: that of the smallest gram. Two texts of similarity s differ in a symbol
with chance 1 - s, so those that link differ in ``errors`` symbols at most, but for a chance below 10^-6 for a pair at
the very threshold. All pairs of signatures up to that distance in the indexed symbols are found, whatever their number:

* *Chunks.* The indexed symbols are cut into ``errors // 2 + 1`` chunks. By the pigeonhole principle one of them
  differs in one symbol at most. Every chunk is posted under all keys that one error allows: the chunk
  with each of its symbols masked in turn. Two signatures within the distance share a key; of the buckets that
  they share, the first one reports them.
* *Stars.* In each bucket (key) texts are compared with the bucket's first and last text, one comparison per text.
  Confirmed links join texts into parts; a bucket that lies in one part has nothing left to find, so a group of n
  copies costs about n comparisons and not n^2.
* *Nearest.* In buckets of up to ``SMALL`` rows that still hold several parts a join spells out the pairs, at most SMALL a
  row; each text names the nearest one of another part, which is confirmed, and parts grow together. What is still within
  the distance, in different parts, is confirmed pair by pair.
* *Cells.* Larger buckets are compared cell against cell in bounded tasks, cells of one part never against each other.
  Signatures, all symbols of them, and full sets meet inside the task, and only links that join parts leave it, fewer than
  its rows: texts that are alike but do not link are never spelled out as pairs.

Nothing is capped or sampled: the result is the connected components of all links between signatures within the
distance. Equal sets are one class and are compared once. Nulls and texts without words have an empty set and link
with nothing; a text with fewer than n words is one gram. A null doc_id takes part in links; its component is the
smallest doc_id that is not null (null when there is none). Repeated rows and doc_ids are rows of their own. An
empty table gives an empty result. Columns other than doc_id and text are not read.

Intermediate tables stay below the scratch folder until ``clear_scratch``, apart from those dropped on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch, map_arrow, map_columns, struct
from dayloom.llm.ngrams import PRIMES, _mix, class_key, components, gram_set

INDEXED = 64
FURTHER = 448
POSITIONS = INDEXED + FURTHER
#: Share of pairs at the very threshold that signatures may miss.
LOST = 1e-6
GRAMS_AT_ONCE = 1 << 16
NEAREST = 1
SMALL = 16
#: Rows in a cell; a row of more than HEAVY grams counts as several.
CELL = 2048
HEAVY = 1024
STRIP = 64
FAN = 256
_RNG = np.random.default_rng(13)
FACTORS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def errors(percent: int, symbols: int, lost: float = LOST) -> int:
    """In how many of so many symbols texts of this similarity differ at most, but for a chance below ``lost``."""
    miss = 1 - percent / 100
    tail, most = 0.0, symbols
    while most > 1 and (tail := tail + math.comb(symbols, most) * miss**most * (1 - miss) ** (symbols - most)) < lost:
        most -= 1
    return most


SIGNATURE = np.dtype([("index", np.uint16, INDEXED), ("further", np.uint8, FURTHER)])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One SIGNATURE per set; sets must not be empty."""
    lengths = np.array([len(s) for s in sets], np.int64)
    least = np.empty((len(sets), POSITIONS), np.uint64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GRAMS_AT_ONCE, "right")))
        block = sets[first:last]
        if len(block) == 1 and lengths[first] > GRAMS_AT_ONCE:  # a long text: its parts, then the least of them
            parts = np.array_split(block[0], -(-len(block[0]) // GRAMS_AT_ONCE))
            least[first] = np.min([_least(p, np.zeros(1, np.int64))[0] for p in parts], axis=0)
        else:
            starts = ends[first:last] - lengths[first:last] - (ends[first - 1] if first else 0)
            least[first:last] = _least(np.concatenate(block), starts)
        first = last
    mixed = _mix(least)
    out = np.empty(len(sets), SIGNATURE)
    out["index"], out["further"] = mixed[:, :INDEXED].astype(np.uint16), mixed[:, INDEXED:].astype(np.uint8)
    return out


def _least(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), POSITIONS), np.uint64)
    hashed = np.empty_like(grams)
    for i in range(POSITIONS):
        np.multiply(grams, FACTORS[i], out=hashed)
        np.add(hashed, SHIFTS[i], out=hashed)
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def chunk_bounds(distance: int) -> list[tuple[int, int]]:
    """Chunks of which one has one error at most where all have ``distance`` together."""
    chunks = distance // 2 + 1
    cuts = [INDEXED * i // chunks for i in range(chunks + 1)]
    return list(zip(cuts, cuts[1:]))


def keys_of(symbols: np.ndarray, distance: int) -> np.ndarray:
    """INDEXED keys per row of indexed symbols: every chunk with each one of its symbols masked."""
    out = np.empty((len(symbols), INDEXED), np.uint64)
    for low, high in chunk_bounds(distance):
        for masked in range(low, high):
            h = np.full(len(symbols), masked + 1, np.uint64)
            for i in range(low, high):
                if i != masked:
                    h = _mix(h * PRIMES[0] + symbols[:, i])
            out[:, masked] = _mix(h)
    return out.view(np.int64)


def first_shared(differ: np.ndarray, distance: int) -> np.ndarray:
    """The place of the first key that two signatures share, by where their indexed symbols differ; -1 for none."""
    bounds = chunk_bounds(distance)
    wrong = np.add.reduceat(differ, [low for low, _ in bounds], axis=1, dtype=np.int32)
    chunk = (wrong <= 1).argmax(axis=1)
    rows = np.arange(len(differ))
    low = np.array([low for low, _ in bounds])[chunk]
    after = (np.arange(INDEXED) >= low[:, None]) & differ
    count = wrong[rows, chunk]
    return np.where(count > 1, -1, np.where(count == 0, low, after.argmax(axis=1)))


def _symbols(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), SIGNATURE)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row_key (of doc_id and text), size, class and signature of every row."""
    def start():
        def work(c):
            sets = [gram_set(t, n) for t in c["text"]]
            there = [s for s in sets if len(s)]
            found = iter(signatures(there) if there else [])
            return {"doc_id": c["doc_id"], "row_key": c["row_key"], "size": [len(s) for s in sets],
                    "class": [class_key(s) for s in sets], "sig": [next(found).tobytes() if len(s) else None for s in sets]}
        return work

    return map_columns(_keyed(docs), start, "doc_id bigint, row_key bigint, size bigint, class bigint, sig binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.xxhash64("doc_id", "text").alias("row_key"))


def _postings(classes: DataFrame, distance: int) -> DataFrame:
    """(key, place, class): every class under the keys of its signature."""
    def run(batches):
        for batch in batches:
            keys = keys_of(_symbols(batch.column(1))["index"], distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(INDEXED, dtype=np.int32), len(keys))),
                 pa.array(np.repeat(batch.column(0).to_numpy(), INDEXED))], ["key", "place", "class"])

    return map_arrow(classes.select("class", "sig"), run, struct("key bigint, place int, class bigint"))


def _reach(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar at all."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _apart_by(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many symbols signatures differ."""
    return ((x["index"] != y["index"]).sum(axis=1) + (x["further"] != y["further"]).sum(axis=1)).astype(np.int32)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, d): pairs whose sizes fit and whose signatures differ in d symbols, few enough to link."""
    left = classes.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("sig").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").filter(_reach(F.col("na"), F.col("nb"), percent))
    most = errors(percent, POSITIONS)

    def run(batches):
        for batch in batches:
            apart = _apart_by(_symbols(batch.column(2)), _symbols(batch.column(3)))
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], ["a", "b", "d"])
            yield found.filter(pa.array(apart <= most))

    return map_arrow(joined.select("a", "b", "sa", "sb"), run, struct("a bigint, b bigint, d int"))


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    The text of ``a`` travels once for every FAN partners, that of ``b`` once a pair; a task holds one ``a``.
    """
    pairs = pairs.select("a", "b")
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("parts"))
    left = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("second"),
                      F.col("a").alias("class"))
    right = pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"),
                                        F.lit(True).alias("second"), F.col("b").alias("class"))
    carried = left.unionByName(right).join(texts, "class").select("a", "part", "second", "class", "text")
    dealt = carried.repartition("a", "part").sortWithinPartitions("a", "part", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            out = []
            for a, part, second, cls, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                grams = gram_set(text, n)
                if not second:
                    at, mine = (a, part), grams
                elif at == (a, part):
                    if _link(mine, grams, percent):
                        out.append((a, cls))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()),
                                              pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return map_arrow(dealt, run, struct("a bigint, b bigint"))


def _parted(live: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows (key, place, class) with the part that their class is in by now."""
    if parts is None:
        return live.withColumn("part", F.col("class"))
    return live.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))


def _buckets(rows: DataFrame) -> DataFrame:
    """Buckets of several parts: (key, c, r1, r2), with the count of their rows, their first and their last class."""
    return rows.groupBy("key").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("c"), F.min("class").alias("r1"),
        F.max("class").alias("r2")).filter("low != high").drop("low", "high")


def _apart(pairs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Pairs (a, b, ...) whose ends are in different parts, as (…, pa, pb)."""
    if parts is None:
        return pairs.withColumn("pa", F.col("a")).withColumn("pb", F.col("b")).filter("pa != pb")
    for end in ("a", "b"):
        known = parts.select(F.col("class").alias(end), F.col("part").alias(f"p{end}"))
        pairs = pairs.join(known, end, "left").withColumn(f"p{end}", F.coalesce(f"p{end}", end))
    return pairs.filter("pa != pb")


def _cells(live: DataFrame, members: DataFrame, distance: int, percent: int, n: int) -> DataFrame:
    """(a, b): links that join parts, in large buckets, cell against cell; all links of a task join no others.

    A part with many rows in a bucket has cells of its own, the others share cells; a row travels to
    every cell of its bucket but those of its own part. ``members`` has size, sig and text of the classes in ``live``.
    """
    weighed = live.withColumn("weight", F.lit(1) + F.col("size") / F.lit(HEAVY))
    sized = weighed.groupBy("key", "part").agg(F.sum("weight").alias("c"))
    own = F.col("c") >= CELL // 2
    pooled = sized.filter(~own).groupBy("key").agg(F.ceil(F.sum("c") / F.lit(CELL)).cast("int").alias("pools"))
    plan = sized.join(pooled, "key", "left").select(
        "key", "part", F.when(own, F.col("part")).alias("owner"),
        F.when(own, F.ceil(F.col("c") / F.lit(CELL))).otherwise(F.col("pools")).cast("int").alias("cells"))
    rows = live.drop("size").join(plan, ["key", "part"]).withColumn("cell", F.pmod(
        F.when(F.col("owner").isNull(), F.xxhash64("part")).otherwise(F.xxhash64("class")), F.col("cells")).cast("int"))
    mine = F.struct(F.coalesce("owner", F.lit(0)).alias("owner"), F.col("owner").isNotNull().alias("own"), F.col("cell"))
    rows = rows.withColumn("mine", mine)
    there = rows.select("key", F.col("mine").alias("other")).distinct()
    spread = rows.join(there, "key").filter(
        ~(F.col("mine.own") & F.col("other.own") & (F.col("mine.owner") == F.col("other.owner"))))
    task = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    # What a class is compared by is looked up once, whatever the number of its tasks.
    tasks = spread.groupBy("class", "part").agg(F.collect_list(F.struct(
        task.alias("task"), "place", (F.col("mine") > F.col("other")).alias("second"))).alias("tasks"))
    carried = tasks.join(members.select("class", "size", "sig", "text"), "class").select(
        F.inline("tasks"), "part", "class", "size", "sig", "text")
    dealt = carried.repartition("task").sortWithinPartitions("task", "second")

    def run(batches):
        task, held = None, []

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in compared(held, distance, percent, n)], ["a", "b"])

        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)] if len(tasks) else []
            for low, high in zip(cuts, cuts[1:]):
                if held and tasks[low] != task:
                    yield found()
                    held = []
                task = tasks[low]
                part = batch.slice(low, high - low)
                held.append((*(part.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)), _symbols(part.column(6)),
                             part.column(7).to_pylist()))
        if held:
            yield found()

    return map_arrow(dealt, run, struct("a bigint, b bigint"))


def compared(held: list[tuple], distance: int, percent: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between first and second rows, or among all where there is one kind: those that join parts, nearest first.

    Signatures choose the pairs, those whose first shared key is that of this bucket; full sets confirm them.
    """
    place, second, part, cls, size, sig = (np.concatenate([h[i] for h in held]) for i in range(6))
    texts = [t for h in held for t in h[6]]
    sets: dict[int, np.ndarray] = {}
    group = np.unique(part, return_inverse=True)[1]
    most = errors(percent, POSITIONS)
    cut = int((~second.astype(bool)).sum())
    once = cut in (0, len(cls))
    rows = range(len(cls)) if once else range(cut)
    columns = np.arange(0 if once else cut, len(cls))
    links: list[tuple[int, int]] = []
    for low in range(0, len(rows), STRIP):
        strip = np.arange(low, min(low + STRIP, len(rows)))
        small, large = np.minimum.outer(size[strip], size[columns]), np.maximum.outer(size[strip], size[columns])
        keep = (group[strip][:, None] != group[columns]) & (100 * small >= percent * large)
        if once:
            keep &= strip[:, None] < columns
        i, j = np.nonzero(keep)
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
        for at in range(0, len(i), 1 << 15):
            x, y = strip[i[at:at + (1 << 15)]], columns[j[at:at + (1 << 15)]]
            differ = sig["index"][x] != sig["index"][y]
            near = differ.sum(axis=1) <= distance
            x, y, differ = x[near], y[near], differ[near]
            apart = _apart_by(sig[x], sig[y])
            near = (apart <= most) & (first_shared(differ, distance) == place[0])
            out.append((x[near], y[near], apart[near]))
        a, b, d = (np.concatenate([o[k] for o in out]) for k in range(3))
        order = np.argsort(d, kind="stable")
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if group[x] != group[y]:
                for end in (x, y):
                    if end not in sets:
                        sets[end] = gram_set(texts[end], n)
                if _link(sets[x], sets[y], percent):
                    links.append((x, y))
                    group[group == group[y]] = group[x]
    ends = np.array(links, np.int64).reshape(-1, 2)
    return cls[ends[:, 0]], cls[ends[:, 1]]


def near_copy_groups(docs: DataFrame, n: int = 5, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    distance = errors(percent, INDEXED)
    rows = scratch.store(_described(docs, n), "rows")
    # The signature follows from the class, so it is a key of the group and not a value to pick.
    classes = scratch.store(rows.filter("class is not null").groupBy("class", "size", "sig").agg(
        F.min("row_key").alias("row_key"), F.min("doc_id").alias("lowest")), "classes")
    links, parts, turn = None, None, 0

    def linked(pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Confirm pairs, and find the parts anew from the links that hold and ``more`` that are known to."""
        nonlocal links, parts, turn
        new = confirmed(pairs, texts, n, percent)
        new = scratch.store(new if more is None else new.unionByName(more), f"links-{turn}")
        if new.limit(1).count():
            # Within a part one link to its root stands for all.
            links = new if parts is None else new.unionByName(parts.select(F.col("class").alias("a"), F.col("part").alias("b")))
            found = components(links, Scratch(spark, "minhash-parts")).select(
                F.col("node").alias("class"), F.col("root").alias("part"))
            parts = scratch.store(found, f"parts-{turn}")
        turn += 1

    posted = _parted(_postings(classes, distance), None)
    live = scratch.store(posted.join(_buckets(posted), "key").drop("part"), "live")
    wanted = live.select("class").distinct().join(classes.select("class", "row_key"), "class")
    texts = scratch.store(_keyed(docs).select("row_key", "text").join(wanted, "row_key").dropDuplicates(["class"]).select(
        "class", "text"), "texts")
    reps = live.select("class", F.col("r1").alias("rep")).unionByName(live.select("class", F.col("r2").alias("rep")))
    met = reps.filter("class != rep").groupBy("class", "rep").agg(F.count(F.lit(1)).alias("c"))
    # The star that a class meets in most buckets is its nearest, as far as buckets tell.
    best = met.groupBy("class").agg(F.max_by("rep", "c").alias("a")).select("a", F.col("class").alias("b"))
    linked(_near(best, classes, percent))
    known = _parted(live.select("key", "place", "class", "c"), parts)
    rest = scratch.store(known.join(_buckets(known).select("key"), "key").drop("part"), "rest")
    scratch.drop("live")
    few, many = rest.filter(F.col("c") <= SMALL), rest.filter(F.col("c") > SMALL)
    # A row per class, with its keys: at most INDEXED.
    many = many.groupBy("class").agg(F.collect_list(F.struct("key", "place")).alias("keys"))
    many = scratch.store(many.join(classes.select("class", "size", "sig"), "class").join(texts, "class"), "many")
    small = _parted(few.select("key", "class"), parts)
    met = small.select("key", F.col("class").alias("a"), F.col("part").alias("pa")).join(
        small.select("key", F.col("class").alias("b"), F.col("part").alias("pb")), "key").filter("a < b and pa != pb")
    near = scratch.store(_near(met.select("a", "b").distinct(), classes, percent), "near")
    for _ in range(NEAREST):
        open_ = _apart(near, parts).select("a", "b", "d")
        ends = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        first = ends.groupBy("a").agg(F.min_by("b", "d").alias("b"))
        linked(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    large = _parted(many.select("class", "size", "keys"), parts).select("class", "size", "part", F.inline("keys"))
    large = scratch.store(large.join(_buckets(large).select("key"), "key"), "large")
    linked(_apart(near, parts), _cells(large, many, distance, percent, n))
    scratch.drop("texts", "rest", "near", "many", "large")
    rooted = classes.select("class", "lowest")
    rooted = rooted.withColumn("part", F.col("class")) if parts is None else rooted.join(parts, "class", "left").withColumn(
        "part", F.coalesce("part", "class"))
    known = rooted.join(rooted.groupBy("part").agg(F.min("lowest").alias("component_id")), "part").select("class", "component_id")
    known = scratch.store(known, "known")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(known, "class", "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"),
                                                    F.col("doc_id").eqNullSafe(component).alias("kept"))
