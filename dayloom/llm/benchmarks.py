"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are reduced to their letters and digits in lower case, with the
source position of each kept. An item of m characters may be repeated with at most
e = floor(m * rate) edits. By the q-gram lemma such a region shares at least
m - q + 1 - q * e of the item's q-grams, and all of them lie on diagonals (text position
minus item position) that differ by e at most. Hits are counted in bands of diagonals 2e + 1
wide that overlap by half, so that one band holds them all; bands that reach the bound are
verified by an alignment confined to the band.

The items are the stated query set. They are read in blocks of ``items_per_block``, each
held against every text, so the set may grow without growing what a task holds.

The bound holds from one shared q-gram on; only an item whose bound is not positive (shorter than q * (e + 1) letters
and digits) gets a smaller edit budget, down to none. An item shorter than q is too little to be searched inside
of words: it matches where its words stand whole and in order in the source, with anything but letters and digits
between them, at every such place; ``matches`` reports that, but it is no ground to drop a document
(``drop_contaminated`` leaves short items out), since a word or two of an item stand in harmless texts too.
Nulls, empty texts and items without letters or digits match nothing. Rows that repeat are searched one by one;
repeated items are all reported. Each (text, item) gives its best region for every band group, least edits first,
leftmost on ties.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import map_columns

Q = 8
RATE = 0.1
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
CHUNK = 1 << 20


def _alphabet() -> np.ndarray:
    """For every code point its lower-case code point where it is a letter or digit, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum():
            low = c.lower()
            table[code] = ord(low[0]) if len(low) == 1 else code
    return table


_table: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    if not _table:
        _table.append(_alphabet())
    return _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 codes from every position, by doubling."""
    h = codes.astype(np.uint64)
    for width in (1, 2, 4):
        power = np.uint64(pow(int(BASE), width, 1 << 64))
        h = h[:-width] * power + h[width:]
    return h ^ (h >> np.uint64(29))


@dataclass
class Item:
    key: int
    codes: np.ndarray
    edits: int
    least: int
    words: tuple[bytes, ...] = ()


@dataclass
class Index:
    items: list[Item]
    short: list[Item]
    grams: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def _words(text: str) -> tuple[bytes, ...]:
    """Runs of letters and digits, lower-cased."""
    codes = _codes(text)
    return tuple(codes[low:high].tobytes() for low, high in _runs(codes > 0))


def _runs(there: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of true values start and end."""
    edge = np.diff(np.concatenate([[False], there, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _short_places(items: list[Item], text: str) -> list[tuple[int, int, int]]:
    """(item key, start, end) of every place where the words of a short item stand whole and in order."""
    codes = _codes(text)
    runs = _runs(codes > 0)
    words = [codes[low:high].tobytes() if high - low < Q else b"" for low, high in runs]
    first: dict[bytes, list[Item]] = {}
    for item in items:
        first.setdefault(item.words[0], []).append(item)
    out = []
    for i, word in enumerate(words):
        for item in first.get(word, ()):
            n = len(item.words)
            if tuple(words[i:i + n]) == item.words:
                out.append((item.key, runs[i][0], runs[i + n - 1][1]))
    return out


def build_index(rows: list[tuple[int, str]], rate: float = RATE) -> Index:
    items, short, grams, owner, place = [], [], [], [], []
    for key, text in rows:
        codes = _codes(text or "")
        codes = codes[codes > 0]
        m = len(codes)
        if not m:
            continue
        if m < Q:
            short.append(Item(key, codes, 0, 0, words=_words(text or "")))
            continue
        edits = int(m * rate)
        while edits and m - Q + 1 - Q * edits < 1:
            edits -= 1
        h = _grams(codes)
        grams.append(h)
        owner.append(np.full(len(h), len(items), np.int64))
        place.append(np.arange(len(h), dtype=np.int64))
        items.append(Item(key, codes, edits, max(1, m - Q + 1 - Q * edits)))
    table = np.zeros(1 << FILTER_BITS, bool)
    if not items:
        empty = np.empty(0, np.int64)
        return Index(items, short, np.empty(0, np.uint64), np.zeros(1, np.int64), empty, empty, table)
    g, o, p = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(g, kind="stable")
    g, o, p = g[order], o[order], p[order]
    unique, starts = np.unique(g, return_index=True)
    table[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(items, short, unique, np.append(starts, len(g)), o, p, table)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """Best region of ``text`` for the whole item on the diagonals low..high: (edits, start, end), if few enough.

    Row by row over the item; a row holds the cells of the band only. A cell packs its cost
    above the start of its path, so that the least cost wins and then the leftmost start.
    Beyond the ends of the text stand codes that equal none.
    """
    m, width, n = len(item), high - low + 1, len(text)
    where = np.ascontiguousarray(text).astype("<u4").tobytes()
    word, found = item.astype("<u4").tobytes(), -1
    while (found := where.find(word, found + 1)) >= 0 and found % 4:
        pass
    if found >= 0 and low <= found // 4 <= high:
        return 0, found // 4, found // 4 + m
    before = max(0, -low)
    padded = np.zeros(before + max(n, high + m) + 1, np.uint32)
    padded[before:before + n] = text
    one = 1 << 32
    steps = np.arange(width, dtype=np.int64) * one
    cell = np.clip(low + np.arange(width, dtype=np.int64), 0, n)
    above = np.empty(width, np.int64)
    for i in range(m):
        at = before + low + i
        above[:-1] = cell[1:]
        above[-1] = one << 20
        best = np.minimum(cell + (padded[at:at + width] != item[i]) * one, above + one)
        # Moves along the row: running minimum of cost minus position.
        cell = np.minimum.accumulate(best - steps) + steps
        if i % 16 == 15 and int(cell.min()) >> 32 > edits:
            return None
    end = int(np.argmin(cell >> 32))
    cost, start = int(cell[end]) >> 32, int(cell[end]) & (one - 1)
    if cost > edits:
        return None
    return cost, start, min(max(low + m + end, 0), n)


def _regions(index: Index, codes: np.ndarray, position: np.ndarray, slot: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches within one text: (item index, edits, start, end) in reduced positions.

    ``position`` are the places of hits in ``codes``, ``slot`` their numbers among the indexed grams.
    """
    counts = index.starts[slot + 1] - index.starts[slot]
    at = np.repeat(position, counts)
    which = np.repeat(index.starts[slot] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(
        counts.sum())
    owner, diagonal = index.owner[which], at - index.place[which]
    edits = np.array([i.edits for i in index.items], np.int64)
    least = np.array([i.least for i in index.items], np.int64)
    # A region needs its item to have enough hits in the whole text at all.
    total = np.bincount(owner, minlength=len(index.items))
    enough = total[owner] >= least[owner]
    owner, diagonal = owner[enough], diagonal[enough]
    if not len(owner):
        return []
    step = edits[owner] + 1
    band = np.floor_divide(diagonal, step)
    keys = np.concatenate([owner, owner]), np.concatenate([band, band - 1])
    packed = keys[0] * (1 << 40) + (keys[1] + (1 << 39))
    found, hits = np.unique(packed, return_counts=True)
    kept = found[hits >= least[found >> 40]]
    out = []
    last = None
    for value in kept.tolist():
        number, b = value >> 40, (value & ((1 << 40) - 1)) - (1 << 39)
        item = index.items[number]
        step = item.edits + 1
        low, high = b * step, (b + 2) * step - 1
        base = max(0, low)
        window = codes[base:high + len(item.codes) + 1]
        got = align(item.codes, window, low - base, high - base, item.edits)
        if got is None:
            continue
        row = (number, got[0], got[1] + base, got[2] + base)
        # Neighbouring bands see the same region; the better of the two stays.
        if last is not None and last[0] == number and row[2] < last[3] and last[2] < row[3]:
            if (row[1], row[2]) < (last[1], last[2]):
                out[-1] = last = row
            continue
        out.append(row)
        last = row
    return out


def _scan(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text index, item key, start, end, edits) with positions in code points of the source."""
    out = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < CHUNK):
            size += len(texts[stop]) + Q
            stop += 1
        # One array for many texts; Q zeros keep grams from running over a border.
        joined = ("\x00" * Q).join(texts[at:stop])
        codes = _codes(joined)
        ends = np.cumsum([len(t) + Q for t in texts[at:stop]])
        kept = np.flatnonzero(codes)
        edges = np.searchsorted(kept, ends)
        small = codes[kept]
        if len(small) >= Q and len(index.grams):
            h = _grams(small)
            near = np.flatnonzero(index.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(index.grams, h[near]), len(index.grams) - 1)
            true = index.grams[slot] == h[near]
            near, slot = near[true], slot[true]
            text_of = np.searchsorted(edges, near, side="right")
            # A gram that runs into the next text belongs to none.
            whole = near + Q <= edges[np.minimum(text_of, len(edges) - 1)]
            near, slot, text_of = near[whole], slot[whole], text_of[whole]
            fewest = min(i.least for i in index.items)
            bounds = np.searchsorted(text_of, np.arange(stop - at + 1))
            for t in np.flatnonzero(np.diff(bounds) >= fewest).tolist():
                base = int(edges[t - 1]) if t else 0
                lo, hi = bounds[t], bounds[t + 1]
                own = small[base:edges[t]]
                source = kept[base:edges[t]] - (int(ends[t - 1]) if t else 0)
                for number, edits, start, end in _regions(index, own, near[lo:hi] - base, slot[lo:hi]):
                    if end > start:
                        out.append((at + t, index.items[number].key, int(source[start]), int(source[end - 1]) + 1, edits))
        if index.short:
            for t in range(at, stop):
                out += [(t, key, start, end, 0) for key, start, end in _short_places(index.short, texts[t])]
        at = stop
    return out


def _item_blocks(benchmark: DataFrame, items_per_block: int):
    """The query set, block after block."""
    items = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("bigint").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // items_per_block))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, items_per_block: int = 5000) -> DataFrame:
    """All regions of texts that repeat an item: doc_id, item_id, start, end (code points, end exclusive), edits."""
    ddl = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int"
    out = None
    for rows in _item_blocks(benchmark, items_per_block):
        def start(rows=rows):
            index = build_index(rows, rate)

            def work(c):
                texts = [t or "" for t in c["text"]]
                found = _scan(index, texts)
                return {"doc_id": [c["doc_id"][f[0]] for f in found], "item_id": [f[1] for f in found],
                        "start": [f[2] for f in found], "end": [f[3] for f in found], "edits": [f[4] for f in found]}
            return work

        part = map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), start, ddl)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE,
                      items_per_block: int = 5000) -> DataFrame:
    """The rows of ``docs`` whose text repeats no item of Q letters and digits or more."""
    out = docs
    for rows in _item_blocks(benchmark, items_per_block):
        def start(rows=rows):
            long = replace(build_index(rows, rate), short=[])

            def work(c):
                hit = {f[0] for f in _scan(long, [t or "" for t in c["text"]])}
                return {k: [x for i, x in enumerate(v) if i not in hit] for k, v in c.items()}
            return work

        out = map_columns(out, start, ", ".join(f"`{n}` {kind}" for n, kind in docs.dtypes))
    return out
