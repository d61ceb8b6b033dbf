import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dayloom.llm import packing, token_counts, tokens

WORDS, BYTES, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
ODD = ["İstanbul ΣΑΣ Ｆｕｌｌ ﬁ é don't I'LL x\x00y a\x1fb <|endoftext|> ½ ² 漢字  nb Ⅷ", "", "  ", "a'sb 's 'S   z",
       "\x01", "ŉ ǅ Ǆ", "a\n b  c", " a", "a ", "\x85x\xa0y \xa0 \xa0 z", "<|startoftext|>x"]


@pytest.fixture(scope="module")
def texts(documents):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab  \n\t\xa0'sé1!\x85") for _ in range(30)) for _ in range(3000)]
    return [r["text"] for r in documents.select("text").limit(60).collect()] + ODD + made


def test_ids_equal_the_library(texts):
    library, own = Tokenizer.from_file(WORDS), tokens.WordTokens(WORDS)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(pa.array(texts))] == expected
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == expected


def test_counts_equal_the_library(texts):
    library, own = Tokenizer.from_file(BYTES), tokens.TokenCounter(BYTES, RANKS)
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.count_all(pa.array(texts)) == expected
    assert [own.count(t) for t in texts] == expected
    assert len(own.whole) > 45_000 and " the" in own.whole


def test_results_do_not_depend_on_what_is_remembered(texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    monkeypatch.setattr(tokens, "SLICE", 500)
    own, other = tokens.WordTokens(WORDS), tokens.TokenCounter(BYTES, RANKS)
    monkeypatch.undo()
    full, more = tokens.WordTokens(WORDS), tokens.TokenCounter(BYTES, RANKS)
    arr = pa.array(texts)
    expected = full.encode_all(arr), more.count_all(arr)
    monkeypatch.setattr(tokens, "CACHE", 5)
    monkeypatch.setattr(tokens, "SLICE", 500)
    assert (own.encode_all(arr), other.count_all(arr)) == expected


def test_count_query(edge_docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in
                 token_counts.count(edge_docs, BYTES, RANKS).collect())
    rows = [(r["doc_id"] or -1, r["text"] or "") for r in edge_docs.collect()]
    n = [len(library.encode(t, add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((d, len(t.encode()), k, k > 512) for (d, t), k in zip(rows, n))
    assert token_counts.count(no_docs, BYTES, RANKS).count() == 0


def test_plan_fills_like_best_fit_over_single_pieces():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([5, 16, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 12))}
        bins, ranks = {}, {n: [] for n in counts}
        for length, low, high, first, offset in packing.plan(counts, capacity):
            for r in range(low, high):
                ranks[length].append(r)
                bins.setdefault(first + r - low, []).append((offset, length))
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity
        single = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [i for i, room in enumerate(single) if room >= length]
            if fits:
                single[min(fits, key=lambda i: single[i])] -= length
            else:
                single.append(capacity - length)
        assert len(bins) == len(single)


def whole(rows, texts, capacity):
    """Pieces rebuild every document, and sequences are gapless."""
    library = Tokenizer.from_file(WORDS)
    expected = []
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            expected.append((doc or -1, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pack(documents, edge_docs, no_docs):
    rows = packing.pack(documents.repartition(5), WORDS).collect()
    used = whole(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], 2048)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
    whole(packing.pack(edge_docs, WORDS, 16).collect(), [(r["doc_id"], r["text"]) for r in edge_docs.collect()], 16)
    assert packing.pack(no_docs, WORDS).count() == 0
