"""Token ids and token counts by the public tokenizers, with the work done once per distinct word.

``WordTokens`` gives the ids of the vocabulary with word ends; ``TokenCounter`` counts the
tokens of the byte-level one. Both cut a text at white space, where no token can run across,
and remember the result of a piece. Texts with characters or strings that the cut does not
hold for go to the tokenizer's own library whole.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

CACHE = 400_000
SEPARATORS = re.compile("[\x00\x01\x1c-\x1f]")
PIECE = re.compile(r"\s*\S+|\s+")
WIDE = re.compile("[^\x02-\u017f]")
# Texts that the vectorised cuts do not hold for: control separators, letters beyond Latin, special strings;
# for counts also spaces at an end or right after other white space.
APART = r"[\x00\x01\x1c-\x1f\x{180}-\x{10ffff}]|<\|"
UNEVEN = r"^ |[\t\n\v\f\r \x{85}\x{a0}] |[ ]\s*$"
SLICE = 1 << 23


def slices(texts: pa.Array):
    """Parts of an array of about SLICE bytes each: (first index, part)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


class Known:
    """Remembered strings, looked up many at a time, each with a number of ids (or just a count)."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.strings = pa.array([], pa.string())
        self.sizes = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)
        self.ids = np.empty(0, np.dtype("<u4"))

    def look_up(self, strings: pa.Array, learn) -> np.ndarray:
        """Places of ``strings``; ``learn`` gives (sizes, ids as bytes) for those not met before."""
        if len(self.sizes) > CACHE:
            self.clear()
        places = pc.index_in(strings, value_set=self.strings)
        unmet = places.is_null()
        out = places.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = strings.filter(unmet)
        if len(new):
            sizes, data = learn(new.to_pylist())
            out[unmet.to_numpy(zero_copy_only=False)] = len(self.sizes) + np.arange(len(new))
            self.strings = pa.concat_arrays([self.strings, new])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.frombuffer(data, np.dtype("<u4"))])
            self.first = np.cumsum(self.sizes) - self.sizes
        return out


def distinct(parts: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct strings of a list array, the number of each element among them, and where the lists start and end."""
    flat = parts.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokens:
    """Ids of texts under a BPE vocabulary whose words carry an end mark.

    The merges run in a byte-pair engine: the end mark is one more byte, which cannot occur in
    UTF-8, and joins the last byte of a word before any merge.
    """

    END = "\x00"
    SPLIT = "\x01"
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\x01]+")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, letters = model["vocab"], byte_letters()
        to_letter = {b: c for c, b in letters.items()}
        mark = self.END.encode()

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return bytes(letters[c] for c in body) + (mark if body != token else b"")

        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(piece: bytes, token_id: int) -> None:
            if piece not in ranks:
                ranks[piece] = len(ids)
                ids.append(token_id)

        for b in range(1, 256):
            add(bytes([b]) + mark, vocab[to_letter[b] + suffix])
        for merge in model["merges"]:
            token = "".join(merge) if isinstance(merge, list) else merge.replace(" ", "")
            add(raw(token), vocab[token])
        for b in range(256):
            add(bytes([b]), vocab.get(to_letter[b], 0))
        self.split_rank = ranks[self.SPLIT.encode()]
        self.engine = tiktoken.Encoding("words", pat_str="[^\x00\x01]+\x00|\x01", mergeable_ranks=ranks,
                                        special_tokens={})
        self.ids = np.array(ids, np.dtype("<u4"))
        self.known: dict[str, bytes] = {}
        self.many = Known()

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.dtype("<u4")).tobytes()

    def _learn(self, words: list[str]) -> None:
        plain = []
        for w in words:
            if WIDE.search(w):
                self.known[w] = self._library(w)
            else:
                plain.append(w)
        if not plain:
            return
        marked = self.WORDS.sub("\\g<0>\x00", self.SPLIT.join(plain).lower())
        ranks = np.array(self.engine.encode_ordinary(marked), np.int64)
        cuts = np.flatnonzero(ranks == self.split_rank)
        data = self.ids[ranks].tobytes()
        start = 0
        for w, cut in zip(plain, [*cuts.tolist(), len(ranks)]):
            self.known[w] = data[4 * start:4 * cut]
            start = cut + 1

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if SEPARATORS.search(text) or any(s in text for s in self.special):
            return self._library(text)
        if len(self.known) > CACHE:
            self.known.clear()
        words = text.split()
        parts = list(map(self.known.get, words))
        if None in parts:
            self._learn(list({w for w, p in zip(words, parts) if p is None}))
            parts = map(self.known.__getitem__, words)
        return b"".join(parts)

    def _learn_many(self, words: list[str]) -> tuple[np.ndarray, bytes]:
        marked = self.WORDS.sub("\\g<0>\x00", self.SPLIT.join(words).lower())
        ranks = np.array(self.engine.encode_ordinary(marked), np.int64)
        split = ranks == self.split_rank
        cuts = np.concatenate([[-1], np.flatnonzero(split), [len(ranks)]])
        return np.diff(cuts) - 1, self.ids[ranks[~split]].tobytes()

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of an array of texts, with each distinct word of a slice looked up once; null counts as empty."""
        texts = texts.fill_null("")
        apart = pc.match_substring_regex(texts, APART)
        out: list[bytes] = [b""] * len(texts)
        for i in pc.indices_nonzero(apart).to_pylist():
            out[i] = self.encode(texts[i].as_py())
        rest = pc.invert(apart)
        where = pc.indices_nonzero(rest).to_numpy()
        for at, part in slices(texts.filter(rest)):
            words, codes, edges = distinct(pc.utf8_split_whitespace(part))
            place = self.many.look_up(words, self._learn_many)[codes]
            sizes = self.many.sizes[place]
            ends = np.cumsum(sizes)
            take = np.repeat(self.many.first[place] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            stream = self.many.ids[take].tobytes()
            bounds = (4 * np.concatenate([[0], ends])[edges]).tolist()
            for k in range(len(part)):
                out[where[at + k]] = stream[bounds[k]:bounds[k + 1]]
        return out


class TokenCounter:
    """Token counts under the byte-level vocabulary.

    ``whole`` holds the vocabulary strings proven to encode alone as one token, by encoding
    each of them once. Pre-tokens among them count one; only the rest are merged.
    """

    def __init__(self, path: str, ranks_path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pretokens = regex.compile(public_tokenizers.PATTERN)
        self.engine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})
        self.whole = frozenset(self._prove(ranks))
        self.known: dict[str, int] = {}
        self.many = Known()

    def _prove(self, ranks: dict[bytes, int]):
        """Vocabulary strings that are one pre-token and come out as one token."""
        for piece in ranks:
            try:
                text = piece.decode()
            except UnicodeDecodeError:
                continue
            if self.pretokens.fullmatch(text) and self.engine.encode_ordinary(text) == [ranks[piece]]:
                yield text

    def _count(self, piece: str) -> int:
        whole, total = self.whole, 0
        for pre in self.pretokens.findall(piece):
            total += 1 if pre in whole else len(self.engine.encode_ordinary(pre))
        return total

    def count(self, text: str) -> int:
        if SEPARATORS.search(text) or any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        pieces = PIECE.findall(text)
        counts = list(map(known.get, pieces))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    p = pieces[i]
                    if p not in known:
                        known[p] = self._count(p)
                    counts[i] = known[p]
        return sum(counts)

    def _learn_many(self, pieces: list[str]) -> tuple[np.ndarray, bytes]:
        found = [self._count(p[1:] if p.startswith("\x00") else " " + p) for p in pieces]
        return np.array(found, np.int64), b""

    def count_all(self, texts: pa.Array) -> list[int]:
        """``count`` of an array of texts, with each distinct piece of a slice looked up once; null counts as empty.

        Pieces are cut before every space.
        """
        texts = texts.fill_null("")
        apart = pc.or_(pc.match_substring_regex(texts, APART), pc.match_substring_regex(texts, UNEVEN))
        out = [0] * len(texts)
        for i in pc.indices_nonzero(apart).to_pylist():
            out[i] = self.count(texts[i].as_py())
        rest = pc.invert(apart)
        where = pc.indices_nonzero(rest).to_numpy()
        for at, part in slices(texts.filter(rest)):
            # A mark before the first piece tells it from the pieces that follow a space.
            marked = pc.binary_join_element_wise(pa.scalar("\x00"), part, pa.scalar(""))
            pieces, codes, edges = distinct(pc.split_pattern(marked, " "))
            place = self.many.look_up(pieces, self._learn_many)[codes]
            totals = np.concatenate([[0], np.cumsum(self.many.sizes[place])])[edges]
            for k, n in enumerate(np.diff(totals).tolist()):
                out[where[at + k]] = n
        return out


_made: dict[tuple, object] = {}


def word_tokens(path: str) -> WordTokens:
    """One instance per Python worker, so that later tasks reuse what it knows."""
    if ("words", path) not in _made:
        _made["words", path] = WordTokens(path)
    return _made["words", path]


def token_counter(path: str, ranks_path: str) -> TokenCounter:
    if ("count", path) not in _made:
        _made["count", path] = TokenCounter(path, ranks_path)
    return _made["count", path]
