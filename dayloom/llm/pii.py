"""Personal data, plain and disguised, at source positions.

Base identifiers are matched in the text as it stands; where a phone and a card stand side by side and their joint match
fails, each is found by its usual spelling. For disguised ones a transducer
rewrites look-alike letters, invisible characters, spelled digits and at/dot disguises,
keeping for each rewritten piece the source span it came from; the same matchers run on the
rewritten text, and what they find is mapped back to source characters.

Nulls and empty texts have no spans. Rows are independent: repeated rows give repeated
results, other columns pass through, and texts of any length are scanned whole in time
linear in their length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import map_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# A match of a number always starts where its digits start, so the look-behind changes no match.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# A phone and a card as they are usually written, for where a longer match fails.
WRITTEN_PHONE = re.compile(
    r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
WRITTEN_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{14,19})(?![0-9])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# Cyrillic and Greek letters that look like a Latin letter.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s",
    "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "·": ".", "‐": "-", "‑": "-",
    "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff"
ODD = re.compile("[\u00ad\u00b2\u00b3\u00b7\u00b9\u0370-\u03ff\u0400-\u052f\u2000-\u206f\u2070-\u209f\u2212\u2460-\u249b"
                 "\u3002\ufe52\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
_WORDS = "|".join(DIGIT_WORDS)
_WORD_RUN = rf"(?<![A-Za-z0-9])(?:plus[\s-]+)?(?:{_WORDS})(?:[\s-]+(?:{_WORDS}|[0-9]))+(?![A-Za-z0-9])"
# One spelled digit alone counts beside a spelled dot.
_LONE_WORD = rf"(?<![A-Za-z0-9])(?:{_WORDS})(?=\s+(?:dot|point)\s)|(?:(?<=\bdot\s)|(?<=\bpoint\s))(?:{_WORDS})(?![A-Za-z0-9])"
# White space is matched from its start only, which keeps the search linear.
_AT = r"(?<!\s)\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*"
_DOT = r"(?<!\s)\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*"
_PLAIN_AT = rf"(?<!\s)\s+at\s+(?=[a-z0-9-]+(?:\s+dot\s+|{_DOT})[a-z0-9])"
_PLAIN_DOT = r"(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9])"
_DIGIT_DOT = rf"(?<=[a-z0-9])\s+(?:dot|point)\s+(?=(?:{_WORDS}|[0-9]))"
REWRITE = re.compile(
    rf"(?P<run>{_WORD_RUN}|{_LONE_WORD})|(?P<at>{_AT}|{_PLAIN_AT})|(?P<dot>{_DOT}|{_DIGIT_DOT}|{_PLAIN_DOT})", re.IGNORECASE)
_RUN_WORD = re.compile(rf"plus|{_WORDS}|[0-9]", re.IGNORECASE)
# The gate before REWRITE: each of its alternatives needs one of these, "dot" or "point".
BRACKETED = re.compile(r"[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]", re.IGNORECASE)
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORDS})[\s-]++(?:{_WORDS}|[0-9])", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Base identifiers, leftmost and without overlap for each kind, ordered by start and kind."""
    found: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                last = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Rewritten:
    """A rewritten text and, for each of its pieces, where it came from."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at: list[int] = []
        self.source: list[tuple[int, int, bool]] = []
        self.size = 0

    def add(self, text: str, start: int, end: int, kept: bool) -> None:
        """``kept`` pieces stand for the source span character by character, others as a whole."""
        if text:
            self.parts.append(text)
            self.at.append(self.size)
            self.source.append((start, end, kept))
            self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the rewritten text, and whether it holds a rewritten piece."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first, last = self.source[i], self.source[j]
        low = first[0] + (start - self.at[i]) if first[2] else first[0]
        high = last[0] + (end - self.at[j]) if last[2] else last[1]
        return low, high, any(not self.source[k][2] for k in range(i, j + 1))


def _characters(text: str) -> Rewritten:
    """Look-alikes to ASCII, invisible characters dropped."""
    out, at = Rewritten(), 0
    gap = False
    for m in ODD.finditer(text):
        c = m.group()
        if c in INVISIBLE:
            new = ""
        else:
            new = LOOK_ALIKES.get(c) or unicodedata.normalize("NFKC", c)
            if len(new) != 1 or not new.isascii():
                continue
        out.add(text[at:m.start()], at, m.start(), True)
        out.add(new, m.start(), m.end(), False)
        gap = gap or not new
        at = m.end()
    out.add(text[at:], at, len(text), True)
    out.joined = gap
    return out


def _phrases(text: str) -> Rewritten:
    """Spelled digits to digits, at/dot disguises to their signs."""
    out, at = Rewritten(), 0
    for m in REWRITE.finditer(text):
        out.add(text[at:m.start()], at, m.start(), True)
        if m.lastgroup == "run":
            for w in _RUN_WORD.finditer(m.group()):
                word = w.group().lower()
                new = "+" if word == "plus" else DIGIT_WORDS.get(word, word)
                out.add(new, m.start() + w.start(), m.start() + w.end(), False)
        else:
            out.add("@" if m.lastgroup == "at" else ".", m.start(), m.end(), False)
        at = m.end()
    out.add(text[at:], at, len(text), True)
    return out


def run_together_spans(text: str, plain: list[Span]) -> list[Span]:
    """Phones and cards in matches that fail as a whole because two identifiers stand side by side."""
    found = []
    for kind, whole, inner, low, high in (("phone", PHONE, WRITTEN_PHONE, 10, 15), ("card", CARD, WRITTEN_CARD, 14, 19)):
        known = {(s, e) for k, s, e in plain if k == kind}
        for m in whole.finditer(text):
            if m.end() - m.start() < low or m.span() in known:
                continue
            for part in inner.finditer(text, m.start(), m.end()):
                digits = NOT_DIGIT.sub("", part.group())
                if low <= len(digits) <= high and (kind == "phone" or _luhn(digits)):
                    found.append((kind, *part.span()))
    return found


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """What the method finds beyond the base spans."""
    together = run_together_spans(text, plain) if DIGIT.search(text) else []
    return together + disguised_spans(text, [*plain, *together])


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that appear only after rewriting, at source positions; none lies within a base span of its kind."""
    odd = not text.isascii() and ODD.search(text) is not None
    low = text.lower()
    if not (odd or "dot" in low or "point" in low or BRACKETED.search(text) or SPELLED.search(text)):
        return []
    first = _characters(text) if odd else None
    inner = first.text() if first else text
    second = _phrases(inner)
    final = second.text()
    if not first and len(second.parts) < 2:
        return []
    found = []
    for kind, start, end in plain_spans(final):
        a, b, changed = second.back(start, end)
        if first:
            before = (a, b)
            a, b, more = first.back(*before)
            # A dropped character leaves no piece of its own; the span is longer than its text then.
            changed = changed or more or b - a != before[1] - before[0]
        if changed and not any(k == kind and s <= a and b <= e for k, s, e in plain):
            found.append((kind, a, b))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_spans(df: DataFrame) -> DataFrame:
    """Columns of ``df`` but text, plus base and all spans as arrays of (kind, start, end)."""
    names = {"text", "base_spans", "all_spans"}
    kept = [(n, k) for n, k in df.dtypes if n not in names]
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def start():
        def work(c):
            base, every = [], []
            for text in c["text"]:
                plain = plain_spans(text or "")
                added = added_spans(text, plain) if text else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in plain])
                every.append([{"kind": k, "start": s, "end": e} for k, s, e in in_order(plain + added)])
            return {n: c[n] for n, _ in kept} | {"base_spans": base, "all_spans": every}
        return work

    ddl = ", ".join([*(f"`{n}` {k}" for n, k in kept), f"base_spans {span}", f"all_spans {span}"])
    return map_columns(df.select(*[F.col(f"`{n}`") for n, _ in kept], "text"), start, ddl)


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts by kind, hash of the base spans, all spans as text, number added."""
    def start():
        def work(c):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for text in c["text"]:
                plain = plain_spans(text or "")
                added = added_spans(text, plain) if text else []
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in plain))
                out["base_sha256"].append(hashlib.sha256(joined(plain).encode()).hexdigest())
                out["spans"].append(joined(in_order(plain + added)))
                out["n_added"].append(len(added))
            return out | {"doc_id": c["doc_id"]}
        return work

    ddl = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
           "spans string, n_added bigint")
    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), start, ddl)


def masked(text: str) -> str:
    """The text with every identifier replaced by its kind in angle brackets; overlapping ones count as one."""
    plain = plain_spans(text)
    spans = in_order(plain + added_spans(text, plain))
    if not spans:
        return text
    out, at = [], 0
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"<{kind}>"]
        at = end
        i += 1
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers masked in text and n_chars, where there is one, brought up to date."""
    def start():
        def work(c):
            texts = [masked(t) if t else t for t in c["text"]]
            if "n_chars" in c:
                c["n_chars"] = [n if new == old else len(new) for n, new, old in zip(c["n_chars"], texts, c["text"])]
            return c | {"text": texts}
        return work

    return map_columns(docs, start, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes))
