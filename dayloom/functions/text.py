"""Text clean-up steps and text measures as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything up to and including the space character counts as blank.
BLANKS = "".join(chr(code) for code in range(0x21))

# Plain spelling of the letters U+00C0 .. U+00FF, in code-point order.
PLAIN_SPELLING = {
    "À": "A", "Á": "A", "Â": "A", "Ã": "A", "Ä": "A", "Å": "A", "Æ": "AE", "Ç": "C",
    "È": "E", "É": "E", "Ê": "E", "Ë": "E", "Ì": "I", "Í": "I", "Î": "I", "Ï": "I",
    "Ð": "D", "Ñ": "N", "Ò": "O", "Ó": "O", "Ô": "O", "Õ": "O", "Ö": "O", "×": "*",
    "Ø": "0", "Ù": "U", "Ú": "U", "Û": "U", "Ü": "U", "Ý": "Y", "Þ": "_", "ß": "B",
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "æ": "ae", "ç": "c",
    "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ð": "d", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "÷": "/",
    "ø": "0", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "þ": "_", "ÿ": "y",
}
ACCENTED = "".join(PLAIN_SPELLING)
UNACCENTED = list(PLAIN_SPELLING.values())

# The five characters with a named XML entity.
XML_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&apos;", '"': "&quot;"}


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# --- clean-up steps -----------------------------------------------------------

def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def trim_start_set(text: Column, chars: str | None = None) -> Column:
    """Strip leading characters of a set; an empty text gives null."""
    return F.ltrim(_filled(text), F.lit(chars or BLANKS))


def trim_end_set(text: Column, chars: str | None = None) -> Column:
    return F.rtrim(_filled(text), F.lit(chars or BLANKS))


def trim_char(text: Column, char: str, align: int = 0) -> Column:
    """Strip one padding character: left (align > 0), right (< 0) or both (0)."""
    cut = F.ltrim if align > 0 else F.rtrim if align < 0 else F.btrim
    return cut(text, F.lit(char))


def pad_start(text: Column, width: int, fill: str | None = None) -> Column:
    """Pad on the left; never truncates, and gives null for an empty text or width < 1."""
    return _pad(text, width, F.lpad(text, max(width, 0), fill or " "))


def pad_end(text: Column, width: int, fill: str | None = None) -> Column:
    return _pad(text, width, F.rpad(text, max(width, 0), fill or " "))


def _pad(text: Column, width: int, padded: Column) -> Column:
    if width < 1:
        return F.lit(None).cast("string")
    return F.when(F.length(text) >= width, text).when(text != "", padded)


def left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def right(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def piece(text: Column, start: int, length: int | None = None) -> Column:
    """Substring; start 0 reads as 1, a negative start counts from the end."""
    size = F.length(text)
    if start > 0:
        first = F.lit(start)
    elif start < 0:
        first = F.greatest(size + (start + 1), F.lit(1))
    else:
        first = F.lit(1)
    count = size if length is None else F.lit(max(length, 0))
    return F.when(F.lit(start) > size, F.when(text != "", F.lit(""))).otherwise(
        F.substring(_filled(text), first, count)
    )


def change(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def quote(text: Column, mark: str = '"') -> Column:
    return F.concat(F.lit(mark), text, F.lit(mark))


def xml_escape(text: Column) -> Column:
    """Escape the XML specials; a CDATA section passes unchanged."""
    escaped = text
    for char, entity in XML_ENTITIES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    is_cdata = text.startswith("<![CDATA[") & text.endswith("]]>")
    return F.when(is_cdata, text).otherwise(escaped)


def escape_chars(text: Column, escape: str) -> Column:
    """Put the escape before every character that is no letter, digit, underscore or white space."""
    return F.regexp_replace(
        text,
        r"([^\p{javaLetterOrDigit}_\p{javaWhitespace}])",
        escape.replace("\\", r"\\").replace("$", r"\$") + "$1",
    )


def remove_accents(text: Column) -> Column:
    """Spell the letters U+00C0 .. U+00FF plainly; others stay (ASCII texts are not walked)."""
    single = [(a, b) for a, b in zip(ACCENTED, UNACCENTED) if len(b) == 1]
    plain = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
    for a, b in zip(ACCENTED, UNACCENTED):
        if len(b) > 1:
            plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(plain)


def join_parts(separator: str, *parts: Column) -> Column:
    """Join with a separator; a missing part is written as ``null``."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def number_text(number: Column) -> Column:
    """A number without exponent where its size is between 1e-16 and 1e16."""
    plain = F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    shortest = number.cast("string")
    size = F.abs(number)
    return F.when(shortest.contains("E") & (size < 1e16) & (size > 1e-16), plain).otherwise(shortest)


# Step names a cleaning rule may use.
STEPS = {
    "upcase": F.upper,
    "downcase": F.lower,
    "trim": trim,
    "trim_start": trim_start,
    "trim_end": trim_end,
    "trim_start_set": trim_start_set,
    "trim_end_set": trim_end_set,
    "trim_char": trim_char,
    "pad_start": pad_start,
    "pad_end": pad_end,
    "left": left,
    "right": right,
    "piece": piece,
    "change": change,
    "quote": quote,
    "repeat": lambda text, n: F.repeat(text, n),
    "xml_escape": xml_escape,
    "escape_chars": escape_chars,
    "remove_accents": remove_accents,
}


# --- measures -----------------------------------------------------------------

def is_alpha(text: Column) -> Column:
    """Only letters (true for an empty text, false for null)."""
    return F.coalesce(text.rlike(r"\A\p{L}*\z"), F.lit(False))


def is_sorted(text: Column) -> Column:
    """Characters in non-decreasing order (false for null).

    Most texts already break the order within their first characters; only the
    others are split and sorted as a whole.
    """

    def in_order(part: Column) -> Column:
        chars = F.split(part, "")
        return F.sort_array(chars) == chars

    return F.when(text.isNull() | ~in_order(F.substring(text, 1, 32)), False).otherwise(in_order(text))


def size(text: Column) -> Column:
    """Length, -1 for null."""
    return F.coalesce(F.length(text), F.lit(-1))


def index_of(text: Column, part: str) -> Column:
    """0-based position of the first occurrence, -1 if absent or null."""
    return F.coalesce(F.instr(text, part) - 1, F.lit(-1))


def occurrences(text: Column, part: str) -> Column:
    """Number of (overlapping) occurrences, 0 for null."""
    if not part:
        raise ValueError("cannot count an empty text")
    if _overlaps_itself(part):
        count = F.regexp_count(text, F.lit(f"(?={re.escape(part)})"))
    else:
        rest = F.length(F.replace(text, F.lit(part), F.lit("")))
        count = ((F.length(text) - rest) / len(part)).cast("int")
    return F.coalesce(count, F.lit(0))


def _overlaps_itself(part: str) -> bool:
    return any(part.startswith(part[i:]) for i in range(1, len(part)))


def nth_position(text: Column, part: str, start: int = 1, occurrence: int = 1) -> Column:
    """Position of the n-th occurrence, 0 if there is none.

    Counted from ``start``; a negative start searches backwards from that place
    and counts from the beginning. Null for texts of fewer than two characters.
    """
    if occurrence < 1:
        raise ValueError("occurrence must be positive")
    searchable = F.when(F.length(text) > 1, text)
    if start < 0:
        head = searchable
        if start < -1:
            last = F.greatest(F.length(searchable) + (start + 1), F.lit(0))
            head = F.substring(searchable, F.lit(1), last)
        if not _overlaps_itself(part):
            rest = F.substring_index(head, part, -occurrence)
            at = F.length(head) - F.length(rest) - len(part) + 1
            return F.when(rest == head, F.lit(0)).when(head.isNotNull(), at)
        # Search the reversed head forwards: its first hit is the head's last one.
        # Backward hits may not overlap, so each search resumes after the last.
        found = _walk(F.reverse(head), part[::-1], occurrence, step=len(part))
        return F.when(found > 0, F.length(head) - found - len(part) + 2).when(found == 0, 0)
    tail = searchable if start <= 1 else F.substring(searchable, F.lit(start), F.length(searchable))
    return _walk(tail, part, occurrence, step=1)


def _walk(text: Column, part: str, occurrence: int, step: int) -> Column:
    found = F.locate(part, text, 1)
    for _ in range(occurrence - 1):
        found = F.when(found > 0, F.call_function("locate", F.lit(part), text, found + step)).otherwise(found)
    return found


def byte_position(text: Column, part: str, occurrence: int = 1) -> Column:
    """As ``nth_position``, counted in UTF-8 bytes."""
    at = nth_position(text, part, 1, occurrence)
    before = F.octet_length(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))))
    return F.when(at > 0, before + 1).otherwise(at)
