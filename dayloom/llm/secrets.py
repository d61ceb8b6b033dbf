"""Secrets in text: plain forms, and weak parts that count only when they complete each other.

All of it is column expressions, joins and aggregates. The places of a pattern's matches come
from cutting the text at the pattern: the lengths of what lies between and of the matches
themselves add up to positions in code points, by running sums over arrays, in n log n steps for n matches.

Base spans stand on their own. The method links parts of one credential: access identifiers
(user or key names), secrets (values too weak to report by themselves, base assignments and base
hex values that are not part of an identifier or endpoint) and endpoints
(addresses with a host). The lines around an identifier or endpoint, up to ``reach`` characters on
either side, are its scope. Overlapping scopes of a text merge into one, so each part lies in
at most one merged scope; an interval join of parts with merged scopes, on shared blocks of
positions, finds them. Weak parts are reported only if their scope holds both a secret and an
identifier or an endpoint; what the base reports is not added again.

Nulls and empty texts have no spans. Rows are told apart by a number given when the parts
are stored, so repeated doc_ids and rows stay separate. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
# Parts that say little alone. Values run to their end; possessive repetitions keep the search linear in the text.
IDENTIFIER = ("\\b(?i:user(?:_?name)?|login|client_?id|account_?id|access_?key(?:_?id)?)[\"']?\\x20*+[:=]\\x20*+[\"']?"
              "[A-Za-z0-9._@-]{3,}+")
SECRET = ("\\b(?i:pass|pwd|pin|key|client_?secret|secret_?key|private_?key|auth|credential)[\"']?\\x20*+[:=]\\x20*+"
          "[\"']?[A-Za-z0-9+/_.=!@#$%^&*-]{4,}+")
SHORT_ASSIGN_MAX = 12
ENDPOINT = ("\\b(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]{3,}+(?::[0-9]{1,5})?"
            "|(?i:host|server|endpoint|database_?url)[\"']?\\x20*+[:=]\\x20*+[\"']?[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)*+"
            "(?::[0-9]{1,5})?)")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:bigint>>"
BLOCK = 1024


def _running_sums(numbers: Column) -> Column:
    """Sums up to each entry of an array: entries 1, 2, 4, ... places before are added, so n entries take n log n steps."""
    shifts = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(numbers))

    def add(sums: Column, shift: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.when(i >= shift, F.get(sums, i - shift)).otherwise(F.lit(0)))

    return F.aggregate(shifts, numbers, add)


def _positions(df: DataFrame, name: str, pattern: str, kind: str, group: str | None = None,
               needs: Column | None = None) -> DataFrame:
    """Add column ``name``: the matches of ``pattern`` in text as an array of spans.

    End of match i: lengths of the gaps and matches up to i. ``needs`` is a cheap condition without
    which a text cannot have a match.
    """
    hits, steps, ends = f"{name}_m", f"{name}_g", f"{name}_e"

    def lengths(strings: Column) -> Column:
        return F.transform(strings, lambda m: F.length(m).cast("bigint"))

    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn(hits, lengths(
        found if needs is None else F.when(needs, found).otherwise(F.array().cast("array<string>"))))
    some = F.size(hits) > 0
    gaps = F.slice(lengths(F.split("text", pattern, -1)), F.lit(1), F.size(hits))
    df = df.withColumn(steps, F.when(some, F.zip_with(gaps, hits, lambda g, m: g + m)))
    df = df.withColumn(ends, F.when(some, _running_sums(F.col(steps))))
    values = lengths(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))) if group else F.col(hits)
    sized = F.zip_with(hits, values, lambda m, v: F.struct(m.alias("length"), v.alias("value")))
    spans = F.zip_with(ends, sized, lambda e, m: F.struct(
        F.lit(kind).alias("kind"), (e - m["length"]).alias("start"), e.alias("end"), m["value"].alias("value")))
    return df.withColumn(name, F.when(some, spans).otherwise(F.array()).cast(SPAN)).drop(hits, steps, ends)


def parts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans and weak spans of the text."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sign = F.contains(F.col("text"), F.lit(":")) | F.contains(F.col("text"), F.lit("="))
    df = _positions(df, "assign", ASSIGN, "assign", "value", sign)
    df = _positions(df, "access", ACCESS, "access", needs=F.contains(F.col("text"), F.lit("AKIA")))
    df = _positions(df, "hex", HEX, "hex")
    for name, pattern in (("identifier", IDENTIFIER), ("secret", SECRET), ("endpoint", ENDPOINT)):
        df = _positions(df, name, pattern, name, needs=sign)
    strong = F.filter("assign", lambda s: s["value"] >= SHORT_ASSIGN_MAX)
    # An assignment whose value is too short for the base is a weak secret.
    short = F.transform(F.filter("assign", lambda s: s["value"] < SHORT_ASSIGN_MAX), lambda s: F.struct(
        F.lit("secret").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return df.select("doc_id", F.concat(strong, "access", "hex").alias("base"),
                     F.concat(short.cast(SPAN), "identifier", "secret", "endpoint").alias("weak"))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _sorted(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("s"), _order(s["kind"]).alias("o"), s["end"].alias("e"),
                                                  s["kind"].alias("k")))
    return F.array_sort(keyed)


def _text(sorted_spans: Column) -> Column:
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")


def linked(stored: DataFrame, reach: int = 200) -> DataFrame:
    """Weak parts that complete each other: row_ and the spans to add to the row.

    ``stored`` holds row_, base and weak. Only rows with a weak part take part.
    """
    some = stored.filter(F.size("weak") > 0)
    single = some.select("row_", F.explode(F.concat("weak", "base")).alias("p"))
    single = single.select("row_", "p.kind", "p.start", "p.end")
    anchors = single.filter(F.col("kind").isin("identifier", "endpoint", "access")).select(
        "row_", F.greatest(F.col("start") - reach, F.lit(0)).alias("low"), (F.col("end") + reach).alias("high"))
    # Islands: a scope opens where none before it reaches.
    ordered = Window.partitionBy("row_").orderBy("low", "high")
    before = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = anchors.withColumn("opens", F.when(before >= F.col("low"), 0).otherwise(1))
    scopes = opened.withColumn("scope", F.sum("opens").over(ordered)).groupBy("row_", "scope").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    # Interval join: a scope stands in every block of positions it covers, a part in the block of its start.
    block = F.lit(BLOCK)
    covered = scopes.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))
    # A hex value within an identifier or endpoint is no secret beside it.
    earlier = Window.partitionBy("row_").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.max(F.when(F.col("kind").isin("identifier", "endpoint"), F.col("end"))).over(earlier)
    own = single.withColumn("around", around).filter((F.col("kind") != "hex") | F.col("around").isNull() | (
        F.col("around") < F.col("end"))).drop("around")
    placed = own.withColumn("block", F.floor(F.col("start") / block))
    inside = placed.join(covered, ["row_", "block"]).filter("start >= low and start <= high")
    scope = Window.partitionBy("row_", "scope")
    has_secret = F.max(F.col("kind").isin("secret", "assign", "hex").cast("int")).over(scope) == 1
    complete = inside.withColumn("whole", has_secret).filter("whole and kind not in ('access', 'assign', 'hex')")
    return complete.groupBy("row_").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))


def digest(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Per row: doc_id, base counts by kind, hash of the base spans, all spans as text, number added."""
    scratch = Scratch(docs.sparkSession, "secrets")
    stored = scratch.store(parts(docs).withColumn("row_", F.monotonically_increasing_id()), "parts")
    more = linked(stored, reach)
    joined = stored.join(more, "row_", "left")
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    every = F.concat(plain, F.coalesce(F.col("added").cast(kind), F.array().cast(kind)))

    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")

    return joined.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_text(_sorted(plain)), 256).alias("base_sha256"), _text(_sorted(every)).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("bigint").alias("n_added"))
