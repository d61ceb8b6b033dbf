"""Table-level cleaning, profiling and key-assignment jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions import dates, numbers, text
from dayloom.operators.features import md5_bucket
from dayloom.operators.sequence import number_rows

# --- text ------------------------------------------------------------------------


def apply_steps(column: Column, steps: Sequence[tuple]) -> Column:
    """Apply named steps in turn: ``[("trim",), ("pad_start", 8, "0")]``."""
    for name, *arguments in steps:
        column = text.STEPS[name](column, *arguments)
    return column


def standardise_text(df: DataFrame, rules: Mapping[str, tuple[str, Sequence[tuple]]]) -> DataFrame:
    """Add one cleaned column per rule: output name -> (column, steps)."""
    return df.withColumns({out: apply_steps(F.col(c), steps) for out, (c, steps) in rules.items()})


def variant_counts(df: DataFrame, clean: str, raw: str) -> DataFrame:
    """How often each raw spelling of a cleaned value occurs, one row per spelling.

    Long form on purpose: a popular value with many spellings stays many rows
    instead of one growing set.
    """
    return df.groupBy(clean, raw).agg(F.count(F.lit(1)).alias("n"))


def profile_text(df: DataFrame, column: str, group: Sequence[str] = (), part: str = " ") -> DataFrame:
    """Per group: rows, nulls, lengths, letters-only and sorted texts, occurrences and places of ``part``."""
    value = F.col(column)
    length = text.size(value)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(value.isNull()).alias("n_null"),
        F.count_if(text.is_alpha(value)).alias("n_alpha"),
        F.count_if(text.is_sorted(value)).alias("n_sorted"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.sum(length.cast("bigint")).alias("sum_length"),
        F.sum(text.occurrences(value, part).cast("bigint")).alias("occurrences"),
        F.max(text.index_of(value, part)).alias("max_first_index"),
        F.sum(text.nth_position(value, part, 1, 2).cast("bigint")).alias("sum_second_position"),
        F.sum(text.nth_position(value, part, -1, 1).cast("bigint")).alias("sum_last_position"),
        F.sum(text.byte_position(value, part).cast("bigint")).alias("sum_byte_position"),
    )


# --- numbers ----------------------------------------------------------------------


def clean_numbers(
    df: DataFrame,
    parse: Mapping[str, tuple[str, str]] | None = None,
    measures: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """Parse text numbers and derive measures.

    ``parse``: output -> (column, kind), kind ``real``, ``int``, ``long``, ``hex``, ``hex_long`` or a picture
    with an implied point (``9V99``); a boolean ``<output>_rejected`` marks text that is
    no such number. ``measures``: output -> (name, column[, column]).
    """
    parsers = {"real": numbers.real, "int": numbers.whole, "long": numbers.whole_long, "hex": numbers.from_hex,
               "hex_long": numbers.from_hex_long}
    out = df
    for name, (column, kind) in (parse or {}).items():
        source = F.col(column)
        value = parsers[kind](source) if kind in parsers else numbers.implied_decimal(source, kind)
        out = out.withColumns({name: value, f"{name}_rejected": numbers.rejected(source, value)})
    derived = {}
    for name, (measure, *inputs) in (measures or {}).items():
        table = numbers.MEASURES if len(inputs) == 1 else numbers.PAIR_MEASURES
        derived[name] = table[measure](*[F.col(i) for i in inputs])
    return out.withColumns(derived) if derived else out


# --- dates ------------------------------------------------------------------------


def standardise_dates(df: DataFrame, column: str, patterns: Sequence[str], output: str = "parsed",
                      canonical: str = dates.MARK_PATTERN) -> DataFrame:
    """Add the parsed timestamp, its canonical text and a flag.

    ``<output>_valid`` holds where the text reads back unchanged under one of the
    patterns; parsing is strict, so a day 45 is rejected and does not roll over.
    """
    value = F.col(column)
    parsed = dates.parse_first(value, list(patterns))
    valid = F.lit(False)
    for p in patterns:
        valid = valid | dates.fits_pattern(value, p)
    return df.withColumns({
        output: parsed,
        f"{output}_text": F.date_format(parsed, canonical),
        f"{output}_valid": valid,
    })


def reject_counts(df: DataFrame, flag: str, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(flag)).alias("n_rejected")
    )


def date_measures(df: DataFrame, a: str, b: str, week_rule: str = "us") -> DataFrame:
    """Calendar fields of ``a``, comparisons and distances to ``b``, month edges and shifts."""
    x, y = F.col(a), F.col(b)
    parts = {
        f"{a}_{p.lower()}": dates.calendar_part(x, p, week_rule)
        for p in ("YEAR", "MONTH", "HOUR", "MINUTE", "SECOND", "DAY_OF_WEEK", "DAY_OF_MONTH", "DAY_OF_YEAR",
                  "WEEK_OF_MONTH", "DAY_OF_WEEK_IN_MONTH", "WEEK_OF_YEAR", "TIMEZONE")
    }
    distances = {f"diff_{u.lower()}" if u != "MM" else "diff_month": dates.span(x, y, u)
                 for u in ("yyyy", "MM", "dd", "HH", "mm", "ss", "SSS")}
    return df.withColumns({
        **parts,
        **distances,
        "complete_months": dates.complete_span(x, y, "MM"),
        "complete_years": dates.complete_span(x, y, "yyyy"),
        "compared": dates.compare(x, y),
        "compared_month": dates.compare(x, y, "yyyy-MM"),
        "month_first": dates.month_start(x),
        "month_last": dates.month_end(x),
        "plus_month": dates.shift(x, 1, "MM"),
        "plus_days": dates.shift(x, 10, "dd"),
        "in_february": dates.set_part(x, 2, "MM"),
    })


# --- keys, nulls, made-up columns ---------------------------------------------------


def assign_sequence(df: DataFrame, name: str, order: Sequence[str], start: int = 1, step: int = 1,
                    output: str = "sequence", unique_order: bool = False) -> DataFrame:
    """Number the rows of each name from ``start`` by ``step`` in the given order."""
    return number_rows(df, output, [F.col(c) for c in order], [name], start, step, unique_order)


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and share of nulls, from a single pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    long = counts.unpivot("_n", df.columns, "column_name", "n_null")
    share = F.coalesce(F.try_divide(F.col("n_null").cast("double"), F.col("_n")), F.lit(0.0))
    return long.select("column_name", F.col("_n").alias("n_rows"), "n_null", share.alias("null_share"))


FIRST_NAMES = "Ada Alan Barbara Blaise Donald Edsger Emmy Grace Hedy Ken Leslie Niklaus Radia Tony".split()
LAST_NAMES = "Archer Baker Carter Dyer Fisher Gardner Hunter Mason Miller Porter Sawyer Turner Weaver".split()
STREETS = "Acacia Birch Cedar Elm Juniper Larch Maple Oak Pine Rowan Spruce Willow".split()
CITIES = "Ashford Brookside Clearwater Dunmore Eastvale Fairhaven Glenwood Highfield".split()
STATES = {"AZ": "Arizona", "CO": "Colorado", "IA": "Iowa", "ME": "Maine", "OH": "Ohio", "UT": "Utah"}
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def pick(words: Sequence[str], key: Sequence[str], seed: int) -> Column:
    """A word chosen by the row's key: uniform, and the same on every run."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), md5_bucket(key, len(words), seed) + 1)


def pick_int(low: int, high: int, key: Sequence[str], seed: int) -> Column:
    return md5_bucket(key, high - low + 1, seed) + F.lit(low)


def pick_real(limit: float, key: Sequence[str], seed: int) -> Column:
    """A number from 0 up to (not including) the limit."""
    return md5_bucket(key, 2**31 - 1, seed) / F.lit(float(2**31 - 1)) * F.lit(float(limit))


def pick_text(length: int, key: Sequence[str], seed: int) -> Column:
    letters = [F.substring(F.lit(ALPHANUMERIC), pick_int(1, len(ALPHANUMERIC), key, seed + i), F.lit(1))
               for i in range(length)]
    return F.concat(*letters)


def synth_columns(df: DataFrame, key: Sequence[str], seed: int = 0, first_day: str = "2000-01-01",
                  days: int = 3650) -> DataFrame:
    """Add made-up people and places that depend only on the row's key and the seed."""
    states = list(STATES)
    return df.withColumns({
        "first_name": pick(FIRST_NAMES, key, seed + 1),
        "last_name": pick(LAST_NAMES, key, seed + 2),
        "street": F.concat_ws(" ", pick_int(1, 999, key, seed + 3).cast("string"), pick(STREETS, key, seed + 4),
                              F.lit("Street")),
        "city": pick(CITIES, key, seed + 5),
        "state_id": pick(states, key, seed + 6),
        "state": pick([STATES[s] for s in states], key, seed + 6),
        "amount": pick_int(0, 10_000, key, seed + 7),
        "ratio": pick_real(1.0, key, seed + 9),
        "code": pick_text(8, key, seed + 100),
        "day": F.date_add(F.lit(first_day).cast("date"), pick_int(0, days - 1, key, seed + 8)),
    })


def synth_table(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` made-up rows."""
    return synth_columns(spark.range(n), ["id"], seed)
