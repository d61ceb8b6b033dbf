"""Date parsing, formatting, features and calendar arithmetic.

Timestamps inside the package are ``TIMESTAMP_NTZ``: calendar days then do not
depend on the session's time zone. Pattern parsing and formatting do pass through
that zone, so run sessions in UTC (the package default) or another zone without
clock changes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

API_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DOCUMENT_PATTERN = "dd-MM-yyyy HH:mm:ss"
MARK_PATTERN = "yyyy-MM-dd HH:mm:ss"

# How the tokens of a database-style pattern read as Spark tokens.
# A day of month is written without a leading zero.
DATABASE_TOKENS = {
    "YYYY": "yyyy", "YYY": "yyy", "YY": "yy", "Y": "y", "RR": "yy",
    "MONTH": "MMMM", "MON": "MMM",
    "DDD": "D", "DD": "d", "DY": "E",
    "HH24": "HH", "HH12": "hh", "HH": "hh",
    "MI": "mm", "SS": "ss", "MS": "SSS",
    "AM": "a", "A.M.": "a", "PM": "a", "P.M.": "a",
}
_TOKEN = re.compile("|".join(re.escape(t) for t in sorted(DATABASE_TOKENS, key=len, reverse=True)))
EPOCH_MILLIS = "J"
DEFAULT_DATABASE_PATTERN = "MM/DD/YYYY HH24:MI:SS"


def epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def spark_pattern(database_pattern: str) -> str:
    """Rewrite a database-style pattern (``YYYY-MM-DD HH24:MI``) for Spark."""
    if re.search(r"W", database_pattern):
        raise ValueError("week tokens have no Spark pattern; from_week_text parses them")
    return _TOKEN.sub(lambda m: DATABASE_TOKENS[m.group()], database_pattern)


def parse_timestamp(text: Column, pattern: str) -> Column:
    """Strict parse; text that does not fit the pattern (or the calendar) gives null."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_date(text: Column, pattern: str) -> Column:
    return parse_timestamp(text, pattern).cast("date")


def parse_first(text: Column, patterns: list[str]) -> Column:
    """The parse under the first pattern that fits."""
    return F.coalesce(*[parse_timestamp(text, p) for p in patterns])


def fits_pattern(text: Column, pattern: str) -> Column:
    """Whether the text is a date and reads back exactly as it was written."""
    back = F.date_format(parse_timestamp(text, pattern), pattern)
    return F.coalesce(F.lower(back) == F.lower(text), F.lit(False))


def _csv_options(pattern: str, locale: str) -> dict[str, str]:
    # One-column CSV text is the date itself; the separator never occurs in it.
    return {"timestampFormat": pattern, "locale": locale, "timeZone": "UTC", "sep": "\u0001"}


def parse_localised(text: Column, pattern: str, locale: str) -> Column:
    """Parse with month and day names of a locale such as ``fr-FR``."""
    instant = F.from_csv(text, "v timestamp", _csv_options(pattern, locale))["v"]
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def format_localised(date: Column, pattern: str, locale: str) -> Column:
    instant = from_utc_clock(date.cast("timestamp_ntz"))
    return F.to_csv(F.struct(instant.alias("v")), _csv_options(pattern, locale))


def format_in_zone(clock: Column, pattern: str, zone: str) -> Column:
    """Text of a UTC clock as read in another zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), clock), pattern)


def parse_in_zone(text: Column, pattern: str, zone: str) -> Column:
    """UTC clock of a text written in another zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), parse_timestamp(text, pattern))


def format_offset(clock: Column, offset: str = "+00:00") -> Column:
    """Milliseconds and zone offset written out, for the clock of that offset."""
    return F.concat(F.date_format(clock, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(offset))


def shift_text(text: Column, pattern: str, amount: Column | int, unit: str) -> Column:
    """Shift a date that is kept as text."""
    return F.date_format(shift(parse_timestamp(text, pattern), amount, unit), pattern)


def format_document_date(date: Column) -> Column:
    return F.date_format(date, DOCUMENT_PATTERN)


def from_database_text(text: Column, pattern: str | None = None) -> Column:
    """Database-style text to timestamp; pattern ``J`` is epoch milliseconds."""
    filled = F.nullif(text, F.lit(""))
    if pattern == EPOCH_MILLIS:
        millis = filled.try_cast("bigint")
        return epoch() + F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))
    return parse_timestamp(filled, spark_pattern(pattern) if pattern else "MM/dd/yyyy HH:mm:ss.SSS")


def to_database_text(date: Column, pattern: str | None = None) -> Column:
    if pattern == EPOCH_MILLIS:
        return span(date, epoch(), "SSS").cast("string")
    pattern = pattern or DEFAULT_DATABASE_PATTERN
    parts = {"WW": "WEEK_OF_YEAR", "W": "WEEK_OF_MONTH"}
    pieces = [
        calendar_part(date, parts[p]).cast("string") if p in parts else F.date_format(date, spark_pattern(p))
        for p in re.split(r"(WW?)", pattern) if p
    ]
    return F.when(date.isNotNull(), F.concat(*pieces))


def from_utc_clock(clock: Column) -> Column:
    """A UTC wall-clock (NTZ) as an instant, whatever the session's time zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch(), clock))


def utc_day(instant: Column) -> Column:
    """The UTC calendar day of an instant, whatever the session's time zone."""
    days = F.floor(F.unix_micros(instant) / F.lit(86_400_000_000))
    return F.date_from_unix_date(days.cast("int"))


# --- numeric encodings of a day ---------------------------------------------

def month_scaled_day(date: Column) -> Column:
    """dayofmonth / 1.3 + 30 * month: a coarse position within the year."""
    return F.dayofmonth(date) / F.lit(1.3).cast("double") + F.month(date) * F.lit(30)


def ordinal_day(date: Column) -> Column:
    """dayofyear + 365 * year."""
    return F.dayofyear(date) + F.year(date) * F.lit(365)


# --- calendar arithmetic ------------------------------------------------------

def calendar_part(ts: Column, part: str, week_rule: str = "us") -> Column:
    """One calendar field. ``MONTH`` counts from 0, ``HOUR`` runs 0-11, Sunday is day 1.

    ``week_rule="us"``: weeks start on Sunday and week 1 holds the first day of the
    year (or month); ``"iso"``: ISO week of year.
    """
    weekday, day, year_day = F.dayofweek(ts), F.dayofmonth(ts), F.dayofyear(ts)
    if part == "WEEK_OF_YEAR":
        if week_rule == "iso":
            value = F.weekofyear(ts)
        else:
            next_new_year = F.make_date(F.year(ts) + 1, F.lit(1), F.lit(1))
            in_next_year = F.date_add(ts.cast("date"), F.lit(7) - weekday) >= next_new_year
            value = F.when(in_next_year, F.lit(1)).otherwise(_week_within(year_day, weekday))
    else:
        value = {
            "YEAR": lambda: F.year(ts),
            "MONTH": lambda: F.month(ts) - 1,
            "HOUR": lambda: F.hour(ts) % 12,
            "MINUTE": lambda: F.minute(ts),
            "SECOND": lambda: F.second(ts),
            "DAY_OF_WEEK": lambda: weekday,
            "DAY_OF_MONTH": lambda: day,
            "DAY_OF_YEAR": lambda: year_day,
            "WEEK_OF_MONTH": lambda: _week_within(day, weekday),
            "DAY_OF_WEEK_IN_MONTH": lambda: F.floor((day - 1) / 7) + 1,
            "TIMEZONE": lambda: F.when(ts.isNotNull(), F.lit(0)),
        }[part]()
    return F.coalesce(value.cast("int"), F.lit(0))


def _week_within(position: Column, weekday: Column) -> Column:
    # Sundays up to this day, plus one for the days before the first Sunday.
    first_weekday = F.pmod(weekday - position, F.lit(7)) + 1
    return F.floor((position + first_weekday - 2) / 7) + 1


def week_year(date: Column, week_rule: str = "us") -> Column:
    """The year that the week of a date belongs to; with the week's number and the weekday it names the date."""
    if week_rule == "iso":
        return F.extract(F.lit("YEAROFWEEK"), date).cast("int")
    return F.year(F.date_add(date.cast("date"), F.lit(7) - F.dayofweek(date)))


def from_week_of_year(year: Column, week: Column, weekday: Column | int = 1, week_rule: str = "us") -> Column:
    """The date of a weekday (Sunday is 1) in a week of a week year: the inverse of ``WEEK_OF_YEAR``.

    Days of week 1 may lie in the year before, and with the rule ``"iso"`` days of the last week in the next.
    A week that the year lacks, a weekday outside 1 to 7, a year outside 1 to 9998 and nulls give null.
    """
    day = weekday if isinstance(weekday, Column) else F.lit(weekday)
    place = day if week_rule == "us" else F.pmod(day + 5, F.lit(7)) + 1
    in_range = year.between(1, 9998) & week.between(1, 53) & day.between(1, 7)
    # The day of January that lies in week 1 under either rule.
    fixed = F.make_date(F.when(in_range, year), F.lit(1), F.lit(1 if week_rule == "us" else 4))
    offset = F.dayofweek(fixed) - 1 if week_rule == "us" else F.weekday(fixed)
    date = F.date_add(F.date_sub(fixed, offset), ((week - 1) * 7 + place - 1).cast("int"))
    return F.when(week_year(date, week_rule) == year, date)


def from_week_of_month(year: Column, month: Column, week: Column, weekday: Column | int) -> Column:
    """The date of a weekday (Sunday is 1) in a week of a month (1 to 12): the inverse of ``WEEK_OF_MONTH``.

    A weekday that this week of the month does not hold gives null, as do values out of range and nulls.
    """
    day = weekday if isinstance(weekday, Column) else F.lit(weekday)
    in_range = year.between(1, 9998) & month.between(1, 12) & week.between(1, 6) & day.between(1, 7)
    first = F.make_date(F.when(in_range, year), F.when(in_range, month), F.lit(1))
    date = F.date_add(F.date_sub(first, F.dayofweek(first) - 1), ((week - 1) * 7 + day - 1).cast("int"))
    return F.when(F.month(date) == month, date)


# What a token of a week pattern reads. D is the weekday, Sunday is 1.
WEEK_TOKENS = {"YYYY": r"[0-9]{4}", "MM": r"[0-9]{2}", "WW": r"[0-9]{1,2}", "W": r"[1-6]", "D": r"[1-7]"}


def from_week_text(text: Column, pattern: str, week_rule: str = "us") -> Column:
    """Parse a date written by week: ``YYYY`` with ``WW``, or ``YYYY``, ``MM`` and ``W``, each with or without ``D``.

    ``YYYY`` beside ``WW`` is the week year. Without ``D`` the date is the first day of the week, or of the part of it that lies in
    the month. Text that does not fit the pattern as a whole, or names a day that is not there, gives null.
    """
    tokens = re.findall(r"YYYY|MM|WW|W|D", pattern)
    known = set(tokens) - {"D"}
    if len(set(tokens)) < len(tokens) or known not in ({"YYYY", "WW"}, {"YYYY", "MM", "W"}):
        raise ValueError(f"no week pattern: {pattern}")
    pieces = re.split(r"(YYYY|MM|WW|W|D)", pattern)
    expression = "^" + "".join(f"({WEEK_TOKENS[p]})" if p in WEEK_TOKENS else re.escape(p) for p in pieces) + r"\z"

    def part(token: str) -> Column:
        return F.regexp_extract(text, expression, tokens.index(token) + 1).try_cast("int")

    day = part("D") if "D" in tokens else None
    if "WW" in tokens:
        first = 1 if week_rule == "us" else 2
        return from_week_of_year(part("YYYY"), part("WW"), F.lit(first) if day is None else day, week_rule)
    year, month, week = part("YYYY"), part("MM"), part("W")
    if day is None:
        opens = F.make_date(F.when(year.between(1, 9998), year), F.when(month.between(1, 12), month), F.lit(1))
        day = F.when(week == 1, F.dayofweek(opens)).otherwise(1)
    return from_week_of_month(year, month, week, day)


_UNITS = {"dd": "DAY", "HH": "HOUR", "mm": "MINUTE", "ss": "SECOND", "SSS": "MILLISECOND"}


def shift(ts: Column, amount: Column | int, unit: str) -> Column:
    """Add calendar years/months (clamped to the month's end) or exact time units."""
    n = amount if isinstance(amount, Column) else F.lit(amount)
    if unit == "yyyy":
        return ts + F.make_ym_interval(n, F.lit(0))
    if unit == "MM":
        return ts + F.make_ym_interval(F.lit(0), n)
    return F.timestamp_add(_UNITS[unit], n, ts)


def span(a: Column, b: Column, unit: str) -> Column:
    """a - b: years and months by calendar field, other units truncated toward zero.

    A missing side counts as 1970-01-01.
    """
    left, right = F.coalesce(a, epoch()), F.coalesce(b, epoch())
    if unit == "yyyy":
        return (F.year(left) - F.year(right)).cast("bigint")
    if unit == "MM":
        return _month_fields(left, right).cast("bigint")
    return F.timestamp_diff(_UNITS[unit], right, left)


def complete_span(a: Column, b: Column, unit: str) -> Column:
    """Completed months or years between a and b, signed."""
    left, right = F.coalesce(a, epoch()), F.coalesce(b, epoch())
    late, early = F.greatest(left, right), F.least(left, right)
    fields = _month_fields(late, early)
    overshoot = (shift(early, fields, "MM") > late).cast("int")
    months = F.when(left < right, -1).otherwise(1) * (fields - overshoot)
    return months if unit == "MM" else (months / 12).cast("int")


def _month_fields(a: Column, b: Column) -> Column:
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def compare(a: Column, b: Column, pattern: str | None = None) -> Column:
    """-1, 0 or 1; a missing date sorts first. A pattern restricts what is compared."""
    if pattern:
        a, b = F.date_format(a, pattern), F.date_format(b, pattern)
    return (
        F.when(a.isNull() & b.isNull(), 0)
        .when(b.isNull(), 1)
        .when(a.isNull(), -1)
        .when(a > b, 1)
        .when(a < b, -1)
        .otherwise(0)
    )


def month_start(ts: Column) -> Column:
    """First day of the month at the same time of day."""
    return shift(ts, F.lit(1) - F.dayofmonth(ts), "dd")


def month_end(ts: Column) -> Column:
    """Last day of the month at the same time of day."""
    return shift(ts, F.dayofmonth(F.last_day(ts)) - F.dayofmonth(ts), "dd")


def set_part(ts: Column, value: int, unit: str) -> Column:
    """Replace one field; a day that the new month lacks rolls over into the next."""
    days = F.dayofmonth(ts) - 1
    if unit == "yyyy":
        return shift(shift(month_start(ts), F.lit(value) - F.year(ts), "yyyy"), days, "dd")
    if unit == "MM":
        return shift(shift(month_start(ts), F.lit(value) - F.month(ts), "MM"), days, "dd")
    current = {"dd": F.dayofmonth, "HH": F.hour, "mm": F.minute}[unit](ts)
    return shift(ts, F.lit(value) - current, unit)
