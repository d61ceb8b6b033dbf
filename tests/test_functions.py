"""Column builders against values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayloom.functions import dates, numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: text.pad_start(F.lit("ab"), 5, "xyz"), "xyzab"),
        (lambda: text.pad_start(F.lit("abcdef"), 3, "x"), "abcdef"),
        (lambda: text.pad_end(F.lit("ab"), 5, "xy"), "abxyx"),
        (lambda: text.pad_end(F.lit("ab"), 4), "ab  "),
        (lambda: text.pad_end(F.lit(""), 4), None),
        (lambda: text.pad_start(F.lit("ab"), 0), None),
        (lambda: text.piece(F.lit("hello"), 0, 2), "he"),
        (lambda: text.piece(F.lit("hello"), -3, 2), "ll"),
        (lambda: text.piece(F.lit("hello"), -9, 2), "he"),
        (lambda: text.piece(F.lit("hello"), 2), "ello"),
        (lambda: text.piece(F.lit("hello"), 6, 1), ""),
        (lambda: text.piece(F.lit("hello"), 2, 0), ""),
        (lambda: text.piece(F.lit(""), 1, 1), None),
        (lambda: text.trim(F.lit("\x01 \t a b \n\x00")), "a b"),
        (lambda: text.trim_start(F.lit("\n a ")), "a "),
        (lambda: text.trim_end(F.lit("\n a ")), "\n a"),
        (lambda: text.trim_start_set(F.lit("xyxa"), "yx"), "a"),
        (lambda: text.trim_end_set(F.lit("xyx"), "yx"), ""),
        (lambda: text.trim_end_set(F.lit(""), "yx"), None),
        (lambda: text.trim_char(F.lit("00100"), "0", 1), "100"),
        (lambda: text.trim_char(F.lit("00100"), "0", -1), "001"),
        (lambda: text.trim_char(F.lit("..1.."), ".", 0), "1"),
        (lambda: text.remove_accents(F.lit("Ærø, façade, Ø×÷ß ÿ Þ ő")), "AEr0, facade, 0*/B y _ ő"),
        (lambda: text.xml_escape(F.lit("<a b='c'>&\"")), "&lt;a b=&apos;c&apos;&gt;&amp;&quot;"),
        (lambda: text.xml_escape(F.lit("<![CDATA[<&]]>")), "<![CDATA[<&]]>"),
        (lambda: text.escape_chars(F.lit("a-b_c d.é"), "\\"), "a\\-b_c d\\.é"),
        (lambda: text.escape_chars(F.lit("a-b"), "$"), "a$-b"),
        (lambda: text.join_parts("-", F.lit("a"), F.lit(None).cast("string"), F.lit(3)), "a-null-3"),
        (lambda: text.number_text(F.lit(12345678.5)), "12345678.5"),
        (lambda: text.number_text(F.lit(1e20)), "1.0E20"),
        (lambda: text.number_text(F.lit(2.5)), "2.5"),
        (lambda: text.is_alpha(F.lit("Éa")), True),
        (lambda: text.is_alpha(F.lit("a1")), False),
        (lambda: text.is_alpha(F.lit("")), True),
        (lambda: text.is_alpha(F.lit(None).cast("string")), False),
        (lambda: text.is_sorted(F.lit("abz")), True),
        (lambda: text.is_sorted(F.lit("ba")), False),
        (lambda: text.size(F.lit(None).cast("string")), -1),
        (lambda: text.index_of(F.lit("banana"), "an"), 1),
        (lambda: text.index_of(F.lit(None).cast("string"), "an"), -1),
        (lambda: text.occurrences(F.lit("aaaa"), "aa"), 3),
        (lambda: text.occurrences(F.lit("banana"), "ana"), 2),
        (lambda: text.occurrences(F.lit("banana"), "an"), 2),
        (lambda: text.occurrences(F.lit(None).cast("string"), "an"), 0),
        (lambda: text.nth_position(F.lit("banana"), "an"), 2),
        (lambda: text.nth_position(F.lit("banana"), "an", 1, 2), 4),
        (lambda: text.nth_position(F.lit("banana"), "an", 3), 2),
        (lambda: text.nth_position(F.lit("banana"), "an", 1, 3), 0),
        (lambda: text.nth_position(F.lit("banana"), "an", -1), 4),
        (lambda: text.nth_position(F.lit("banana"), "an", -3), 2),
        (lambda: text.nth_position(F.lit("banana"), "an", -1, 2), 2),
        (lambda: text.nth_position(F.lit("banana"), "an", -1, 3), 0),
        (lambda: text.nth_position(F.lit("aaaaa"), "aa", -1, 2), 2),
        (lambda: text.nth_position(F.lit("aaaaa"), "aa", -2, 1), 3),
        (lambda: text.nth_position(F.lit("a b c"), " ", -1, 2), 2),
        (lambda: text.nth_position(F.lit("a b c"), " ", -1, 3), 0),
        (lambda: text.nth_position(F.lit(" b c"), " ", -1, 2), 1),
        (lambda: text.nth_position(F.lit(None).cast("string"), " ", -1), None),
        (lambda: text.nth_position(F.lit("a"), "a"), None),
        (lambda: text.is_sorted(F.lit("a" * 40 + "b")), True),
        (lambda: text.is_sorted(F.lit("b" * 40 + "a")), False),
        (lambda: text.byte_position(F.lit("éa-b"), "-"), 4),
        (lambda: numbers.half_up(F.lit(-2.5)), -2),
        (lambda: numbers.half_up(F.lit(2.5)), 3),
        (lambda: numbers.half_up_text(F.lit(1.005), 1), "1.0"),
        (lambda: numbers.whole(F.lit("+12")), 12),
        (lambda: numbers.whole(F.lit("99999999999")), None),
        (lambda: numbers.whole(F.lit("1.5")), None),
        (lambda: numbers.is_digits(F.lit("12")), 1),
        (lambda: numbers.is_digits(F.lit("-12")), 0),
        (lambda: numbers.from_hex(F.lit("-fF")), -255),
        (lambda: numbers.from_hex(F.lit("80000000")), None),
        (lambda: numbers.from_hex(F.lit("g")), None),
        (lambda: numbers.to_hex(F.lit(-1)), "ffffffff"),
        (lambda: numbers.to_hex(F.lit(255)), "ff"),
        (lambda: numbers.digit_char(F.lit(7)), "7"),
        (lambda: numbers.quotient(F.lit(-7.0), F.lit(2.0)), -3),
        (lambda: numbers.quotient(F.lit(1e30), F.lit(1.0)), 2147483647),
        (lambda: numbers.remainder(F.lit(-7.0), F.lit(4.0)), -3.0),
        (lambda: numbers.compare_text(F.lit("10"), F.lit("9.5")), 1),
        (lambda: numbers.compare_text(F.lit("x"), F.lit("9.5")), None),
        (lambda: numbers.implied_decimal(F.lit("1234"), "99V99").cast("double"), 12.34),
    ],
)
def test_text_and_numbers(spark, column, expected):
    assert value(spark, column()) == expected


def test_spark_pattern():
    assert dates.spark_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-d HH:mm:ss"
    assert dates.spark_pattern("DD MON YY HH:MI A.M.") == "d MMM yy hh:mm a"
    with pytest.raises(ValueError):
        dates.spark_pattern("YYYY WW")


@pytest.mark.parametrize(
    "written, fits", [("2020-02-29", True), ("2021-02-29", False), ("2020-2-9", False), ("45", False), (None, False)]
)
def test_fits_pattern(spark, written, fits):
    assert value(spark, dates.fits_pattern(F.lit(written).cast("string"), "yyyy-MM-dd")) is fits


TS = dt.datetime


def ntz(text_value):
    return F.lit(text_value).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: dates.shift(ntz("2020-01-31 05:00:00"), 1, "MM"), TS(2020, 2, 29, 5)),
        (lambda: dates.shift(ntz("2020-02-29 05:00:00"), 1, "yyyy"), TS(2021, 2, 28, 5)),
        (lambda: dates.shift(ntz("2020-02-29 05:00:00"), -1, "ss"), TS(2020, 2, 29, 4, 59, 59)),
        (lambda: dates.span(ntz("2020-02-01"), ntz("2020-01-31"), "MM"), 1),
        (lambda: dates.span(ntz("2020-01-01"), ntz("2019-12-31"), "yyyy"), 1),
        (lambda: dates.span(ntz("2020-01-01 00:00:00"), ntz("2020-01-02 23:00:00"), "dd"), -1),
        (lambda: dates.span(F.lit(None).cast("timestamp_ntz"), ntz("1970-01-02"), "dd"), -1),
        (lambda: dates.complete_span(ntz("2020-02-29"), ntz("2020-01-31"), "MM"), 1),
        (lambda: dates.complete_span(ntz("2020-02-28"), ntz("2020-01-31"), "MM"), 0),
        (lambda: dates.complete_span(ntz("2019-01-01"), ntz("2020-12-31"), "yyyy"), -1),
        (lambda: dates.month_start(ntz("2020-02-29 07:00:00")), TS(2020, 2, 1, 7)),
        (lambda: dates.month_end(ntz("2020-02-01 07:00:00")), TS(2020, 2, 29, 7)),
        (lambda: dates.set_part(ntz("2020-01-31 07:00:00"), 2, "MM"), TS(2020, 3, 2, 7)),
        (lambda: dates.set_part(ntz("2020-02-29 07:00:00"), 2021, "yyyy"), TS(2021, 3, 1, 7)),
        (lambda: dates.set_part(ntz("2020-01-15 07:00:00"), 40, "dd"), TS(2020, 2, 9, 7)),
        (lambda: dates.set_part(ntz("2020-01-15 07:05:00"), 9, "HH"), TS(2020, 1, 15, 9, 5)),
        (lambda: dates.calendar_part(ntz("2020-01-01 13:00:00"), "HOUR"), 1),
        (lambda: dates.calendar_part(ntz("2020-01-01"), "MONTH"), 0),
        (lambda: dates.calendar_part(ntz("2020-01-05"), "WEEK_OF_YEAR"), 2),
        (lambda: dates.calendar_part(ntz("2019-12-29"), "WEEK_OF_YEAR"), 1),
        (lambda: dates.calendar_part(ntz("2019-12-29"), "WEEK_OF_YEAR", "iso"), 52),
        (lambda: dates.calendar_part(ntz("2020-02-02"), "WEEK_OF_MONTH"), 2),
        (lambda: dates.calendar_part(ntz("2020-02-08"), "DAY_OF_WEEK_IN_MONTH"), 2),
        (lambda: dates.compare(ntz("2020-01-31"), ntz("2020-01-01"), "yyyy-MM"), 0),
        (lambda: dates.compare(F.lit(None).cast("timestamp_ntz"), ntz("2020-01-01")), -1),
        (lambda: dates.to_database_text(ntz("2020-03-04 15:06:07"), "DD/MM/YYYY HH24:MI"), "4/03/2020 15:06"),
        (lambda: dates.to_database_text(ntz("1970-01-01 00:00:01"), "J"), "1000"),
        (lambda: dates.from_database_text(F.lit("1500"), "J"), TS(1970, 1, 1, 0, 0, 1, 500000)),
        (lambda: dates.from_database_text(F.lit("")), None),
        (lambda: dates.parse_timestamp(F.lit("2020-01-22T03:04:05Z"), dates.API_PATTERN), TS(2020, 1, 22, 3, 4, 5)),
        (lambda: dates.ordinal_day(ntz("2020-02-01")), 32 + 365 * 2020),
    ],
)
def test_dates(spark, column, expected):
    assert value(spark, column()) == expected


def test_localised_text_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        written = dates.format_localised(ntz("2020-08-05 01:02:03"), "d MMMM yyyy HH:mm", "fr-FR")
        assert value(spark, written) == "5 août 2020 01:02"
        parsed = dates.parse_localised(F.lit("5 août 2020 01:02"), "d MMMM yyyy HH:mm", "fr-FR")
        assert value(spark, parsed) == dt.datetime(2020, 8, 5, 1, 2)
        assert value(spark, dates.parse_localised(F.lit("5 August 2020 01:02"), "d MMMM yyyy HH:mm", "fr-FR")) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert value(spark, dates.format_offset(ntz("2020-08-05 01:02:03"), "+01:00")) == "2020-08-05 01:02:03.000+01:00"


def test_utc_day_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        got = value(spark, dates.utc_day(dates.from_utc_clock(ntz("2020-07-01 23:30:00"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == dt.date(2020, 7, 1)


def test_keys_beyond_32_bits(spark):
    from dayloom.functions import numbers
    from dayloom.operators.columns import round_half_up

    big = 3_000_000_000
    df = spark.createDataFrame([(big, 5, "b2d05e00")], "k bigint, j bigint, h string")
    k, j = F.col("k"), F.col("j")
    row = df.select(
        numbers.PAIR_MEASURES["bitand"](k, j), numbers.PAIR_MEASURES["bitor"](k, j), numbers.PAIR_MEASURES["bitxor"](k, j),
        numbers.MEASURES["bitnot"](k), numbers.to_hex(k), numbers.from_hex_long(F.col("h")), numbers.wrap32(k),
        round_half_up(k.cast("double")), numbers.whole_long(k.cast("string"))).first()
    assert tuple(row) == (big & 5, big | 5, big ^ 5, ~big, "b2d05e00", big, big - 2**32, big, big)


def test_every_day_reads_back_from_its_week(spark):
    # Every weekday as first of January, leap years too.
    days = spark.sql("SELECT explode(sequence(date'1995-01-01', date'2024-12-31')) AS d")
    d = F.col("d")
    parts = {rule: (dates.week_year(d, rule), dates.calendar_part(d, "WEEK_OF_YEAR", rule), F.dayofweek(d)) for rule in ("us", "iso")}
    for rule, (year, week, weekday) in parts.items():
        assert days.where(~dates.from_week_of_year(year, week, weekday, rule).eqNullSafe(d)).isEmpty()
    month = dates.from_week_of_month(F.year(d), F.month(d), dates.calendar_part(d, "WEEK_OF_MONTH"), F.dayofweek(d))
    assert days.where(~month.eqNullSafe(d)).isEmpty()


@pytest.mark.parametrize("text_value, pattern, rule, expected", [
    ("2024-01-1", "YYYY-WW-D", "us", "2023-12-31"), ("2024-01", "YYYY-WW", "us", "2023-12-31"),
    ("2021-53-1", "YYYY-WW-D", "us", None), ("2022-53-7", "YYYY-WW-D", "us", "2022-12-31"),
    ("2023-53-1", "YYYY-WW-D", "us", None), ("2020-53-1", "YYYY-WW-D", "iso", "2021-01-03"),
    ("2021-53-2", "YYYY-WW-D", "iso", None), ("2021-01", "YYYY-WW", "iso", "2021-01-04"),
    ("2024.02/1", "YYYY.MM/W", "us", "2024-02-01"), ("2024.02/1/1", "YYYY.MM/W/D", "us", None),
    ("2024.13/1", "YYYY.MM/W", "us", None), ("2024-10-8", "YYYY-WW-D", "us", None), ("2024-00-1", "YYYY-WW-D", "us", None),
    ("0000-01-1", "YYYY-WW-D", "us", None), ("", "YYYY-WW", "us", None), (None, "YYYY-WW", "us", None),
    ("2024-10\n", "YYYY-WW", "us", None)])
def test_week_texts(spark, text_value, pattern, rule, expected):
    got = value(spark, dates.from_week_text(F.lit(text_value).cast("string"), pattern, rule))
    assert got == (dt.date.fromisoformat(expected) if expected else None)


@pytest.mark.parametrize("pattern", ["YYYY", "WW", "YYYY-W", "YYYY-MM", "YYYY-MM-WW", "YYYY-WW-WW"])
def test_week_patterns_must_name_a_week(pattern):
    with pytest.raises(ValueError):
        dates.from_week_text(F.lit("2024"), pattern)
