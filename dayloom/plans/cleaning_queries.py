"""Queries of the cleaning, profiling and key-assignment jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import dates, numbers, text
from dayloom.operators import cleaning, joins
from dayloom.plans.catalogue import query
from dayloom.plans.views import table

_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SINGLE = [(a, b) for a, b in zip(text.ACCENTED, text.UNACCENTED) if len(b) == 1]
_PLAIN_SQL = (
    f"replace(replace(translate(%s, '{''.join(a for a, _ in _SINGLE)}', '{''.join(b for _, b in _SINGLE)}'), "
    "'Æ', 'AE'), 'æ', 'ae')"
)

# --- text --------------------------------------------------------------------------


@query("clean_text", f"""
    SELECT doc_id,
           md5(upper({_PLAIN_SQL % f"trim(text, {_BLANK_SQL})"})) AS title,
           md5(CASE WHEN text LIKE '<![CDATA[%' AND text LIKE '%]]>' THEN text ELSE
               replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
               chr(39), '&apos;'), '"', '&quot;') END) AS xml,
           md5(regexp_replace(text, '([^\\p{{L}}\\p{{Nd}}_\\s])', '\\\\\\1', 'g')) AS escaped,
           md5(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS one_line,
           CASE WHEN length(text) >= 20 THEN substr(text, length(text) - 19, 5) ELSE substr(text, 1, 5) END AS near_end,
           substr(text, 1, 12) AS start_zero,
           md5('"' || text || '"') AS quoted, substr(text, 1, 10) AS head,
           CASE WHEN length(text) >= 10 THEN right(text, 10) ELSE text END AS tail
    FROM documents""")
def clean_text(spark, folder):
    rules = {
        "title": ("text", [("trim",), ("remove_accents",), ("upcase",)]),
        "xml": ("text", [("xml_escape",)]),
        "escaped": ("text", [("escape_chars", "\\")]),
        "one_line": ("text", [("change", r"[ \t\n\f\r]+", " ")]),
        "near_end": ("text", [("piece", -20, 5)]),
        "start_zero": ("text", [("piece", 0, 12)]),
        "quoted": ("text", [("quote", '"')]),
        "head": ("text", [("left", 10)]),
        "tail": ("text", [("right", 10)]),
    }
    cleaned = cleaning.standardise_text(table(spark, folder, "documents").select("doc_id", "text"), rules).drop("text")
    return cleaned.withColumns({c: F.md5(c) for c in ("title", "xml", "escaped", "one_line", "quoted")})


@query("clean_names", """
    SELECT p_partkey,
           CASE WHEN length(p_name) >= 12 THEN p_name ELSE lpad(p_name, 12, '*-') END AS padded_start,
           CASE WHEN length(p_name) >= 12 THEN p_name ELSE rpad(p_name, 12, '*-') END AS padded_end,
           CAST(NULL AS VARCHAR) AS padded_none,
           ltrim(p_name, 'smabigred') AS cut_start, rtrim(p_name, 'tegdrin') AS cut_end,
           trim(p_brand, 'B') AS no_b, lower(p_type) AS lowered,
           p_brand || ';' || coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, 'null') || ';' || p_type
               AS joined,
           repeat(p_brand, 2) AS twice, '' AS beyond,
           CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) || '.0'
                ELSE CAST(p_retailprice AS VARCHAR) END AS price_text
    FROM part""")
def clean_names(spark, folder):
    rows = table(spark, folder, "part")
    rules = {
        "padded_start": ("p_name", [("pad_start", 12, "*-")]),
        "padded_end": ("p_name", [("pad_end", 12, "*-")]),
        "padded_none": ("p_name", [("pad_end", 0, "*")]),
        "cut_start": ("p_name", [("trim_start_set", "smabigred")]),
        "cut_end": ("p_name", [("trim_end_set", "tegdrin")]),
        "no_b": ("p_brand", [("trim_char", "B", 0)]),
        "lowered": ("p_type", [("downcase",)]),
        "twice": ("p_brand", [("repeat", 2)]),
        "beyond": ("p_name", [("piece", 100, 3)]),
    }
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    return cleaning.standardise_text(rows, rules).select(
        "p_partkey", *rules,
        text.join_parts(";", F.col("p_brand"), size, F.col("p_type")).alias("joined"),
        text.number_text(F.col("p_retailprice")).alias("price_text"),
    )


@query("text_variants", """
    SELECT upper(replace(p_name, ' ', '_')) AS clean, p_name AS raw, count(*) AS n FROM part GROUP BY 1, 2""")
def text_variants(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_name").alias("raw"))
    cleaned = cleaning.standardise_text(rows, {"clean": ("raw", [("change", " ", "_"), ("upcase",)])})
    return cleaning.variant_counts(cleaned, "clean", "raw")


_SECOND_SQL = """CASE WHEN length({v}) <= 1 THEN NULL WHEN instr({v}, ' ') = 0 THEN 0
    WHEN instr(substr({v}, instr({v}, ' ') + 1), ' ') = 0 THEN 0
    ELSE instr({v}, ' ') + instr(substr({v}, instr({v}, ' ') + 1), ' ') END"""


@query("profile_text", f"""
    SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS n_null,
           count(*) FILTER (WHERE regexp_full_match(text, '\\p{{L}}*')) AS n_alpha,
           count(*) FILTER (WHERE list_sort(string_split(text, '')) = string_split(text, '')) AS n_sorted,
           CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length,
           CAST(sum(length(text)) AS BIGINT) AS sum_length,
           CAST(sum(length(text) - length(replace(text, ' ', ''))) AS BIGINT) AS occurrences,
           CAST(max(instr(text, ' ') - 1) AS INTEGER) AS max_first_index,
           CAST(sum({_SECOND_SQL.format(v="text")}) AS BIGINT) AS sum_second_position,
           CAST(sum(CASE WHEN length(text) <= 1 THEN NULL WHEN instr(text, ' ') = 0 THEN 0
               ELSE length(text) - length(regexp_extract(text, '[^ ]*$')) END) AS BIGINT) AS sum_last_position,
           CAST(sum(CASE WHEN length(text) <= 1 THEN NULL WHEN instr(text, ' ') = 0 THEN 0
               ELSE strlen(substr(text, 1, instr(text, ' ') - 1)) + 1 END) AS BIGINT) AS sum_byte_position
    FROM documents GROUP BY lang""")
def profile_text(spark, folder):
    return cleaning.profile_text(table(spark, folder, "documents"), "text", ["lang"])


@query("profile_overlaps", """
    SELECT c_custkey,
           CAST(len(list_filter(range(1, length(c_name)), lambda i: substr(c_name, i, 2) = '00')) AS INTEGER) AS pairs,
           CAST(instr(c_name, '00') - 1 AS INTEGER) AS first_index, CAST(length(c_name) AS INTEGER) AS size,
           regexp_full_match(c_mktsegment, '\\p{L}*') AS is_alpha
    FROM customer""")
def profile_overlaps(spark, folder):
    name = F.col("c_name")
    return table(spark, folder, "customer").select(
        "c_custkey",
        text.occurrences(name, "00").alias("pairs"),
        text.index_of(name, "00").alias("first_index"),
        text.size(name).alias("size"),
        text.is_alpha(F.col("c_mktsegment")).alias("is_alpha"),
    )


@query("decode_lookup", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'missing' ELSE 'other' END AS status
    FROM orders""")
def decode_lookup(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("code"))
    return joins.decode_lookup(rows, "code", {"F": "final", None: "missing"}, "other", "status").drop("code")


# --- numbers ---------------------------------------------------------------------------


@query("clean_numbers", """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 10 = 0 AS price_rejected,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust,
           o_orderkey % 7 = 0 AS cust_rejected,
           o_orderkey AS hexed, false AS hexed_rejected,
           o_orderkey / 100.0 AS implied, false AS implied_rejected,
           CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS digits_only,
           CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 THEN NULL
                WHEN o_totalprice > o_custkey THEN 1 WHEN o_totalprice = o_custkey THEN 0 ELSE -1 END AS compared,
           CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice + o_custkey END AS added
    FROM orders""")
def clean_numbers(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("t_price"),
        F.when(key % 7 == 0, F.concat("o_custkey", F.lit("x"))).otherwise(F.col("o_custkey").cast("string")).alias("t_cust"),
        F.lower(F.hex(key)).alias("t_hex"),
        key.cast("string").alias("t_key"),
    )
    parsed = cleaning.clean_numbers(rows, {
        "price": ("t_price", "real"), "cust": ("t_cust", "long"), "hexed": ("t_hex", "hex_long"),
        "implied": ("t_key", "9(8)V99"),
    })
    return parsed.select(
        "*",
        numbers.is_digits(F.col("t_cust")).alias("digits_only"),
        numbers.compare_text(F.col("t_price"), F.col("t_cust")).alias("compared"),
        numbers.text_arithmetic(F.col("t_price"), F.col("t_cust"), "add").alias("added"),
    ).withColumn("implied", F.col("implied").cast("double")).drop("t_price", "t_cust", "t_hex", "t_key")


@query("number_measures", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(trunc(l_extendedprice / l_quantity) AS INTEGER) AS whole_price,
           round(l_extendedprice % l_quantity, 6) AS rest,
           l_orderkey & l_partkey AS bits_and,
           l_orderkey | l_partkey AS bits_or,
           xor(l_orderkey, l_partkey) AS bits_xor,
           -1 - l_orderkey AS bits_not,
           CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS nearest,
           printf('%x', l_orderkey) AS hexed,
           round(exp(l_discount), 6) AS e, round(ln(l_quantity), 6) AS l, round(sqrt(l_extendedprice), 6) AS r,
           round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS c, round(tan(l_discount), 6) AS t,
           round(asin(l_discount), 6) AS asn, round(acos(l_discount), 6) AS acs, round(atan(l_quantity), 6) AS atn,
           round(sinh(l_discount), 6) AS snh, round(cosh(l_discount), 6) AS csh, round(tanh(l_discount), 6) AS tnh,
           abs(l_tax - 0.05) AS absolute, -l_quantity AS negative
    FROM lineitem""")
def number_measures(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        (F.col("l_tax") - 0.05).alias("tax_gap"),
    )
    measured = cleaning.clean_numbers(rows, measures={
        "whole_price": ("quotient", "l_extendedprice", "l_quantity"),
        "rest": ("remainder", "l_extendedprice", "l_quantity"),
        "bits_and": ("bitand", "l_orderkey", "l_partkey"),
        "bits_or": ("bitor", "l_orderkey", "l_partkey"),
        "bits_xor": ("bitxor", "l_orderkey", "l_partkey"),
        "bits_not": ("bitnot", "l_orderkey"),
        "nearest": ("half_up", "l_extendedprice"),
        "hexed": ("hex", "l_orderkey"),
        "e": ("exp", "l_discount"), "l": ("ln", "l_quantity"), "r": ("sqrt", "l_extendedprice"),
        "s": ("sin", "l_quantity"), "c": ("cos", "l_quantity"), "t": ("tan", "l_discount"),
        "asn": ("asin", "l_discount"), "acs": ("acos", "l_discount"), "atn": ("atan", "l_quantity"),
        "snh": ("sinh", "l_discount"), "csh": ("cosh", "l_discount"), "tnh": ("tanh", "l_discount"),
        "absolute": ("abs", "tax_gap"), "negative": ("neg", "l_quantity"),
    })
    rounded = "rest e l r s c t asn acs atn snh csh tnh".split()
    return measured.withColumns({c: F.round(c, 6) for c in rounded}).drop(
        "l_quantity", "l_extendedprice", "l_discount", "tax_gap"
    )


# --- dates -----------------------------------------------------------------------------

# How the text of an order's date is written, by order key modulo 5.
_WRITTEN = ["yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]


def _written_dates(spark, folder):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(key % 5 == 3, "2001-02-45").when(key % 5 == 4, F.lit(None).cast("string"))
    for i, pattern in enumerate(_WRITTEN):
        written = written.when(key % 5 == i, F.date_format(day, pattern))
    return table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", written.alias("written"))


@query("standardise_dates", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate END AS parsed,
           CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed_text,
           o_orderkey % 5 < 3 AS parsed_valid
    FROM orders""")
def standardise_dates(spark, folder):
    return cleaning.standardise_dates(_written_dates(spark, folder), "written", _WRITTEN).drop("written", "o_orderpriority")


@query("date_rejects", """
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 5 >= 3) AS n_rejected
    FROM orders GROUP BY 1""")
def date_rejects(spark, folder):
    flagged = cleaning.standardise_dates(_written_dates(spark, folder), "written", _WRITTEN)
    return cleaning.reject_counts(flagged, "parsed_valid", ["o_orderpriority"])


@query("database_dates", """
    SELECT event_id, strftime(ts, '%Y-%m-') || day(ts) || strftime(ts, ' %H:%M:%S') AS written,
           date_trunc('second', ts) AS parsed, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS millis,
           date_trunc('milliseconds', ts) AS from_millis,
           year(ts) || ' w' || CASE WHEN date_trunc('day', ts) + to_days(CAST(6 - dayofweek(ts) AS INTEGER))
               >= make_date(year(ts) + 1, 1, 1) THEN 1 ELSE
               (dayofyear(ts) + (dayofweek(date_trunc('year', ts)))  - 1) // 7 + 1 END AS week
    FROM events""")
def database_dates(spark, folder):
    pattern, ts = "YYYY-MM-DD HH24:MI:SS", F.col("ts")
    rows = table(spark, folder, "events").select(
        "event_id",
        dates.to_database_text(ts, pattern).alias("written"),
        dates.to_database_text(ts, dates.EPOCH_MILLIS).alias("millis"),
        F.regexp_replace(dates.to_database_text(ts, "YYYY-WW"), "-", " w").alias("week"),
    )
    return rows.select(
        "*",
        dates.from_database_text(F.col("written"), pattern).alias("parsed"),
        dates.from_database_text(F.col("millis"), dates.EPOCH_MILLIS).alias("from_millis"),
    )


_FRENCH = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


@query("localised_dates", f"""
    SELECT o_orderkey, day(o_orderdate) || ' ' || list_extract({_FRENCH}, month(o_orderdate)) || ' ' || year(o_orderdate)
           AS written, o_orderdate AS parsed, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS in_zone,
           o_orderdate - INTERVAL 2 HOUR AS from_zone, strftime(o_orderdate + INTERVAL 45 DAY, '%d-%m-%Y') AS later
    FROM orders""")
def localised_dates(spark, folder):
    day, pattern = F.col("o_orderdate"), "d MMMM yyyy"
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        dates.format_localised(day, pattern, "fr-FR").alias("written"),
        dates.format_in_zone(day, dates.MARK_PATTERN, "+02:00").alias("in_zone"),
        dates.parse_in_zone(F.date_format(day, dates.MARK_PATTERN), dates.MARK_PATTERN, "+02:00").alias("from_zone"),
        dates.shift_text(F.date_format(day, "dd-MM-yyyy"), "dd-MM-yyyy", 45, "dd").alias("later"),
    )
    return rows.withColumn("parsed", dates.parse_localised(F.col("written"), pattern, "fr-FR"))


@query("date_measures", """
    WITH base AS (
        SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS a,
               CASE WHEN o_orderkey % 11 <> 0
                    THEN o_orderdate + to_days(CAST(o_custkey % 900 - 450 AS INTEGER)) + INTERVAL 6 HOUR END AS b
        FROM orders),
    filled AS (SELECT *, coalesce(b, TIMESTAMP '1970-01-01') AS f,
        CAST(a AS DATE) - CAST(dayofweek(a) AS INTEGER) AS sunday FROM base),
    months AS (SELECT *, greatest(a, f) AS late, least(a, f) AS early,
        (year(greatest(a, f)) - year(least(a, f))) * 12 + month(greatest(a, f)) - month(least(a, f)) AS m FROM filled),
    whole AS (SELECT *, CASE WHEN a < f THEN -1 ELSE 1 END
        * (m - CASE WHEN early + to_months(CAST(m AS INTEGER)) > late THEN 1 ELSE 0 END) AS cm FROM months)
    SELECT o_orderkey,
           CAST(year(a) AS INTEGER) AS a_year, CAST(month(a) - 1 AS INTEGER) AS a_month,
           CAST(hour(a) % 12 AS INTEGER) AS a_hour, CAST(minute(a) AS INTEGER) AS a_minute,
           CAST(second(a) AS INTEGER) AS a_second, CAST(dayofweek(a) + 1 AS INTEGER) AS a_day_of_week,
           CAST(day(a) AS INTEGER) AS a_day_of_month, CAST(dayofyear(a) AS INTEGER) AS a_day_of_year,
           CAST((sunday - (date_trunc('month', CAST(a AS DATE))::DATE
               - CAST(dayofweek(date_trunc('month', a)) AS INTEGER))) // 7 + 1 AS INTEGER) AS a_week_of_month,
           CAST((day(a) - 1) // 7 + 1 AS INTEGER) AS a_day_of_week_in_month,
           CAST(CASE WHEN year(sunday + 6) > year(a) THEN 1 ELSE (sunday - (date_trunc('year', CAST(a AS DATE))::DATE
               - CAST(dayofweek(date_trunc('year', a)) AS INTEGER))) // 7 + 1 END AS INTEGER) AS a_week_of_year,
           0 AS a_timezone,
           CAST(year(a) - year(f) AS BIGINT) AS diff_yyyy,
           CAST((year(a) - year(f)) * 12 + month(a) - month(f) AS BIGINT) AS diff_month,
           CAST(trunc((epoch_ms(a) - epoch_ms(f)) / 86400000.0) AS BIGINT) AS diff_dd,
           CAST(trunc((epoch_ms(a) - epoch_ms(f)) / 3600000.0) AS BIGINT) AS diff_hh,
           CAST(trunc((epoch_ms(a) - epoch_ms(f)) / 60000.0) AS BIGINT) AS diff_mm,
           CAST(trunc((epoch_ms(a) - epoch_ms(f)) / 1000.0) AS BIGINT) AS diff_ss,
           CAST(epoch_ms(a) - epoch_ms(f) AS BIGINT) AS diff_sss,
           CAST(cm AS INTEGER) AS complete_months, CAST(trunc(cm / 12.0) AS INTEGER) AS complete_years,
           CASE WHEN b IS NULL THEN 1 WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS compared,
           CASE WHEN b IS NULL THEN 1 WHEN strftime(a, '%Y-%m') > strftime(b, '%Y-%m') THEN 1
                WHEN strftime(a, '%Y-%m') < strftime(b, '%Y-%m') THEN -1 ELSE 0 END AS compared_month,
           date_trunc('month', a) + (a - date_trunc('day', a)) AS month_first,
           CAST(last_day(a) AS TIMESTAMP) + (a - date_trunc('day', a)) AS month_last,
           a + INTERVAL 1 MONTH AS plus_month, a + INTERVAL 10 DAY AS plus_days,
           CAST(make_date(year(a), 2, 1) + CAST(day(a) - 1 AS INTEGER) AS TIMESTAMP) + (a - date_trunc('day', a))
               AS in_february
    FROM whole""")
def date_measures(spark, folder):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        dates.shift(day, key % 86400, "ss").alias("a"),
        F.when(key % 11 != 0, dates.shift(dates.shift(day, F.col("o_custkey") % 900 - 450, "dd"), 6, "HH")).alias("b"),
    )
    return cleaning.date_measures(rows, "a", "b").drop("a", "b")


# --- keys, nulls, made-up columns ------------------------------------------------------


@query("assign_sequence", """
    SELECT o_orderstatus, o_orderkey,
           100 + 5 * (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) AS sequence FROM orders""")
def assign_sequence(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey")
    return cleaning.assign_sequence(rows, "o_orderstatus", ["o_orderkey"], 100, 5, unique_order=True)


@query("assign_sequence_ties", """
    SELECT l_returnflag, min(sequence) AS first, max(sequence) AS last, count(DISTINCT sequence) AS n
    FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) AS sequence FROM lineitem)
    GROUP BY 1""")
def assign_sequence_ties(spark, folder):
    # The order column has two values: every number is a tie broken by the row's place.
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    numbered = cleaning.assign_sequence(rows, "l_returnflag", ["l_linestatus"])
    return numbered.groupBy("l_returnflag").agg(
        F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_distinct("sequence").alias("n")
    )


@query("null_profile", """
    WITH base AS (SELECT doc_id, nullif(lang, 'en') AS lang, nullif(source, 'web') AS source, text FROM documents)
    SELECT 'doc_id' AS column_name, count(*) AS n_rows, count(*) - count(doc_id) AS n_null,
           (count(*) - count(doc_id)) / count(*) AS null_share FROM base
    UNION ALL SELECT 'lang', count(*), count(*) - count(lang), (count(*) - count(lang)) / count(*) FROM base
    UNION ALL SELECT 'source', count(*), count(*) - count(source), (count(*) - count(source)) / count(*) FROM base
    UNION ALL SELECT 'text', count(*), count(*) - count(text), (count(*) - count(text)) / count(*) FROM base""")
def null_profile(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id", F.nullif("lang", F.lit("en")).alias("lang"), F.nullif("source", F.lit("web")).alias("source"), "text"
    )
    return cleaning.null_profile(rows)


def _bucket_sql(n: int, seed: int) -> str:
    return f"CAST('0x' || substr(md5(c_custkey || '|{seed}'), 1, 8) AS BIGINT) % {n}"


def _pick_sql(words: list[str], seed: int) -> str:
    return f"list_extract([{', '.join(repr(w) for w in words)}], {_bucket_sql(len(words), seed)} + 1)"


_STATES = list(cleaning.STATES)


@query("synth_table", f"""
    SELECT c_custkey, {_pick_sql(cleaning.FIRST_NAMES, 8)} AS first_name, {_pick_sql(cleaning.LAST_NAMES, 9)} AS last_name,
           ({_bucket_sql(999, 10)} + 1) || ' ' || {_pick_sql(cleaning.STREETS, 11)} || ' Street' AS street,
           {_pick_sql(cleaning.CITIES, 12)} AS city, {_pick_sql(_STATES, 13)} AS state_id,
           {_pick_sql([cleaning.STATES[s] for s in _STATES], 13)} AS state,
           CAST({_bucket_sql(10_001, 14)} AS INTEGER) AS amount,
           round(({_bucket_sql(2**31 - 1, 16)}) / CAST({2**31 - 1} AS DOUBLE), 9) AS ratio,
           {" || ".join(f"substr('{cleaning.ALPHANUMERIC}', {_bucket_sql(62, 107 + i)} + 1, 1)" for i in range(8))} AS code,
           DATE '2000-01-01' + CAST({_bucket_sql(3650, 15)} AS INTEGER) AS day
    FROM customer""")
def synth_table(spark, folder):
    made = cleaning.synth_columns(table(spark, folder, "customer").select("c_custkey"), ["c_custkey"], seed=7)
    return made.withColumn("ratio", F.round("ratio", 9))


@query("week_dates_parsed", """
    WITH days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
    years AS (SELECT *, year(d + CAST(6 - dayofweek(d) AS INTEGER)) AS y FROM days),
    ends AS (SELECT *, make_date(y, 1, 1) - CAST(dayofweek(make_date(y, 1, 1)) AS INTEGER) + 370 AS week_53 FROM years)
    SELECT o_orderkey, d AS by_week, d AS by_iso_week, d AS by_month_week, d - CAST(dayofweek(d) AS INTEGER) AS week_start,
           CASE WHEN year(week_53) = y THEN week_53 END AS last_saturday,
           CASE WHEN dayofweek(date_trunc('month', d)) = 0 THEN CAST(date_trunc('month', d) AS DATE) END AS first_sunday,
           true AS misfits_flagged FROM ends""")
def week_dates_parsed(spark, folder):
    """Dates written by week, by ISO week and by week of the month, and read back; weeks and days that are not there give null."""
    days = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    d = F.col("d")
    month, weekday = F.date_format(d, "yyyy-MM"), F.dayofweek(d)
    written = days.select(
        "o_orderkey",
        F.format_string("%d-%02d-%d", dates.week_year(d), dates.calendar_part(d, "WEEK_OF_YEAR"), weekday).alias("us"),
        F.format_string("%d/%02d/%d", dates.week_year(d, "iso"), dates.calendar_part(d, "WEEK_OF_YEAR", "iso"), weekday).alias("iso"),
        F.format_string("%s %d.%d", month, dates.calendar_part(d, "WEEK_OF_MONTH"), weekday).alias("month"))
    year = F.substring("us", 1, 4)
    wrong = [dates.from_week_text(F.concat(year, F.lit(rest)), "YYYY-WW-D") for rest in ("-54-1", "-00-1", "-10-8", "-10-1 ", "-1x-1")]
    flagged = F.lit(True)
    for parsed in wrong:
        flagged = flagged & parsed.isNull()
    return written.select(
        "o_orderkey", dates.from_week_text(F.col("us"), "YYYY-WW-D").alias("by_week"),
        dates.from_week_text(F.col("iso"), "YYYY/WW/D", "iso").alias("by_iso_week"),
        dates.from_week_text(F.col("month"), "YYYY-MM W.D").alias("by_month_week"),
        dates.from_week_text(F.substring("us", 1, 7), "YYYY-WW").alias("week_start"),
        dates.from_week_text(F.concat(year, F.lit("-53-7")), "YYYY-WW-D").alias("last_saturday"),
        dates.from_week_text(F.concat(F.substring("month", 1, 7), F.lit(" 1.1")), "YYYY-MM W.D").alias("first_sunday"),
        flagged.alias("misfits_flagged"))
