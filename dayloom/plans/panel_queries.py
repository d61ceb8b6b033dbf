"""Queries of the panel algebra: projections, filters, joins, sums, windows, unions, date features."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.operators import calendar, columns, joins, lags, panel
from dayloom.plans.catalogue import query
from dayloom.plans.views import (
    PANEL_KEYS,
    PANEL_METRICS,
    country_counts,
    country_panel,
    cum_panel,
    events_daily,
    table,
    with_views,
)
from dayloom.plans.views import panel as panel_view
from dayloom.session import materialise

# --- sums ------------------------------------------------------------------------


@query("panel_sum", with_views("panel", "SELECT * FROM panel"))
def panel_sum(spark, folder):
    return panel_view(spark, folder)


@query("panel_sum_dropnull", """
    SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
           CAST(o_orderdate AS DATE) AS "Date", count(*) AS "Confirmed"
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def panel_sum_dropnull(spark, folder):
    priority = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    rows = table(spark, folder, "orders").select(
        priority, F.col("o_orderdate").cast("date").alias("Date"), F.lit(1).alias("Confirmed")
    )
    return panel.sum_panel_known(rows, ["priority"], ["Confirmed"])


@query("panel_sum_nullkey", """
    SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
           CAST(o_orderdate AS DATE) AS "Date", count(*) AS "Confirmed"
    FROM orders GROUP BY 1, 2""")
def panel_sum_nullkey(spark, folder):
    priority = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    rows = table(spark, folder, "orders").select(
        priority, F.col("o_orderdate").cast("date").alias("Date"), F.lit(1).alias("Confirmed")
    )
    return panel.sum_panel(rows, ["priority"], ["Confirmed"])


@query("status_pivot", """
    SELECT o_custkey, CAST(o_orderdate AS DATE) AS "Date",
           count(*) FILTER (WHERE o_orderstatus = 'O') AS confirmed,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS deaths,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS recovered
    FROM orders GROUP BY 1, 2""")
def status_pivot(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("Date"),
        F.col("o_orderstatus").alias("Status"),
        F.lit(1).alias("Cases"),
    )
    return panel.status_pivot(rows, ["o_custkey", "Date"], {"O": "confirmed", "F": "deaths", "P": "recovered"})


@query("world_series", """
    SELECT CAST(o_orderdate AS DATE) AS "Date", count(*) AS "Confirmed",
           count(*) FILTER (WHERE o_orderstatus = 'F') AS "Deaths",
           count(*) FILTER (WHERE o_orderstatus = 'O') AS "Recovered"
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1""")
def world_series(spark, folder):
    return panel.sum_panel(panel_view(spark, folder), [], PANEL_METRICS)


@query("daily_residual_rollup", """
    SELECT CAST(o_orderdate AS DATE) AS "Date", n_name AS "Country", 'C' || n_nationkey AS "CountryCode",
           CAST(count(*) - count(*) FILTER (WHERE o_orderstatus = 'F')
                - count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS residual
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1, 2, 3""")
def daily_residual_rollup(spark, folder):
    coded = panel_view(spark, folder).withColumn(
        "CountryCode", F.concat(F.lit("C"), F.substring_index("Country", "_", -1))
    )
    return panel.residual_rollup(coded, ["Country", "CountryCode"], "Confirmed", ["Deaths", "Recovered"], "residual")


@query("max_known_date", """
    SELECT max(CAST(o_orderdate AS DATE)) AS last_day, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders""")
def max_known_date(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").agg(F.max(day).alias("last_day"), F.min(day).alias("first_day"))


@query("gap_days", """
    SELECT date_diff('day', (SELECT max(CAST(o_orderdate AS DATE)) FROM orders),
                     (SELECT max(CAST(ts AS DATE)) FROM events)) AS days""")
def gap_days(spark, folder):
    later = table(spark, folder, "events").select(F.col("ts").cast("date").alias("Date"))
    earlier = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("Date"))
    return panel.days_between(later, earlier).select(F.col("days").cast("bigint").alias("days"))


# --- windows -----------------------------------------------------------------------


@query("cumulate", with_views("cum_panel", "SELECT * FROM cum_panel"))
def cumulate(spark, folder):
    return cum_panel(spark, folder)


_DIFFERENCES = """
    SELECT a."Country", a."Province", a."Date",
           {c} AS "Confirmed", {d} AS "Deaths", {r} AS "Recovered"
    FROM cum_panel a LEFT JOIN cum_panel b
      ON a."Country" IS NOT DISTINCT FROM b."Country" AND a."Province" IS NOT DISTINCT FROM b."Province"
     AND a."Date" IS NOT DISTINCT FROM CAST(b."Date" + INTERVAL 1 DAY AS DATE)"""


@query("decumulate", with_views("cum_panel", _DIFFERENCES.format(
    c='a."Confirmed" - b."Confirmed"', d='a."Deaths" - b."Deaths"', r='a."Recovered" - b."Recovered"')))
def decumulate(spark, folder):
    return panel.decumulate(cum_panel(spark, folder), PANEL_KEYS, PANEL_METRICS)


@query("decumulate_filled", with_views("cum_panel", _DIFFERENCES.format(
    c='coalesce(a."Confirmed" - b."Confirmed", 0)', d='coalesce(a."Deaths" - b."Deaths", 0)',
    r='coalesce(a."Recovered" - b."Recovered", 0)')))
def decumulate_filled(spark, folder):
    return panel.decumulate(cum_panel(spark, folder), PANEL_KEYS, PANEL_METRICS, fill=0)


def _lag_sql(horizon: int, view: str, keys: list[str], metric: str) -> str:
    by = ", ".join(f'"{k}"' for k in keys)
    cols = ", ".join(
        f'max("{metric}") OVER (PARTITION BY {by} ORDER BY "Date" RANGE BETWEEN INTERVAL {h} DAYS PRECEDING '
        f'AND INTERVAL {h} DAYS PRECEDING) AS "{metric}_{h}"'
        for h in range(1, horizon + 1)
    )
    return with_views(view, f"SELECT *, {cols} FROM {view}")


_LAG_3 = with_views("panel", """
    SELECT *, max("Confirmed") OVER (PARTITION BY "Country", "Province" ORDER BY "Date"
        RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 3 DAYS PRECEDING) AS "Confirmed_3" FROM panel""")


@query("lag_join", _LAG_3)
def lag_join(spark, folder):
    return lags.lag_join(panel_view(spark, folder), PANEL_KEYS, "Confirmed", 3)


@query("lag_window", _LAG_3)
def lag_window(spark, folder):
    return panel_view(spark, folder).withColumn("Confirmed_3", panel.calendar_lag("Confirmed", 3, PANEL_KEYS))


@query("lag_features", _lag_sql(7, "panel", PANEL_KEYS, "Confirmed"))
def lag_features(spark, folder):
    return lags.lag_features(panel_view(spark, folder), PANEL_KEYS, "Confirmed", 7)


@query("lag_features_15", _lag_sql(15, "country_panel", ["Country"], "Confirmed"))
def lag_features_15(spark, folder):
    return lags.lag_features(country_panel(spark, folder), ["Country"], "Confirmed", 15)


@query("lag_features_20", _lag_sql(20, "events_daily", ["event_type"], "n"))
def lag_features_20(spark, folder):
    return lags.lag_features(events_daily(spark, folder), ["event_type"], "n", 20)


@query("lag_features_40", _lag_sql(40, "country_panel", ["Country"], "Deaths"))
def lag_features_40(spark, folder):
    return lags.lag_features(country_panel(spark, folder), ["Country"], "Deaths", 40)


@query("lag_features_by_join", _lag_sql(3, "panel", PANEL_KEYS, "Confirmed"))
def lag_features_by_join(spark, folder):
    return lags.lag_features_by_join(panel_view(spark, folder), PANEL_KEYS, "Confirmed", 3)


# --- projections, fills, filters -----------------------------------------------------


@query("prefix_rename", """
    SELECT o_orderkey AS "N_o_orderkey", o_custkey AS "N_o_custkey", o_orderstatus AS "N_o_orderstatus",
           o_totalprice AS "N_o_totalprice", o_orderdate AS "N_o_orderdate", o_orderpriority AS "N_o_orderpriority"
    FROM orders""")
def prefix_rename(spark, folder):
    return columns.prefix_columns(table(spark, folder, "orders"))


@query("select_by_prefix", """
    SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem""")
def select_by_prefix(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
                                                    F.col("l_tax").alias("x_tax"))
    return columns.select_by_prefix(columns.drop_by_prefix(lines, "x_"), "l_")


@query("cast_metrics", """
    SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rank,
           TRY_CAST(o_orderstatus AS BIGINT) AS status FROM orders""")
def cast_metrics(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("rank"), F.col("o_orderstatus").alias("status")
    )
    return columns.cast_metrics(rows, ["rank", "status"])


@query("fill_numeric", with_views("cum_panel", _DIFFERENCES.format(
    c='coalesce(a."Confirmed" - b."Confirmed", 0)', d='coalesce(a."Deaths" - b."Deaths", 0)',
    r='coalesce(a."Recovered" - b."Recovered", 0)')))
def fill_numeric(spark, folder):
    return columns.fill_numeric(panel.decumulate(cum_panel(spark, folder), PANEL_KEYS, PANEL_METRICS))


@query("fill_subset", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'RAS' ELSE c_mktsegment END AS "Province",
           CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""")
def fill_subset(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("Province"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    return columns.fill_subset(rows, {"Province": columns.MISSING_PROVINCE})


@query("array_head_or_default", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'RAS' END AS "Province" FROM orders""")
def array_head_or_default(spark, folder):
    status = F.col("o_orderstatus")
    array = (
        F.when(status == "F", F.array("o_orderpriority", F.lit("other")))
        .when(status == "O", F.array().cast("array<string>"))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", columns.head_or_default(array).alias("Province")
    )


@query("filter_recent", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date" FROM orders
    WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 30""")
def filter_recent(spark, folder):
    recent = columns.filter_recent(table(spark, folder, "orders"), 30, "o_orderdate")
    return recent.select("o_orderkey", F.col("o_orderdate").cast("date").alias("Date"))


@query("filter_on_date", with_views("panel", """
    SELECT * FROM panel WHERE "Date" IS NOT DISTINCT FROM (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"""))
def filter_on_date(spark, folder):
    last = columns.max_date(table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("Date")))
    return columns.filter_on_date(panel_view(spark, folder), last)


@query("filter_after_max", """
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS "Date" FROM lineitem
    WHERE CAST(l_shipdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)""")
def filter_after_max(spark, folder):
    shipped = table(spark, folder, "lineitem").withColumnRenamed("l_shipdate", "stamp")
    ordered = table(spark, folder, "orders").withColumnRenamed("o_orderdate", "stamp")
    late = columns.filter_after(shipped, ordered, "stamp")
    return late.select("l_orderkey", "l_linenumber", F.col("stamp").cast("date").alias("Date"))


@query("filter_isin", with_views("panel", """
    SELECT * FROM panel WHERE "Country" IN ('NATION_3', 'NATION_7', 'NATION_11')"""))
def filter_isin(spark, folder):
    return panel_view(spark, folder).where(F.col("Country").isin("NATION_3", "NATION_7", "NATION_11"))


# The label spellings that differ between the two sources, and the one used.
COUNTRY_SPELLINGS = {
    "United States of America": "US",
    "Côte d'Ivoire": "Cote d'Ivoire",
    "Cape Verde": "Cabo Verde",
    "Lao PDR": "Laos",
    "Russian Federation": "Russia",
    "Holy See (Vatican City State)": "Holy See",
    "Iran, Islamic Republic of": "Iran",
    "Brunei Darussalam": "Brunei",
    "Saint Vincent and Grenadines": "Saint Vincent and the Grenadines",
    "Republic of Kosovo": "Kosovo",
    "Myanmar": "Burma",
    "Czech Republic": "Czechia",
    "Tanzania, United Republic of": "Tanzania",
    "Viet Nam": "Vietnam",
    "Venezuela (Bolivarian Republic)": "Venezuela",
    "Korea (South)": "Korea, South",
    "Macedonia, Republic of": "North Macedonia",
    "Swaziland": "Eswatini",
    "Syrian Arab Republic (Syria)": "Syria",
    "Taiwan, Republic of China": "Taiwan*",
}
_SPELLED = list(COUNTRY_SPELLINGS)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("harmonise_labels", f"""
    SELECT c_custkey,
           CASE {" ".join(f"WHEN c_nationkey = {i} THEN {_sql_text(COUNTRY_SPELLINGS[s])}" for i, s in enumerate(_SPELLED))}
                ELSE 'NATION_' || c_nationkey END AS "Country"
    FROM customer""")
def harmonise_labels(spark, folder):
    # Give the nation keys 0..19 the published spellings, then harmonise them.
    key = F.col("c_nationkey")
    spelled = F.get(F.array(*[F.lit(s) for s in _SPELLED]), key)
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.coalesce(spelled, F.concat(F.lit("NATION_"), key)).alias("Country")
    )
    return joins.harmonise(rows, "Country", COUNTRY_SPELLINGS)


@query("mask_after_cutoff", with_views("events_daily", """
    SELECT event_type, "Date", CASE WHEN "Date" > DATE '2024-01-20' THEN 0 ELSE n END AS n,
           CASE WHEN "Date" >= DATE '2024-01-10' THEN 0 ELSE cents END AS cents FROM events_daily"""))
def mask_after_cutoff(spark, folder):
    daily = events_daily(spark, folder)
    masked = columns.mask_after(daily, "n", F.lit("2024-01-20").cast("date"))
    return columns.mask_after(masked, "cents", F.lit("2024-01-10").cast("date"), inclusive=True)


@query("composite_id", """
    SELECT event_id, user_id || '_' || strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS _id FROM events""")
def composite_id(spark, folder):
    stamp = F.date_format("ts", dates.API_PATTERN)
    return table(spark, folder, "events").select(
        "event_id", columns.record_id(F.col("user_id").cast("string"), stamp).alias("_id")
    )


@query("geo_point", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey || ',' || s_nationkey END AS "Location"
    FROM supplier""")
def geo_point(spark, folder):
    lat = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", columns.geo_point(lat, F.col("s_nationkey")).alias("Location")
    )


@query("unpivot_metrics", with_views("panel", """
    SELECT "Country", "Province", "Date", 'Confirmed' AS metric, "Confirmed" AS value FROM panel
    UNION ALL SELECT "Country", "Province", "Date", 'Deaths', "Deaths" FROM panel
    UNION ALL SELECT "Country", "Province", "Date", 'Recovered', "Recovered" FROM panel"""))
def unpivot_metrics(spark, folder):
    return columns.unpivot_metrics(panel_view(spark, folder), [*PANEL_KEYS, "Date"], PANEL_METRICS)


# --- joins ---------------------------------------------------------------------------


@query("null_safe_join", with_views("panel", """
    WITH keyed AS (SELECT CASE WHEN "Country" = 'NATION_0' THEN NULL ELSE "Country" END AS "Country",
                   "Province", "Date", "Confirmed", "Deaths" FROM panel)
    SELECT a."Country", a."Province", a."Date", a."Confirmed", b."Deaths"
    FROM keyed a JOIN keyed b ON a."Country" IS NOT DISTINCT FROM b."Country"
     AND a."Province" IS NOT DISTINCT FROM b."Province" AND a."Date" IS NOT DISTINCT FROM b."Date" """))
def null_safe_join(spark, folder):
    keyed = panel_view(spark, folder).withColumn("Country", F.nullif("Country", F.lit("NATION_0")))
    keys = [*PANEL_KEYS, "Date"]
    return joins.null_safe_join(keyed.select(*keys, "Confirmed"), keyed.select(*keys, "Deaths"), keys)


def _supplier_dictionary(spark, folder):
    """A dictionary from another table: it lacks the countries without a supplier of a large balance."""
    nation = table(spark, folder, "nation")
    rows = table(spark, folder, "supplier").where("s_acctbal > 5000").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("Country"))
    return joins.fit_dictionary(rows, "Country", "CountryIndex")


@query("dict_encode", with_views("panel supplier_dictionary", """
    SELECT "Country", "Province", "Date", "Confirmed", "CountryIndex"
    FROM panel JOIN supplier_dictionary USING ("Country")"""))
def dict_encode(spark, folder):
    # Rows of countries that the suppliers' dictionary does not know are left out.
    encoded = joins.encode(panel_view(spark, folder), _supplier_dictionary(spark, folder), ["Country"])
    return encoded.select("Country", "Province", "Date", "Confirmed", "CountryIndex")


@query("dict_decode", with_views("panel dictionary supplier_dictionary", """
    SELECT "Province", "Date", "Confirmed", d."CountryIndex", s."Country"
    FROM panel p JOIN dictionary d ON p."Country" = d."Country"
    LEFT JOIN supplier_dictionary s ON d."CountryIndex" = s."CountryIndex" """))
def dict_decode(spark, folder):
    # Encoded by the orders' dictionary, decoded by the suppliers': unknown indexes keep a null label.
    dictionary = joins.fit_dictionary(country_counts(spark, folder), "Country", "CountryIndex", F.col("n"))
    encoded = joins.encode(panel_view(spark, folder), dictionary, ["Country"]).drop("Country", "Deaths", "Recovered")
    return joins.decode(encoded, _supplier_dictionary(spark, folder), ["CountryIndex"], null_safe=True)


@query("string_index", with_views("dictionary", """
    SELECT "Country", "CountryIndex" FROM dictionary"""))
def string_index(spark, folder):
    return joins.fit_dictionary(country_counts(spark, folder), "Country", "CountryIndex", F.col("n"))


@query("restrict_to_requested", with_views("panel", """
    SELECT * FROM panel p WHERE EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name = p."Country" AND s_acctbal > 9000)"""))
def restrict_to_requested(spark, folder):
    nation = table(spark, folder, "nation")
    request = (
        table(spark, folder, "supplier").where("s_acctbal > 9000")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("Country"))
    )
    return joins.restrict_to_requested(panel_view(spark, folder), request, ["Country"])


@query("join_targets", with_views("panel", """
    SELECT "Country", "Province", "Date", "Confirmed", "Deaths", "Recovered" FROM panel"""))
def join_targets(spark, folder):
    metrics = ["Confirmed", "Deaths", "Recovered"]
    long = columns.unpivot_metrics(panel_view(spark, folder), [*PANEL_KEYS, "Date"], metrics)
    return joins.join_targets(long, [*PANEL_KEYS, "Date"], metrics)


# --- order, limits, unions -------------------------------------------------------------


@query("latest_row_per_key", """
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS "Date", o_orderstatus FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
    WHERE r = 1""")
def latest_row_per_key(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("Date"), "o_orderstatus"
    )
    return columns.latest_per_key(rows, ["o_custkey"], ["Date", "o_orderkey"])


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return columns.top_n(rows, 20, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("tail_n", with_views("events_daily", """
    SELECT * FROM events_daily ORDER BY "Date" DESC, event_type DESC LIMIT 20"""))
def tail_n(spark, folder):
    return columns.top_n(events_daily(spark, folder), 20, F.col("Date").desc(), F.col("event_type").desc())


@query("union_positional", """
    SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")
def union_positional(spark, folder):
    customer = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"),
                                                       F.col("c_acctbal").alias("acctbal"))
    supplier = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"),
                                                       F.col("s_acctbal").alias("acctbal"))
    return calendar.union_positional(customer, supplier)


@query("union_by_name", """
    SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")
def union_by_name(spark, folder):
    customer = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"),
                                                       F.col("c_acctbal").alias("acctbal"))
    supplier = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("acctbal"),
                                                       F.col("s_nationkey").alias("nationkey"))
    return calendar.union_by_name(customer, supplier)


@query("union_distinct", """
    SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct(spark, folder):
    customer = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    supplier = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return calendar.union_by_name(customer, supplier).distinct()


@query("future_shift_union", with_views("country_panel", """
    SELECT * FROM country_panel
    UNION ALL
    SELECT "Country", "Date" + 30, "Confirmed", "Deaths", "Recovered" FROM country_panel
    WHERE "Date" >= (SELECT max("Date") FROM country_panel) - 30"""))
def future_shift_union(spark, folder):
    return calendar.future_by_shift(materialise(country_panel(spark, folder), "daily"), 30)


@query("future_calendar", with_views("country_panel", """
    SELECT "Country", CAST(unnest(generate_series(CAST(min("Date") AS TIMESTAMP),
           CAST(max("Date") + 30 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS "Date"
    FROM country_panel GROUP BY "Country" """))
def future_calendar(spark, folder):
    return calendar.extend_calendar(country_panel(spark, folder), ["Country"], 30)


# --- date features -----------------------------------------------------------------------


@query("date_shift", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS plus_week, CAST(o_orderdate AS DATE) - 40 AS minus_40
    FROM orders""")
def date_shift(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.date_add(day, 7).alias("plus_week"), F.date_sub(day, 40).alias("minus_40")
    )


@query("date_int_feature", """
    SELECT o_orderkey, round(day(o_orderdate) / CAST(1.3 AS DOUBLE) + 30 * month(o_orderdate), 6) AS "DateInt"
    FROM orders""")
def date_int_feature(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.round(dates.month_scaled_day(F.col("o_orderdate")), 6).alias("DateInt")
    )


@query("date_ordinal_feature", """
    SELECT o_orderkey, CAST(dayofyear(o_orderdate) + 365 * year(o_orderdate) AS INTEGER) AS "DateInt" FROM orders""")
def date_ordinal_feature(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.ordinal_day(F.col("o_orderdate")).alias("DateInt")
    )


@query("format_dates", """
    SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M:%S') AS "Date" FROM events""")
def format_dates(spark, folder):
    return table(spark, folder, "events").select("event_id", dates.format_document_date(F.col("ts")).alias("Date"))


@query("parse_api_dates", """
    SELECT event_id, date_trunc('second', ts) AS parsed FROM events""")
def parse_api_dates(spark, folder):
    sent = F.date_format("ts", dates.API_PATTERN)
    return table(spark, folder, "events").select(
        "event_id", dates.parse_timestamp(sent, dates.API_PATTERN).alias("parsed")
    )


@query("parse_custom_dates", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date", o_orderdate AS stamp,
           CAST(NULL AS DATE) AS misfit FROM orders""")
def parse_custom_dates(spark, folder):
    day = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        dates.parse_date(F.date_format(day, "yyyy-MM-dd"), "yyyy-MM-dd").alias("Date"),
        dates.parse_timestamp(F.date_format(day, dates.DOCUMENT_PATTERN), dates.DOCUMENT_PATTERN).alias("stamp"),
        dates.parse_date(F.date_format(day, "dd/MM/yyyy"), "yyyy-MM-dd").alias("misfit"),
    )


@query("round_predictions", """
    SELECT c_custkey, CAST(floor((c_acctbal - 500) + 0.5) AS BIGINT) AS rounded FROM customer""")
def round_predictions(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", columns.round_half_up(F.col("c_acctbal") - 500).alias("rounded")
    )


# --- flagship ----------------------------------------------------------------------------


@query("daily_new_cases", with_views("cum_panel", """
    WITH daily AS (
        SELECT a."Country", a."Province", a."Date", coalesce(a."Confirmed" - b."Confirmed", 0) AS new
        FROM cum_panel a LEFT JOIN cum_panel b ON a."Country" = b."Country" AND a."Province" = b."Province"
         AND a."Date" = CAST(b."Date" + INTERVAL 1 DAY AS DATE))
    SELECT *, """ + ", ".join(
        f"""coalesce(max(new) OVER (PARTITION BY "Country", "Province" ORDER BY "Date"
            RANGE BETWEEN INTERVAL {h} DAYS PRECEDING AND INTERVAL {h} DAYS PRECEDING), 0) AS new_{h}"""
        for h in range(1, 8)) + """,
        CAST(sum(new) OVER (PARTITION BY "Country", "Province" ORDER BY "Date") AS BIGINT) AS running
    FROM daily"""))
def daily_new_cases(spark, folder):
    """Published totals to daily new cases with seven lags and a running total."""
    totals = cum_panel(spark, folder).select(*PANEL_KEYS, "Date", F.col("Confirmed").alias("new"))
    daily = panel.decumulate(totals, PANEL_KEYS, ["new"], fill=0)
    lagged = lags.lag_features(daily, PANEL_KEYS, "new", 7, fill=0)
    return panel.cumulate(lagged.withColumn("running", F.col("new")), PANEL_KEYS, ["running"])
