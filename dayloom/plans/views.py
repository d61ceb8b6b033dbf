"""Canonical inputs derived from the given tables, as DataFrames and as SQL.

Each function has a SQL twin in ``SQL_VIEWS``; the catalogue's check queries are
written against those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.operators.panel import cumulate

PANEL_KEYS = ["Country", "Province"]
PANEL_METRICS = ["Confirmed", "Deaths", "Recovered"]
EVENT_KEYS = ["event_type"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nation and segment of the customer.

    The customer side is joined to the orders as they are: adaptive execution splits a hot
    customer's partition, and the sums that follow are partial before their own shuffle. Below the
    broadcast threshold the join does not shuffle at all.
    """
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("Province"))
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("Date"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _daily(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Counts by nation key, further keys and day; the country names join the finished sums."""
    status = F.col("o_orderstatus")
    sums = placed_orders(spark, folder).groupBy("c_nationkey", *keys, "Date").agg(
        F.count(F.lit(1)).alias("Confirmed"),
        F.count_if(status == "F").alias("Deaths"),
        F.count_if(status == "O").alias("Recovered"),
    )
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("Country"))
    named = sums.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("Country", *keys, "Date", *PANEL_METRICS)


def country_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per country (``n``), counted per customer before any join."""
    per_customer = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    placed = per_customer.join(places(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    return placed.groupBy("Country").agg(F.sum("n").alias("n"))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Country and province of every customer."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("Province"))
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("Country"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "Country", "Province")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily new counts per country and province, from orders."""
    return _daily(spark, folder, ["Province"])


def country_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder, [])


def cum_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals of the panel (the shape in which counters are published)."""
    return cumulate(panel(spark, folder), PANEL_KEYS, PANEL_METRICS)


def cents(value: Column) -> Column:
    return F.floor(value * 100 + F.lit(0.5)).cast("bigint")


def events_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their value in cents per type and day."""
    return (
        table(spark, folder, "events")
        .groupBy("event_type", F.col("ts").cast("date").alias("Date"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("value"))).alias("cents"))
    )


def raw_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One landed payload per panel row: a JSON array with the record in both published shapes."""
    row = panel(spark, folder)
    stamp = F.concat(F.col("Date").cast("string"), F.lit("T00:00:00Z"))
    country = [
        "Country",
        F.concat(F.lit("C"), F.substring_index("Country", "_", -1)).alias("CountryCode"),
        F.concat(F.substring_index("Country", "_", -1), F.lit(".5")).alias("Lat"),
        F.lit("").alias("Lon"),
        *PANEL_METRICS,
        (F.col("Confirmed") - F.col("Deaths") - F.col("Recovered")).alias("Active"),
        stamp.alias("Date"),
        F.md5(F.concat_ws("/", "Country", "Province")).alias("LocationID"),
    ]
    both = F.array(
        F.to_json(F.struct(*country)), F.to_json(F.struct(*country, F.col("Province").alias("Province")))
    )
    return row.select(F.concat(F.lit("["), F.array_join(both, ","), F.lit("]")).alias("payload"))


SQL_VIEWS = {
    "panel": """
        SELECT n_name AS "Country", c_mktsegment AS "Province", CAST(o_orderdate AS DATE) AS "Date",
               count(*) AS "Confirmed",
               count(*) FILTER (WHERE o_orderstatus = 'F') AS "Deaths",
               count(*) FILTER (WHERE o_orderstatus = 'O') AS "Recovered"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3""",
    "country_panel": """
        SELECT n_name AS "Country", CAST(o_orderdate AS DATE) AS "Date",
               count(*) AS "Confirmed",
               count(*) FILTER (WHERE o_orderstatus = 'F') AS "Deaths",
               count(*) FILTER (WHERE o_orderstatus = 'O') AS "Recovered"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "cum_panel": """
        SELECT "Country", "Province", "Date",
               CAST(sum("Confirmed") OVER w AS BIGINT) AS "Confirmed",
               CAST(sum("Deaths") OVER w AS BIGINT) AS "Deaths",
               CAST(sum("Recovered") OVER w AS BIGINT) AS "Recovered"
        FROM panel WINDOW w AS (PARTITION BY "Country", "Province" ORDER BY "Date")""",
    "events_daily": """
        SELECT event_type, CAST(ts AS DATE) AS "Date", count(*) AS n,
               CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
        FROM events GROUP BY 1, 2""",
    "dictionary": """
        SELECT n_name AS "Country", row_number() OVER (ORDER BY count(*) DESC, n_name) - 1 AS "CountryIndex"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    "supplier_dictionary": """
        SELECT n_name AS "Country", row_number() OVER (ORDER BY count(*) DESC, n_name) - 1 AS "CountryIndex"
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY n_name""",
}
_NEEDS = {"cum_panel": ["panel"]}


def with_views(names: str, body: str) -> str:
    """SQL of a check query with the named views in front."""
    ordered: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
    head, _, rest = body.strip().partition(" ")
    if head.upper() == "WITH":
        recursive = rest.lstrip().upper().startswith("RECURSIVE")
        tail = rest.lstrip()[len("RECURSIVE"):] if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}{views},\n{tail}"
    return f"WITH {views}\n{body}"
