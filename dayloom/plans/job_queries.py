"""The end-to-end jobs as checked queries, on inputs of the documented shapes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.operators import calendar, joins, panel
from dayloom.plans import pipelines
from dayloom.plans.catalogue import query
from dayloom.plans.forecast_queries import _state_sql
from dayloom.plans.views import PANEL_METRICS, cum_panel, with_views
from dayloom.plans.views import panel as panel_view
from dayloom.schemas import API_RECORD_LONG, DAILY_PANEL, ENCODED_PANEL, STORED_DOCUMENT
from dayloom.session import materialise, scratch_path
from dayloom.sources import documents, sinks, tables

_NEW = ", ".join(f'a."{m}" - b."{m}" AS "{m}"' for m in PANEL_METRICS)
_DAY_FEATURE = """round(day(a."Date") / CAST(1.3 AS DOUBLE) + 30 * month(a."Date"), 6) AS "DateInt" """


@query("build_panel", with_views("cum_panel", f"""
    WITH named AS (SELECT "Country", CASE WHEN "Province" = 'BUILDING' THEN 'RAS' ELSE "Province" END AS "Province",
                          "Date", "Confirmed", "Deaths", "Recovered" FROM cum_panel)
    SELECT a."Country", a."Province", a."Date", {_DAY_FEATURE}, {_NEW}
    FROM named a LEFT JOIN named b ON a."Country" = b."Country" AND a."Province" = b."Province"
     AND b."Date" = a."Date" - 1"""))
def build_panel(spark, folder):
    # Cumulative documents in a store -> daily new counts with the day feature -> the headerless panel file.
    stored, out = scratch_path(spark, "documents"), scratch_path(spark, "panel")
    province = F.when(F.col("Province") == "BUILDING", F.array().cast("array<string>")).otherwise(F.array("Province"))
    rows = cum_panel(spark, folder).withColumn("Province", province)
    sinks.write_documents(sinks.forecast_documents(rows), stored)
    read = documents.read_documents(spark, stored, STORED_DOCUMENT, ["Country", "Province", "Date", *PANEL_METRICS],
                                    array_fields=["Province"])
    sinks.write_csv(pipelines.build_panel(read), out)
    names = ["Country", "Province", "Date", "DateInt", *PANEL_METRICS]
    return tables.read_headerless_csv(spark, out, names, DAILY_PANEL).withColumn("DateInt", F.round("DateInt", 6))


@query("long_record_panel", with_views("cum_panel", f"""
    SELECT a."Country", a."Province", a."Date", {_DAY_FEATURE}, {_NEW}
    FROM cum_panel a LEFT JOIN cum_panel b ON a."Country" = b."Country" AND a."Province" = b."Province"
     AND b."Date" = a."Date" - 1"""))
def long_record_panel(spark, folder):
    # The older record shape (cases and status) landed as files -> three cumulative columns -> daily counts.
    landed = scratch_path(spark, "long")
    names = dict(zip(PANEL_METRICS, ("confirmed", "deaths", "recovered")))
    wide = cum_panel(spark, folder)
    long = wide.unpivot(["Country", "Province", "Date"], PANEL_METRICS, "Status", "Cases").withColumns({
        "Status": F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("Status")),
        "Cases": F.col("Cases").cast("double"), "Date": F.concat(F.col("Date").cast("string"), F.lit("T00:00:00Z")),
        "Lat": F.lit(1.5), "Lon": F.lit(None).cast("double")})
    sinks.write_documents(long, landed)
    records = spark.read.schema(API_RECORD_LONG).json(landed)
    day = dates.parse_timestamp(F.col("Date"), dates.API_PATTERN).cast("date")
    keys = ["Country", "Province"]
    rows = panel.status_pivot(records.withColumn("Date", day), [*keys, "Date"], {v: k for k, v in names.items()})
    rows = rows.withColumns({m: F.col(m).cast("bigint") for m in PANEL_METRICS})
    daily = panel.decumulate(rows, keys, PANEL_METRICS)
    return daily.select(*keys, "Date", F.round(dates.month_scaled_day(F.col("Date")), 6).alias("DateInt"), *PANEL_METRICS)


# --- contest tables ------------------------------------------------------------------------------

_CONTEST_DAILY = """
    named AS (SELECT "Country" AS c, CASE WHEN "Province" = 'BUILDING' THEN 'RAS' ELSE "Province" END AS p, "Date" AS d,
                     "Confirmed" AS n, "Deaths" AS f FROM cum_panel),
    daily AS (SELECT a.c, a.p, a.d, CAST(coalesce(a.n - b.n, 0) AS DOUBLE) AS n, CAST(coalesce(a.f - b.f, 0) AS DOUBLE) AS f
              FROM named a LEFT JOIN named b ON a.c = b.c AND a.p = b.p AND b.d = a.d - 1)"""


def _training(spark, folder):
    """The cumulative contest table: a province that is not known is null."""
    return cum_panel(spark, folder).select(
        F.nullif("Province", F.lit("BUILDING")).alias("Province_State"), F.col("Country").alias("Country_Region"), "Date",
        F.col("Confirmed").cast("double").alias("ConfirmedCases"), F.col("Deaths").cast("double").alias("Fatalities"))


@query("contest_panel", with_views("cum_panel", f"""
    WITH {_CONTEST_DAILY}
    SELECT c AS "Country_Region", p AS "Province_State", d AS "Date", n AS "ConfirmedCases", f AS "Fatalities" FROM daily"""))
def contest_panel(spark, folder):
    return pipelines.contest_panel(_training(spark, folder))


def _pair_dictionary(daily):
    """Index of countries and of provinces for every pair that occurs."""
    pairs = daily.select(*pipelines.ENTITY).distinct()
    for label in pipelines.ENTITY:
        index = joins.fit_dictionary(daily, label, f"{label}Index")
        pairs = pairs.join(index.withColumn(f"{label}Index", F.col(f"{label}Index").cast("double")), label)
    return materialise(pairs, "pairs")


_KEYED = f"""{_CONTEST_DAILY},
    keyed AS (SELECT c || '|' || p || '|n' AS k, d AS "Date", n FROM daily UNION ALL SELECT c || '|' || p || '|f', d, f FROM daily),
    {_state_sql("n", 7, "keyed", "k")},
    roll AS (SELECT k, last, 0 AS step, state FROM start
             UNION ALL SELECT k, last, step + 1, list_prepend(list_sum(state[1:7]) / 7.0, state)[1:7] FROM roll WHERE step < 5),
    parts AS (SELECT k, "Date", n FROM seen WHERE "Date" >= last - 7
              UNION ALL SELECT k, last + step, state[1] FROM roll WHERE step > 0),
    totals AS (SELECT k, "Date", sum(n) OVER (PARTITION BY k ORDER BY "Date") AS n FROM parts),
    wide AS (SELECT a.k, a."Date", a.n, b.n AS f FROM totals a JOIN totals b
             ON b.k = left(a.k, length(a.k) - 1) || 'f' AND a."Date" = b."Date" WHERE right(a.k, 1) = 'n'),
    request AS (SELECT c, p, CAST(unnest(generate_series(CAST(max(d) - 3 AS TIMESTAMP), CAST(max(d) + 9 AS TIMESTAMP),
                INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY c, p)"""


@query("contest_submission", with_views("cum_panel", f"""
    WITH RECURSIVE {_KEYED}
    SELECT r.c || '|' || r.p || '|' || CAST(r.d AS VARCHAR) AS "ForecastId", round(n, 6) AS "ConfirmedCases",
           round(f, 6) AS "Fatalities"
    FROM request r LEFT JOIN wide w ON w.k = r.c || '|' || r.p || '|n' AND w."Date" = r.d"""))
def contest_submission(spark, folder):
    # Training table -> daily, encoded and stored as a file -> forecast of both targets -> request table.
    daily = materialise(pipelines.contest_panel(_training(spark, folder)), "contest-daily")
    dictionary, path = _pair_dictionary(daily), scratch_path(spark, "encoded")
    sinks.write_csv(joins.encode(daily, dictionary, pipelines.ENTITY).select(
        *pipelines.CODES, "Date", *pipelines.TARGETS), path)
    names = [*pipelines.CODES, "Date", *pipelines.TARGETS]
    encoded = tables.read_headerless_csv(spark, path, names, ENCODED_PANEL)
    asked = calendar.extend_calendar(daily, pipelines.ENTITY, 9)
    last = daily.groupBy(*pipelines.ENTITY).agg(F.max("Date").alias("_last"))
    asked = joins.null_safe_join(asked, last, pipelines.ENTITY).where("Date >= date_sub(_last, 3)")
    asked = asked.select(F.concat_ws("|", *pipelines.ENTITY, F.col("Date").cast("string")).alias("ForecastId"),
                         *[F.nullif(F.col(c), F.lit("RAS")).alias(c) if c == "Province_State" else c for c in pipelines.ENTITY],
                         "Date")
    filled = pipelines.contest_submission(encoded, dictionary, asked, horizon=7, periods=5)
    return filled.select("ForecastId", *[F.round(t, 6).alias(t) for t in pipelines.TARGETS])
