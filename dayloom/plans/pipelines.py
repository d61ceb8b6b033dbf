"""The jobs end to end: ingest, panel, training, prediction, contest tables, world forecast.

Every path, connector name and option comes from the caller.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dayloom.functions import dates
from dayloom.operators import calendar, columns, features, forecast, joins, lags, models, panel
from dayloom.session import delete_path, materialise
from dayloom.sources import documents, marks, sinks

COUNTERS = ["Confirmed", "Deaths", "Recovered"]
KEYS = ["Country", "Province"]
ENTITY = ["Country_Region", "Province_State"]
CODES = ["Country_RegionIndex", "Province_StateIndex"]
TARGETS = ["ConfirmedCases", "Fatalities"]


def map_records(records: DataFrame) -> DataFrame:
    """API records to stored documents: id, place, counters, formatted date and its timestamp."""
    parsed = dates.parse_timestamp(F.col("Date"), dates.API_PATTERN)
    return records.select(
        columns.record_id(F.col("LocationID"), F.col("Date")).alias("_id"),
        "Country", "CountryCode", "Province", "City", "CityCode",
        columns.geo_point(F.col("Lat"), F.col("Lon")).alias("Location"),
        *COUNTERS, "Active",
        dates.format_document_date(parsed).alias("Date"),
        parsed.alias("DateReal"),
    )


def ingest(
    spark: SparkSession, landed: str, mark_path: str, bulk_path: str, index: str,
    default: dt.datetime = marks.DEFAULT_MARK, records_per_file: int = 100_000, allowed_lateness: str | None = None,
) -> dict:
    """Landed JSON payloads past the mark to bulk-load files, then advance the mark.

    Every load writes a sub-folder of its own, named by its number in the journal at ``mark_path``; one that finds nothing
    fresh leaves none. ``allowed_lateness`` looks back behind the mark for records whose ids no finished load has
    written. The result also counts what is no record (``corrupt``), in the pass that writes.
    """
    parsed = documents.parse_json_array_files(spark, landed)
    seen = Observation()
    parsed = parsed.observe(seen, F.count("_corrupt").alias("corrupt")).where("_corrupt is null")
    loaded = sinks.bulk_ids(spark, bulk_path, marks.finished(spark, mark_path)) if allowed_lateness else None
    counts = marks.incremental_load(
        map_records(parsed), "DateReal", mark_path,
        lambda fresh, load: sinks.write_bulk(fresh.drop("DateReal"), bulk_path, "_id", index,
                                             records_per_file=records_per_file, load=load),
        default, allowed_lateness, loaded, ["_id"], inputs=landed,
    )
    if not counts["accepted"]:
        delete_path(spark, f"{bulk_path}/load={counts['load']}")
    return {**counts, "corrupt": seen.get["corrupt"]}


def build_panel(stored: DataFrame, as_text_date: str | None = dates.DOCUMENT_PATTERN, fill: float | None = None
                ) -> DataFrame:
    """Stored documents (province as an array) to daily new counts with the day feature."""
    day = dates.parse_date(F.col("Date"), as_text_date) if as_text_date else F.col("Date").cast("date")
    rows = stored.select("Country", columns.head_or_default(F.col("Province")).alias("Province"),
                         day.alias("Date"), *COUNTERS)
    daily = panel.decumulate(panel.sum_panel(rows, KEYS, COUNTERS), KEYS, COUNTERS, fill=fill)
    return daily.withColumn("DateInt", dates.month_scaled_day(F.col("Date"))).select(
        *KEYS, "Date", "DateInt", *COUNTERS
    )


def train_on_lags(
    daily: DataFrame, keys: Sequence[str], codes: Sequence[str], metric: str, horizon: int,
    estimator=None, grid: Mapping[str, Iterable] | None = None, path: str | None = None, folds: int = 3,
    parallelism: int = 2, fold_col: str | None = None,
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated model of index + lag features, and its hold-out metrics."""
    lagged = lags.lag_features(columns.fill_numeric(daily), keys, metric, horizon, fill=0, check_unique=True)
    rows = features.assemble_lags(lagged, codes, metric, horizon)
    keep = [*keys, "Date", *([fold_col] if fold_col else []), "features", F.col(metric).cast("double").alias("label")]
    split = materialise(features.hash_split(rows.select(*keep), [*keys, "Date"]), "training")
    fitted = models.cross_validate(
        split.where("is_train"), estimator or models.gbt(), grid or models.GBT_GRID, folds, parallelism, fold_col
    )
    if path:
        models.save_model(fitted, path)
    return fitted, models.holdout_metrics(fitted, split.where("NOT is_train"))


def predict_countries(daily: DataFrame, dictionary: DataFrame, model: Model, horizon: int, periods: int,
                      round_feedback: bool = True) -> DataFrame:
    """In-sample scores of the whole panel and a recursive forecast, with labels.

    Known days carry their value and a score; future days a zero value and the forecast.
    """
    encoded = joins.encode(columns.fill_numeric(daily), dictionary, ["Country"])
    lagged = lags.lag_features(encoded, ["CountryIndex"], "Confirmed", horizon, fill=0)
    ready = features.assemble_lags(lagged, ["CountryIndex"], "Confirmed", horizon)
    features.check_feature_size(model, 1 + horizon)
    score = columns.round_half_up(F.col("prediction")).alias("Predicted_Confirmed")
    known = model.transform(ready).select("CountryIndex", "Date", F.col("Confirmed").cast("bigint").alias("Confirmed"), score)
    ahead = forecast.recursive_forecast(
        encoded, ["CountryIndex"], "Confirmed", horizon, periods, model, codes=["CountryIndex"],
        round_feedback=round_feedback,
    )
    future = ahead.select(
        "CountryIndex", "Date", F.lit(0).cast("bigint").alias("Confirmed"),
        columns.round_half_up(F.col("Confirmed")).alias("Predicted_Confirmed"),
    )
    both = known.unionByName(future)
    return joins.decode(both, dictionary, ["CountryIndex"], null_safe=True).select(
        "Country", "Date", "Confirmed", "Predicted_Confirmed"
    )


def predict_by_shift(daily: DataFrame, model: Model, index: DataFrame, days: int = 30) -> DataFrame:
    """Score the panel and its recent days moved ahead, by index and day feature."""
    frame = calendar.future_by_shift(daily, days)
    frame = frame.withColumn("DateInt", dates.month_scaled_day(F.col("Date")))
    ready = features.assemble(joins.encode(frame, index, ["Country"]), ["CountryIndex", "DateInt"])
    features.check_feature_size(model, 2)
    return model.transform(ready).withColumnRenamed("prediction", "Predicted_Confirmed").drop("features")


def contest_panel(training: DataFrame) -> DataFrame:
    """Cumulative training table to daily values; missing provinces and first days filled."""
    known = columns.fill_subset(columns.fill_subset(training, dict.fromkeys(TARGETS, 0.0)),
                                {"Province_State": columns.MISSING_PROVINCE})
    return panel.decumulate(known, ENTITY, TARGETS, fill=0.0).select(*ENTITY, "Date", *TARGETS)


def contest_input(
    training: DataFrame, newer: DataFrame, request: DataFrame, dictionary: DataFrame,
    spellings: Mapping[str, str], horizon: int = 40, scorers: Mapping[str, object] | None = None,
) -> DataFrame:
    """Training panel joined with a newer source, entities absent there forecast, encoded."""
    base = materialise(contest_panel(training), "contest")
    later = columns.filter_after(newer, base).select(*ENTITY, "Date", *TARGETS)
    later = columns.cast_metrics(joins.harmonise(later, "Country_Region", spellings), TARGETS, "double")
    asked = columns.fill_subset(request, {"Province_State": columns.MISSING_PROVINCE})
    fresh = joins.restrict_to_requested(later, asked, [*ENTITY, "Date"])

    def coded(df: DataFrame) -> DataFrame:
        return joins.encode(df, dictionary, ENTITY).select(*CODES, "Date", *TARGETS)

    known = materialise(coded(base), "contest-known")
    return forecast.backfill_missing(
        known, materialise(coded(fresh), "contest-fresh"), CODES, CODES, TARGETS, horizon, scorers=scorers, codes=CODES
    )


def contest_submission(
    encoded: DataFrame, dictionary: DataFrame, request: DataFrame, scorers: Mapping[str, object] | None = None,
    horizon: int = 40, periods: int = 30, history: str = "window",
) -> DataFrame:
    """Cumulated forecasts of every target, decoded and joined to the request table."""
    stored = materialise(encoded, "encoded")
    both = forecast.forecast_targets(
        stored, CODES, TARGETS, horizon, periods, scorers, codes=CODES, totals=history
    )
    decoded = joins.decode(both, dictionary, CODES).select(*ENTITY, "Date", *TARGETS)
    asked = columns.fill_subset(request, {"Province_State": columns.MISSING_PROVINCE})
    return joins.fill_request(asked, decoded, [*ENTITY, "Date"], TARGETS).select("ForecastId", *TARGETS)


def world_forecast(grouped: DataFrame, periods: int = 30,
                   forecaster: Callable = forecast.additive_forecast) -> DataFrame:
    """Grouped counters to the wide world forecast (ds, actuals, three bands)."""
    lower = {c: c.lower() for c in COUNTERS}
    world = panel.sum_panel(grouped, [], COUNTERS).withColumnsRenamed(lower)
    return forecast.forecast_table(world, list(lower.values()), periods, forecaster=forecaster)


def push_forecast(table: DataFrame, target: str | None, format: str = "json",
                  options: Mapping[str, str] | None = None, keys: Sequence[str] = ()) -> None:
    """Send a wide forecast table to a document sink, missing values as -1, ids generated from ``keys`` and date."""
    payload = sinks.push_payload(table, table.columns, keys=keys)
    sinks.write_documents(payload, target, format, options)
