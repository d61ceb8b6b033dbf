"""CSV, bulk-load and document sinks, and the keyed upsert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.dates import format_document_date
from dayloom.operators.columns import latest_per_key
from dayloom.operators.sequence import number_rows
from dayloom.session import path_exists

PUSH_FILL = -1.0


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = False, sep: str = ",") -> None:
    df.write.mode(mode).option("header", header).option("sep", sep).csv(path)


def export_csv(df: DataFrame, path: str, by: Sequence[str], header: bool = False, files_per_value: int = 1) -> None:
    """A result as CSV in one folder per value of ``by``.

    Rows of a value go to ``files_per_value`` files, dealt by a hash of the whole row, so that
    a value of any size can be spread; no task holds more than its share and no row is refused.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_value))
    dealt = df.repartition(*[F.col(c) for c in by], spread)
    dealt.write.mode("overwrite").partitionBy(*by).option("header", header).csv(path)


# --- bulk-load lines -----------------------------------------------------------

def bulk_records(df: DataFrame, record_id: str, index: str, type_name: str = "_doc") -> DataFrame:
    """Per row an action line (index, type, id) and the document line, as one text value."""
    fields = [c for c in df.columns if c != record_id]
    action = F.concat(
        F.lit(f'{{"index":{{"_index":"{index}", "_type":"{type_name}", "_id": "'),
        F.col(record_id).cast("string"),
        F.lit('"}}\n'),
    )
    return df.select(F.concat(action, F.to_json(F.struct(*fields))).alias("value"))


def write_bulk(df: DataFrame, path: str, record_id: str, index: str, type_name: str = "_doc",
               records_per_file: int = 100_000, load: str | None = None) -> None:
    """Bulk-load files of at most ``records_per_file`` records (two lines each).

    With ``load`` the files stand in a sub-folder of that name. Only a repetition of
    the same load overwrites it; files of other loads stay.
    """
    lines = bulk_records(df, record_id, index, type_name)
    target = f"{path}/load={load}" if load else path
    lines.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).text(target)


def bulk_ids(spark: SparkSession, path: str, loads: Sequence[str], record_id: str = "_id") -> DataFrame:
    """Ids of the records in the bulk files of some loads, read from their action lines."""
    there = [p for p in (f"{path}/load={n}" for n in loads) if path_exists(spark, p)]
    if not there:
        return spark.createDataFrame([], f"{record_id} string")
    found = F.regexp_extract("value", r'^\{"index":\{"_index":".*", "_type":".*", "_id": "(.*)"\}\}$', 1)
    return spark.read.text(there).select(found.alias(record_id)).where(F.col(record_id) != "")


def nest_json(df: DataFrame, record_id: str, columns: Sequence[str], order: Sequence[str] | None = None,
              root: str = "data", max_rows: int = 10_000, unique_order: bool = False) -> DataFrame:
    """One JSON document per id: an object for one row, an array for several.

    Without ``order`` the ids are taken as unique and nothing is shuffled. With it,
    the rows of an id are numbered in that order and nested in parts of at most
    ``max_rows``, so that no task holds more than that of a hot id; every row is
    in exactly one part. Output: id, ``part`` (from 0), ``json``.
    """
    document = F.to_json(F.struct(*columns))
    if order is None:
        json = F.concat(F.lit(f'{{"{root}":'), document, F.lit("}"))
        return df.select(record_id, F.lit(0).cast("bigint").alias("part"), json.alias("json"))
    rows = df.select(record_id, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], document.alias("_doc"))
    numbered = number_rows(rows, "_n", [F.col(f"_o{i}") for i in range(len(order))], [record_id],
                           unique_order=unique_order)
    part = F.floor(F.col("_n") / max_rows).cast("bigint").alias("part")
    listed = F.sort_array(F.collect_list(F.struct("_n", "_doc")))
    joined = F.array_join(F.transform(listed, lambda r: r["_doc"]), ",")
    many = F.concat(F.lit("["), joined, F.lit("]"))
    body = F.when(F.count(F.lit(1)) == 1, F.max("_doc")).otherwise(many)
    return numbered.groupBy(record_id, part).agg(
        F.concat(F.lit(f'{{"{root}":'), body, F.lit("}")).alias("json")
    )


# --- document stores -------------------------------------------------------------

def forecast_documents(df: DataFrame, date: str = "Date", constants: Mapping[str, object] | None = None) -> DataFrame:
    """Rows ready for a document store: formatted date and constant fields."""
    out = df.withColumn(date, format_document_date(F.col(date)))
    return out.withColumns({c: F.lit(v) for c, v in (constants or {}).items()})


def write_documents(df: DataFrame, target: str | None, format: str = "json",
                    options: Mapping[str, str] | None = None) -> None:
    """Append documents to any sink by format name, nulls written out."""
    settings = {"ignoreNullFields": "false", **(options or {})}
    writer = df.write.mode("append").format(format).options(**settings)
    writer.save(target) if target else writer.save()


def push_payload(df: DataFrame, columns: Sequence[str], date: str = "ds", record_id: str | None = "_id",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Project, cast the measures to float, fill with -1 and add an id.

    The id is a hash of the row's date and ``keys`` (its whole key), so that a repeated task or push gives the same
    one and rows of several series on a day have ids of their own. Keys need not be among ``columns``.
    """
    measures = [c for c in columns if c != date and c not in keys]
    whole = F.col(date).cast("string")
    if keys:
        whole = F.to_json(F.array(*[F.col(k).cast("string") for k in keys], whole), {"ignoreNullFields": "false"})
    made = [F.md5(whole).alias(record_id)] if record_id else []
    out = df.select(*[F.col(c).cast("float").alias(c) if c in measures else F.col(c) for c in columns], *made)
    return out.na.fill(PUSH_FILL, subset=measures)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Both tables with one row per key: the greatest version wins, new before old on a tie.

    Taken as an aggregate with partial maxima, so repeated writes of one id are
    reduced before the shuffle.
    """
    both = old.withColumn("_is_new", F.lit(0)).unionByName(new.withColumn("_is_new", F.lit(1)))
    return latest_per_key(both, keys, [*version, "_is_new"]).select(*old.columns)
