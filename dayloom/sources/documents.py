"""JSON payloads and document stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.dates import parse_timestamp
from dayloom.schemas import API_RECORD
from dayloom.session import path_exists

FILE_FORMATS = {"json", "parquet", "orc", "csv", "text", "avro"}


def _struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def _typed(column: Column, to: T.DataType) -> Column:
    """Text of a JSON scalar as its type: empty or unparsable text gives null."""
    filled = F.nullif(column, F.lit(""))
    return filled if isinstance(to, T.StringType) else filled.try_cast(to)


def _as_array(column: Column) -> Column:
    """Text of a JSON array, or of a single value, as an array."""
    listed = F.from_json(column, "array<string>")
    return F.when(column.startswith("["), listed).when(column != "", F.array(column)).when(
        column == "", F.array().cast("array<string>")
    )


def parse_json_array(
    df: DataFrame, payload: str, schema: T.StructType | str = API_RECORD, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per element of the JSON array in ``payload``: ``keep``, one column per field, and ``_corrupt``.

    ``_corrupt`` is null for a record. An element that is no object (null, a number, a text, an array) is a row of
    its own with its text there and no fields; so is a payload that holds text but no whole JSON array (cut off, a lone
    object, text after the closing bracket). Null and blank payloads give no row.

    Fields are read as text and then cast, so numbers may arrive quoted; an absent field, an empty text and text
    of the wrong type give null.
    """
    fields = _struct(schema)
    text = F.regexp_replace(F.col(payload), r"^\s+|\s+$", "")
    listed = F.from_json(text, "array<string>")
    whole = text.startswith("[") & text.endswith("]") & listed.isNotNull()
    each = "array<struct<element:string,corrupt:string>>"
    elements = F.when(whole, F.transform(listed, lambda e: F.struct(
        F.when(e.startswith("{"), e).alias("element"),
        F.when(e.isNull(), F.lit("null")).when(~e.startswith("{"), e).alias("corrupt"))).cast(each))
    elements = elements.when(text != "", F.array(F.struct(
        F.lit(None).cast("string").alias("element"), F.col(payload).alias("corrupt"))).cast(each))
    rows = df.select(*keep, F.explode(elements).alias("_e"))
    record = F.from_json(F.col("_e.element"), _as_text(fields))
    rows = rows.select(*keep, record.alias("_record"), F.col("_e.corrupt").alias("_corrupt"))
    typed = [_typed(F.col("_record")[f.name], f.dataType).alias(f.name) for f in fields]
    return rows.select(*keep, *typed, "_corrupt")


def explode_json_array(
    df: DataFrame, payload: str, schema: T.StructType | str = API_RECORD, keep: Sequence[str] = ()
) -> DataFrame:
    """The records of ``parse_json_array``, without the rejects."""
    return parse_json_array(df, payload, schema, keep).where("_corrupt is null").drop("_corrupt")


def json_array_rejects(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """The rejects of ``parse_json_array``: ``keep`` and the text that is no record."""
    return parse_json_array(df, payload, "_none string", keep).where("_corrupt is not null").drop("_none")


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as one payload each: ``file``, ``payload``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def parse_json_array_files(spark: SparkSession, path: str, schema: T.StructType | str = API_RECORD) -> DataFrame:
    """``parse_json_array`` of landed files: ``file``, the fields and ``_corrupt``. A file is one task's work, 2 GB at most."""
    return parse_json_array(read_payload_files(spark, path), "payload", schema, ["file"])


def read_json_array_files(spark: SparkSession, path: str, schema: T.StructType | str = API_RECORD) -> DataFrame:
    """Landed payload files, each one JSON array, as typed rows; the rejects are left out."""
    return parse_json_array_files(spark, path, schema).where("_corrupt is null").drop("file", "_corrupt")


def extract_fields(df: DataFrame, payload: str, schema: T.StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """Fields of a JSON object column as typed columns."""
    fields = _struct(schema)
    record = F.from_json(F.col(payload), _as_text(fields))
    rows = df.select(*keep, record.alias("_record"))
    return rows.select(*keep, *[_typed(F.col("_record")[f.name], f.dataType).alias(f.name) for f in fields])


def read_documents(
    spark: SparkSession,
    source: str | None,
    schema: T.StructType | str,
    fields: Sequence[str] | None = None,
    format: str = "json",
    options: Mapping[str, str] | None = None,
    missing_as_empty: bool = True,
    empty_as_null: bool = True,
    date_patterns: Mapping[str, str] | None = None,
    where: Column | None = None,
    array_fields: Sequence[str] = (),
) -> DataFrame:
    """Documents of any Spark data source, narrowed to some fields.

    A store that does not exist reads as an empty table, empty texts as null.
    ``array_fields`` read as arrays of text even where a JSON document holds a
    single value. ``date_patterns`` parses single fields by a pattern of their own;
    ``where`` is pushed to the source where it supports that. Connection settings
    come from the caller's options.
    """
    struct = _struct(schema)
    if format == "json":
        struct = T.StructType([
            T.StructField(f.name, T.StringType() if f.name in array_fields else f.dataType) for f in struct
        ])
    if missing_as_empty and source and format in FILE_FORMATS and not path_exists(spark, source):
        df = spark.createDataFrame([], struct)
    else:
        reader = spark.read.format(format).schema(struct).options(**(options or {}))
        df = reader.load(source) if source else reader.load()
    if where is not None:
        df = df.where(where)
    df = df.select(*(fields or struct.names))
    mixed = [f.name for f in df.schema if f.name in array_fields and isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: _as_array(F.col(c)) for c in mixed})
    if empty_as_null:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts})
    for column, pattern in (date_patterns or {}).items():
        df = df.withColumn(column, parse_timestamp(F.col(column), pattern))
    return df
