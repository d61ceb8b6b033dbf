"""CSV scans and file listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_headerless_csv(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    schema: StructType | str | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """A folder of headerless part files as one table, columns named by position.

    Without a schema the types are inferred, which reads the files twice. A
    folder may hold several write runs; ``dedupe`` keeps equal rows once.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
    df = reader.csv(path).toDF(*names)
    return df.distinct() if dedupe else df


def read_headered_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    drop: Sequence[str] = ("Id",),
    fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """CSV with a header line, without its id column, with optional null fills."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path).drop(*drop)
    return df.na.fill(dict(fill)) if fill else df


def read_separated(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Folder, name and size of the files that match a glob, sorted by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    parts = F.split("path", "/")
    return (
        files.option("recursiveFileLookup", True)
        .load(folder)
        .select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length")
        .orderBy("folder", "name")
    )
