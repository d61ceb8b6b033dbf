"""Helpers shared by the text operators: stored intermediates, Arrow maps, ranks without a global sort."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dayloom.session import scratch_root

Columns = dict[str, list]
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH = "67108864b"
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one run in the folder named by spark.checkpoint.dir.

    ``store`` cuts the lineage: what is read back survives a lost executor. ``drop``
    deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def slices(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes, so that what is made of it in Python stays small."""
    rows = max(1, int(size * batch.num_rows / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with Arrow batches of at most BATCH_BYTES, unless the session sets a size of its own.

    Batches are held outside the JVM's heap on both sides of the worker, so their size, 64 MB by
    default, counts several times over for every core of an executor.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, DEFAULT_BATCH) == DEFAULT_BATCH:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, start: Callable[[], Callable[[Columns], Columns]], ddl: str) -> DataFrame:
    """Apply a function of column lists to every Arrow batch, a few megabytes at a time.

    ``start`` runs once per task and returns the function, so that tables it needs are
    built once; the function may return any number of rows.
    """
    schema = struct(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        work = None
        for batch in batches:
            if work is None:
                work = start()
            for part in slices(batch):
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return map_arrow(df, run, schema)


def with_run(df: DataFrame) -> DataFrame:
    """Add ``run_``, the partition a row is in, and ``row_``, unique per row. Store the result before using them."""
    return df.withColumn("run_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id())


def ranked(stored: DataFrame, keys: list[str], local: str, run: str, out: str) -> DataFrame:
    """Number rows within keys from 0, given their stored number within (run, keys).

    Only counts per (run, keys) are ordered, so that a key with any share of the rows costs
    one count row per run. ``stored`` must be a stored table, so that runs stay the same.
    """
    counts = stored.groupBy(run, *keys).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(run, *keys, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return stored.join(starts, [run, *keys]).withColumn(out, F.col("start_") + F.col(local)).drop("start_")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
