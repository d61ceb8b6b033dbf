"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package is written for: runtime re-planning with
# skewed-partition splitting, and calendar days cut in UTC.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "dayloom", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    ``extra`` holds further settings with ``__`` in place of dots, e.g.
    ``spark__sql__shuffle__partitions="2000"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session uses a folder
    below its warehouse; any other master is refused, as that folder may be one of the driver's machine alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/dayloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives Catalyst
    the real size of the table, so that a join against it is broadcast only
    when that size is below the session's threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, a folder or anything matching a glob is there."""
    system, target = _file_system(spark, path)
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where it is absent."""
    system, target = _file_system(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(target)] if system.exists(target) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables (call when results are consumed)."""
    system, target = _file_system(spark, scratch_root(spark))
    system.delete(target, True)
