"""Shared folder for intermediate tables, and reading of the source tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    target, files = _folder(spark, path)
    files.deleteOnExit(target)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and it survives lost executors.

    The shuffle files that led to it go at once, not when the driver next collects its garbage.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    was = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_SHUFFLES_GO) if was is None else conf.set(_SHUFFLES_GO, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``store`` gave, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        target, files = _folder(df.sparkSession, path)
        files.delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, to be sent to Python in batches of a few megabytes, whatever the length of its texts.

    The session's limit is lowered only where it is Spark's own default.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES).lower().rstrip("b") in ("67108864", "64m"):
        conf.set(_BATCH_BYTES, "4m")
    return df


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
