"""Session helpers."""

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


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """End a lineage with a table in the shared folder, computed once and deleted when the application ends.

    With a column given, its values become folders, so a filter on it reads those only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/cut-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))


def spread(df: DataFrame, rows: int = 4000) -> DataFrame:
    """The rows dealt over tasks of about so many, for a narrow table whose rows are much work each: a small file is read by one task."""
    return df.repartition(max(1, min(-(-df.count() // rows), 10_000)))
