"""Folders for work tables, shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver ends; below a temporary one only where that is unset and Spark runs in this
    process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fragloom-")
    path = f"{base.rstrip('/')}/fragloom-{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet and read again: cuts the lineage, survives lost executors."""
    path = work_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
