"""Tables written once to the folder that driver and executors share, so lost executors lose no finished work and ids stay as they are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fieldbook-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back; a fresh local folder only where that is unset and Spark is one local process."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return _read(df, path)


def stored_by(df: DataFrame, tag: str, column: str) -> DataFrame:
    """As ``stored``, in a folder for each value of a column: a filter on it reads those folders only."""
    path = shared_path(df.sparkSession, tag)
    df.write.partitionBy(column).parquet(path)
    return _read(df, path)


def _read(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
