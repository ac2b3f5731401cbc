"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where it is unset and Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that they share")
        at = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/e{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and read from then on; drop it when no plan reads it any more."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
