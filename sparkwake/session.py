"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of our own on a local master; on a
    cluster an error, since each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkwake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/sparkwake/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
