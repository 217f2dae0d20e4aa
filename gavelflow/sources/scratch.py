"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset and driver and executors
    are one process, under the session's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext._temp_dir
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: computed once, however often it is read."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
