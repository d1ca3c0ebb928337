"""Tables written to the folder that all executors share, to cut lineage and to keep indexes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder on a single machine where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'tidemark-shared')}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and reread: what is behind it is not computed again, nor when an executor is lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
