"""Structured Streaming over ledgers and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def access_counts(stream: DataFrame) -> DataFrame:
    """Running calls and empty reads by command (complete mode)."""
    return stream.groupBy("command").agg(F.count("*").alias("calls"), F.count_if(F.col("hits") == 0).alias("empty"))


def windowed(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling windows of events under a watermark; a Spark capability beyond the evidence model itself."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "command").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "command", "n")


def latest_sink(spark: SparkSession, path: str):
    """A foreachBatch function that appends a micro-batch's rows, partitioned by workspace."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("ws").parquet(path)

    return write


def drained(query_df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a streaming frame over what is there now and returns the result table."""
    spark = query_df.sparkSession
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
