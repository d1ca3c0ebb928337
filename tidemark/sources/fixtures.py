"""Adapters: the driver's tables in the shapes of the evidence model. Times are integer microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Length of every workspace's recording (30 days).
DURATION_US = 2_592_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str, since: str):
    """Microseconds since a day, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{since} 00:00:00', {column})")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint log: ws, id, line_no, status, start_us, end_us, confidence."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    start = micros("ts", "2024-01-01")
    out = e.select(
        (F.col("user_id") % 20).alias("ws"),
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).alias("id"),
        F.when(F.col("event_type").isin("view", "click"), "hypothesized").when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "signup", "corrected").otherwise("invalid").alias("status"),
        start.alias("start_us"),
        F.least(F.lit(DURATION_US), start + F.floor(F.col("value") * 36_000_000.0).cast("long")).alias("end_us"),
        F.when(F.col("value") <= 100, F.col("value") / 100).alias("confidence"),
        "ts",
        "event_id",
    )
    line = F.row_number().over(W.partitionBy("ws", "id").orderBy("ts", "event_id")).cast("long")
    return out.withColumn("line_no", line).drop("ts", "event_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: ws, id, speaker, text, n_words, start_ms, end_ms; 0.4 s a word, pauses of 0, 3 or 6 s."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("ws"), F.col("turn").alias("id"), F.col("role").alias("speaker"), "text")
    c = c.withColumn("n_words", F.size(F.split(F.trim("text"), r"\s+")).cast("long"))
    length = F.col("n_words") * 400
    before = F.coalesce(F.sum(length + (F.col("id") % 3) * 3000).over(W.partitionBy("ws").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("start_ms", before.cast("long")).withColumn("end_ms", (before + length).cast("long"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by ws = event type: i (from 1), t_ms = 40 i, value, label."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    i = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("event_type").alias("ws"), i.alias("i"), (i * 40).alias("t_ms"), "value")


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence cuts: seq, ord, start_s, length_s (whole seconds)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("seq"), F.row_number().over(order).cast("long").alias("ord"), (F.col("l_partkey") % 1000).alias("start_s"), F.col("l_quantity").cast("long").alias("length_s")
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents: doc, ws, family, source, text."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.lit("understanding").alias("family"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("screen").alias("family"), "text")
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.lit("transcript").alias("family"), "text")
    return b.unionByName(d).unionByName(c).where("text is not null").withColumn("ws", F.col("doc") % 50)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image events: image_id, edge (user and type), source, t_us, seq."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        (F.col("user_id") % 200).alias("image_id"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("edge_id"),
        F.when(F.col("event_type") == "view", "inventory").otherwise("canonical").alias("source"),
        micros("ts", "1970-01-01").alias("t_us"),
        F.when(F.col("value") > 100, F.col("value")).alias("score"),
        F.col("event_id").alias("seq"),
    )


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedure steps: ws = source, task = lang, tool, level (modality of the grounded evidence)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    x = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    level = (
        F.when(F.col("quality").isNull(), "unsupported")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "cross_modal")
        .when(F.col("quality") == 1, "visual_only")
        .otherwise("transcript_only")
    )
    return d.join(x, "doc_id", "left").select(F.col("doc_id").alias("step"), F.col("source").alias("ws"), F.col("lang").alias("task"), F.concat(F.lit("tool-"), (F.col("doc_id") % 3).cast("string")).alias("tool"), level.alias("level"))
