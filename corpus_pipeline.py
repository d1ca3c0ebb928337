"""The corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and what its predecessor kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, secrets, simhash, substring
from tidemark.llm.common import ranked, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = ["_row1", "_row2"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with 128 bits that tell its rows apart: ids may repeat or be null; rows equal in all columns are alike."""
    return docs.select(*COLUMNS).withColumns({ROW[0]: F.xxhash64(*COLUMNS), ROW[1]: F.xxhash64(F.lit(1), *COLUMNS)})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = keyed(docs)
    gone = quality.rules(rows).where("not kept").select(*ROW).distinct()
    return rows.join(gone, ROW, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    rows = keyed(docs)
    found = simhash.near_duplicates(rows.select(F.struct("doc_id", *ROW).alias("key"), "text"), "key")
    first = found.where(F.col("key").eqNullSafe(F.col("component_id"))).select("key.*").select(*ROW).distinct()
    return rows.join(first, ROW, "left_semi").select(*COLUMNS).dropDuplicates()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of its own for each: the id where ids tell rows apart, else the place in the order of ids
    and all columns. Equal input gives equal numbers, however its rows were written."""
    rows = docs.select(*COLUMNS)
    if rows.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return rows.withColumn("_row", F.col("doc_id").cast("long"))
    placed, _ = ranked(keyed(rows).withColumn("g", F.lit("")), ["doc_id", *ROW])
    return placed.select(*COLUMNS, "_row")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of which an earlier copy stays; a text of nothing else goes."""
    rows = numbered(docs)
    found = staged(substring.passages(rows, "_row"), "repeats")
    cut = substring.removed(rows, found, "_row").select(*COLUMNS)
    return cut.where(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "").withColumn("n_chars", F.length("text").cast("long"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by its kind in angle brackets."""
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    cut = staged(packing.pieces(docs, packing.default_path("word_bpe_49k.json")), "pieces")
    return packing.pack(cut)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packed),
]

#: Fingerprints, MinHash and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
