"""Numbered lines of files that are read in byte ranges, and transcripts that are one JSON array a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a number looks to schema_of_variant; a boolean or a string is none.
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of all lines of the files under a path, blank ones too, numbered from 1.

    Files are split by bytes where lines begin, so that no task holds a file. Lines are counted for each split, and
    a prefix sum over a file's splits gives each its first number; within a split lines keep the order of the scan.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path)
    own = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("i"))
    splits = own.groupBy("file", "start").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"))
    return own.join(splits, ["file", "start"]).select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("line_no"), "raw")


def refuse(bad: DataFrame, why: str) -> None:
    """Raises if there is a file in `bad`; one name is enough."""
    found = bad.select("file").limit(1).collect()
    if found:
        raise ValueError(f"{why}: {found[0].file}")


def transcripts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, at, start, end, text, item) of transcript files, each a JSON array of segments.

    Kept are objects with finite numbers 0 <= start < end and a string as text; at is the place in the array, item the
    object as it stands, with all its fields. A file that is no JSON array is empty. Strictly, for a reader that will write it again,
    that raises, and so does an array none of whose items is valid; an empty array does not.
    """
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    files = whole.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    items = files.select("file", kind.alias("kind"), F.expr("try_variant_get(v, '$', 'array<variant>')").alias("items"))
    each = items.where(F.col("kind").startswith("ARRAY")).select("file", F.posexplode("items").alias("at", "item"))
    of = lambda name, t: F.expr(f"try_variant_get(item, '$.{name}', '{t}')")
    number = lambda name: F.coalesce(F.schema_of_variant(of(name, "variant")).rlike(NUMBER), F.lit(False))
    sound = number("start") & number("end") & F.coalesce(F.schema_of_variant(of("text", "variant")) == "STRING", F.lit(False))
    each = each.select("file", F.col("at").cast("long").alias("at"), sound.alias("sound"), of("start", "double").alias("start"), of("end", "double").alias("end"), of("text", "string").alias("text"), F.to_json("item").alias("item"))
    good = F.col("sound") & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") < float("inf"))
    good = F.coalesce(good, F.lit(False))
    if strict:
        refuse(items.where(~F.col("kind").startswith("ARRAY")), "no JSON array")
        refuse(each.groupBy("file").agg(F.count_if(good).alias("n")).where("n = 0"), "no valid segments")
    return each.where(good).drop("sound")
