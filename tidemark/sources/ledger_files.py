"""JSONL, JSON and subtitle sources with lenient and strict reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_source import numbered, refuse


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSONL files; rows carry file and line number, a line that is no object is a reject.

    Files are read in byte ranges (line_source.numbered); blank lines count as lines but are neither. Types are checked
    against the variant itself, for a true is no number here; broken UTF-8 is a reject. Strictly, a file that has lines but
    no valid one raises.
    """
    lines = numbered(spark, path).where(F.trim(F.col("raw")) != "")
    lines = lines.select("file", "line_no", "raw", F.when(F.is_valid_utf8("raw"), F.try_parse_json("raw")).alias("v"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    for f in schema.fields:
        if isinstance(f.dataType, T.DoubleType | T.LongType):
            kind = F.schema_of_variant(F.expr(f"try_variant_get(v, '$.{f.name}', 'variant')"))
            ok = ok & F.coalesce(~kind.isin("BOOLEAN", "STRING"), F.lit(True))
    if strict:
        refuse(lines.groupBy("file").agg(F.count_if(ok).alias("n")).where("n = 0"), "no valid line")
    fields = [F.expr(f"try_variant_get(v, '$.{f.name}', '{f.dataType.simpleString()}')").alias(f.name) for f in schema.fields]
    return lines.where(ok).select("file", "line_no", *fields), lines.where(~ok).select("file", "line_no", "raw")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """A10: cues (file, cue, start_ms, end_ms, text) of .srt and .vtt files; tags, counters and marks are stripped."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    blocks = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\r|﻿", ""), r"\n[ \t]*\n")).alias("cue", "b"))
    time = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"
    part = [F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("b", time, k), F.lit("")), F.lit("999999")), F.lit(0)).cast("long") for k in range(1, 9)]
    ms = lambda a: ((part[a] * 60 + part[a + 1]) * 60 + part[a + 2]) * 1000 + part[a + 3]
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)", 1), "<[^>]*>", ""), r"\s+", " "))
    return blocks.where(F.col("b").rlike(time)).select("file", F.col("cue").cast("long").alias("cue"), ms(0).alias("start_ms"), ms(4).alias("end_ms"), text.alias("text"))
