"""Transcripts: windows, resegmentation, speaker assignment, coverage and contamination guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals

#: Members and pause of a window; collapse, contamination bounds.
MEMBERS, PAUSE_MS = 3, 5000


def windows(segments: DataFrame) -> DataFrame:
    """up to three consecutive segments without a long pause, from two members on; suffixes as well."""
    order = W.partitionBy("ws").orderBy("start_ms", "id")
    out = segments
    for k in (1, 2):
        out = out.withColumns({f"{c}{k}": F.lead(c, k).over(order) for c in ("start_ms", "end_ms", "text")})
    two = F.coalesce(F.col("start_ms1") - F.col("end_ms") <= PAUSE_MS, F.lit(False))
    three = two & F.coalesce(F.col("start_ms2") - F.col("end_ms1") <= PAUSE_MS, F.lit(False))
    return out.where(two).select(
        "ws", F.col("id").alias("first_id"), F.when(three, 3).otherwise(2).cast("long").alias("members"), "start_ms", F.when(three, F.col("end_ms2")).otherwise(F.col("end_ms1")).alias("end_ms"),
        F.when(three, F.concat_ws(" ", "text", "text1", "text2")).otherwise(F.concat_ws(" ", "text", "text1")).alias("text"),
    )


def words(segments: DataFrame) -> DataFrame:
    """Words of segments, 0.4 s each: ws, id, pos, word, start_ms, end_ms."""
    w = segments.select("ws", "id", "start_ms", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    start = (F.col("start_ms") + F.col("pos") * 400).cast("long")
    return w.select("ws", "id", F.col("pos").cast("long").alias("pos"), "word", start.alias("start_ms"), (start + 400).alias("end_ms"))


def resegmented(word: DataFrame, pause_ms: int = 1500) -> DataFrame:
    """F16: segments newly cut where the pause between words is longer than 1.5 s, numbered per workspace."""
    order = W.partitionBy("ws").orderBy("start_ms", "id", "pos")
    opens = F.when(F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order) > pause_ms, F.lit(False)), 1).otherwise(0)
    marked = word.withColumn("_o", opens).withColumn("seg", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("ws", "seg").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"))


def split_segments(segments: DataFrame, word: DataFrame, pause_ms: int = 1500, slack: int = 10, bucket: int = 10_000) -> DataFrame:
    """F16: segments (ws, id, start_ms, end_ms, text, conf) split where the pause between two of their words (ws, n, start_ms,
    end_ms, word, p; n their order) is longer than 1.5 s; (ws, id, start_ms, end_ms, text, conf), numbered anew from 0.

    A word belongs to each segment in which it starts, but for 10 ms at both ends. A segment without a pause stays as it is;
    a part has its words' text and the mean of their p (null counts as 0) to three places, or the segment's conf if its first
    word has no p. Words meet segments by time buckets; pauses are looked for within a segment alone.
    """
    s = segments.select("ws", "id", "start_ms", "end_ms", "text", "conf")
    lo, hi = F.col("s.start_ms") - slack, F.col("s.end_ms") + slack
    own = s.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start_ms") - slack) / bucket), F.floor((F.greatest("start_ms", "end_ms") + slack) / bucket))))
    w = word.select("ws", "n", F.col("start_ms").alias("w0"), F.col("end_ms").alias("w1"), "word", "p", F.floor(F.col("start_ms") / bucket).alias("_b"))
    j = own.alias("s").join(w, ["ws", "_b"]).where((F.col("w0") >= lo) & (F.col("w0") < hi)).select("ws", "id", "conf", "n", "w0", "w1", "word", "p")
    order = W.partitionBy("ws", "id").orderBy("n")
    opens = F.when(F.coalesce(F.col("w0") - F.lag("w1").over(order) > pause_ms, F.lit(False)), 1).otherwise(0)
    marked = j.withColumn("_o", opens).withColumn("part", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)))
    told = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), ""))
    mean = F.round(F.sum(F.coalesce(F.round(F.col("p") * 1_000_000).cast("long"), F.lit(0))) / 1_000_000.0 / F.count("*"), 3)
    parts = marked.groupBy("ws", "id", "part").agg(
        F.min_by("w0", "n").alias("start_ms"), F.max_by("w1", "n").alias("end_ms"), told.alias("text"),
        F.when(F.min_by(F.col("p").isNotNull(), "n"), mean).otherwise(F.first("conf")).alias("conf"),
    )
    split = marked.groupBy("ws", "id").agg(F.max("part").alias("_m")).where("_m > 0").select("ws", "id")
    kept = s.join(split, ["ws", "id"], "left_anti").withColumn("part", F.lit(0).cast("long"))
    out = kept.unionByName(parts.join(split, ["ws", "id"], "left_semi"))
    again = F.row_number().over(W.partitionBy("ws").orderBy("id", "part")).cast("long") - 1
    return out.withColumn("id", again).select("ws", "id", "start_ms", "end_ms", "text", "conf")


def speakers(segments: DataFrame, turn: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Each segment's speaker by largest overlap with a turn; of equal ones the earlier turn; null without."""
    t = turn.select("ws", F.col("start_ms").alias("rstart"), F.col("end_ms").alias("rend"), F.col("speaker").alias("turn_speaker"))
    s = segments.select("ws", "id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    both = intervals.overlap_join(s, t, ["ws"], bucket_ms)
    size = F.least("end", "rend") - F.greatest("start", "rstart")
    best = both.groupBy("ws", "id").agg(F.max_by("turn_speaker", F.struct(size.alias("size"), (-F.col("rstart")).alias("early"), "turn_speaker")).alias("speaker"), F.max(size).alias("overlap_ms"))
    return s.select("ws", "id").join(best, ["ws", "id"], "left")


def contamination(segments: DataFrame, hotwords: str) -> DataFrame:
    """Per workspace the segments in which any of the hotwords stands, as it is written, the distinct texts, and the
    verdict: five segments or more, half of them with a hotword, three in ten distinct at most. Without hotwords none has one."""
    hit = F.lit(False)
    for term in hotwords.split():
        hit = hit | F.contains("text", F.lit(term))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    out = segments.groupBy("ws").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_distinct(text).alias("texts"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    bad = (F.col("n") >= 5) & (F.col("hits") / F.col("n") >= 0.5) & (F.col("texts") / F.col("n") <= 0.3)
    return out.withColumn("contaminated", bad)


def silence(segments: DataFrame) -> DataFrame:
    """longest stretch without speech before the last segment's end, per workspace."""
    order = W.partitionBy("ws").orderBy("start_ms", "end_ms", "id").rowsBetween(W.unboundedPreceding, -1)
    gap = F.col("start_ms") - F.coalesce(F.max("end_ms").over(order), F.lit(0))
    return segments.withColumn("gap", gap).groupBy("ws").agg(F.greatest(F.max("gap"), F.lit(0)).alias("longest_ms"))
