"""What is let in: recognised speech, observations, bound records, spans of older records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import repetition

#: Bounds of recognised speech, by how much an older span may pass its media's end, and states of a person.
COMPRESSION, REPEATED, LOGPROB, WORD_P = 2.4, 0.6, -1.0, 0.1
OVER_S, OVER_SHARE = 5.0, 0.01
STATES = ("present", "absent", "uncertain")


def recognised(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(ws, id, start, end, text, conf, code) of the segments (ws, id, start, end, text, compression, logprob) that have
    text, with words (ws, id, n, start, end, p). code says what fails a segment, else null: 'repeated' (compressed too well,
    or one token too often), 'unplaced' (no start or end: left out, but no failure), 'logprob', 'words' (their mean p).

    The end is that of the last word with both times; conf is the mean p of these words to three places. NaN is no number.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    s = segments.select("ws", "id", number("start").alias("start"), number("end").alias("end"), F.trim("text").alias("text"), number("compression").alias("compression"), number("logprob").alias("logprob")).where("text <> ''")
    w = words.select("ws", "id", "n", number("start").alias("a"), number("end").alias("b"), number("p").alias("p")).where("a is not null and b is not null")
    told = w.groupBy("ws", "id").agg(F.max_by("b", "n").alias("last"), (F.sum(F.round(F.col("p") * 1_000_000).cast("long")) / 1_000_000.0 / F.count("p")).alias("mean"))
    j = s.join(repetition(s), ["ws", "id"], "left").join(told, ["ws", "id"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    code = F.when(yes(F.col("compression") > COMPRESSION) | yes(F.col("ratio") >= REPEATED), "repeated")
    code = code.when(F.col("start").isNull() | F.col("end").isNull(), "unplaced").when(F.col("logprob") < LOGPROB, "logprob").when(F.col("mean") < WORD_P, "words")
    return j.select("ws", "id", F.round("start", 3).alias("start"), F.round(F.coalesce("last", "end"), 3).alias("end"), "text", F.round("mean", 3).alias("conf"), code.alias("code"))


def results(checked: DataFrame) -> DataFrame:
    """(ws, code, id): whether the whole result of a workspace stands (nulls) or which segment fails it first, and why."""
    bad = F.when(F.col("code") != "unplaced", F.struct("id", "code"))
    return checked.groupBy("ws").agg(F.min(bad).alias("_b")).select("ws", F.col("_b.code").alias("code"), F.col("_b.id").alias("id"))


def presence_code(kind: str, subject: str, state: str, timestamp: str, start: str, end: str) -> Column:
    """What is wrong with an observation of a person in [start, end), by column names; null if nothing is."""
    t = F.col(timestamp).cast("double")
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    blank = F.coalesce(F.regexp_replace(subject, r"(?U)\s", "") == "", F.lit(True))
    return (
        F.when(~F.col(kind).eqNullSafe("person_presence"), "kind").when(blank, "subject").when(~F.coalesce(F.col(state).isin(*STATES), F.lit(False)), "state")
        .when(~finite, "timestamp").when(~F.coalesce((F.col(start) <= t) & (t < F.col(end)), F.lit(False)), "outside")
    )


def bound_records(records: DataFrame, manifests: DataFrame, fields: list[str]) -> DataFrame:
    """Records (ws, .., fields) with `code`: 'missing' without one of the fields, 'mismatch' where one differs from that of
    the workspace's manifest (ws, fields); null where all agree or the manifest binds nothing (a null field, or no row)."""
    m = manifests.select("ws", *(F.col(c).alias(f"_m_{c}") for c in fields), F.lit(True).alias("_m"))
    j = records.join(m, "ws", "left")
    binds, lacks, differs = F.coalesce("_m", F.lit(False)), F.lit(False), F.lit(False)
    for c in fields:
        binds, lacks, differs = binds & F.col(f"_m_{c}").isNotNull(), lacks | F.col(c).isNull(), differs | (F.col(c) != F.col(f"_m_{c}"))
    return j.withColumn("code", F.when(~binds, None).when(lacks, "missing").when(differs, "mismatch")).drop("_m", *(f"_m_{c}" for c in fields))


def backfilled(spans: DataFrame, seconds: float = OVER_S, share: float = OVER_SHARE) -> DataFrame:
    """Spans (ws, .., start, end, duration) whose end passes the media's by no more than rounding (the larger of seconds
    and share of the duration) end with the media (`clamped`); `refused` says why others cannot be kept: 'beyond' or 'start'."""
    over = F.col("end") - F.col("duration")
    no = F.when((over > 0) & (over > F.greatest(F.lit(seconds), F.col("duration") * share)), "beyond").when((over > 0) & (F.col("start") >= F.col("duration")), "start")
    out = spans.withColumns({"refused": no, "clamped": F.coalesce((over > 0) & no.isNull(), F.lit(False))})
    return out.withColumn("end", F.when(F.col("clamped"), F.col("duration")).otherwise(F.col("end")))
