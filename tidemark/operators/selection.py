"""Choices: sidecars, names, paths, priors, glossaries, caps, orders, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Captions by preference, image suffixes, words that say nothing in a title, shares of fields.
CAPTIONS = (".ko.", ".ko-orig.", ".en.")
SUFFIXES = ("jpg", "jpeg", "png", "webp")
STOP = (
    "하이라이트", "경기", "영상", "채널", "구독", "좋아요", "알림", "설정", "공식", "풀버전", "다시보기", "리그", "라운드", "개막전", "시즌",
    "highlights", "official", "full", "match", "video", "channel", "subscribe", "season", "round", "league", "vs", "the", "and", "for",
)
NOISE = r"https?://\S+|@\S+|#\S+|\b\d{1,2}:\d{2}(?::\d{2})?\b|[▶►★☆♥♡]"
SHARES = (("description", 4), ("uploader", 2), ("title", 6))
#: Hand-off formats that carry receipts and sequences, and those that carry neither.
RICH, PLAIN = ("edl", "otio", "fcpxml"), ("xml", "md", "srt")


def sidecar(files: DataFrame) -> DataFrame:
    """The caption file (ws, n, name) of each workspace by language, of equal ones the first."""
    kind = F.lit(len(CAPTIONS))
    for i in reversed(range(len(CAPTIONS))):
        kind = F.when(F.contains("name", F.lit(CAPTIONS[i])), i).otherwise(kind)
    return files.groupBy("ws").agg(F.min_by("name", F.struct(kind.alias("k"), "n")).alias("name"))


def file_times(files: DataFrame, name: str) -> DataFrame:
    """What an image's file name says: an instant, or a strip's span, cells, columns and version (times in ms)."""
    frame = r"^t(\d{9})(?:_c[0-9a-f]{8})?(?:-[^.]+)?\.jpg$"
    strip = r"^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-[^.]+)?\.jpg$"
    part = lambda p, k: F.regexp_extract(name, p, k).try_cast("long")
    return files.withColumns({"t_ms": part(frame, 1), "start_ms": part(strip, 1), "end_ms": part(strip, 2), "cells": part(strip, 3), "cols": part(strip, 4), "version": part(strip, 5)})


def image_path(value: Column) -> Column:
    """Safe path in the workspace, or null: no absolute path, no step up, an image below frames/."""
    p = F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"/(\./)+", "/"), r"^(\./)+|/+(?=/)", "")
    p = F.when(F.contains(p, F.lit("/")), p).otherwise(F.concat(F.lit("frames/"), p))
    ok = ~F.rlike(value, F.lit(r"^[/\\]")) & ~F.rlike(p, F.lit(r"(^|/)\.\.(/|$)")) & F.rlike(p, F.lit(r"^frames/.*\.(?i:" + "|".join(SUFFIXES) + ")$"))
    return F.when(ok, p)


def paired_reasons(shots: DataFrame) -> DataFrame:
    """C20: an instant with its reason: one reason is for all instants (ws, times, reasons), as many pair up, else the code."""
    n, m = F.size("times"), F.size("reasons")
    code = F.when((m > 1) & (m != n), "count_mismatch")
    reasons = F.when(m == 1, F.array_repeat(F.get("reasons", F.lit(0)), n)).when(m == 0, F.array_repeat(F.lit(None).cast("string"), n)).otherwise(F.col("reasons"))
    return shots.withColumn("code", code).withColumn("_z", F.when(F.col("code").isNull(), F.arrays_zip("times", reasons.alias("reason")))).select("ws", "code", F.explode_outer("_z").alias("x")).select("ws", "code", F.col("x.times").alias("t"), F.col("x.reason").alias("reason"))


def prior_terms(text: Column, most: int = 12) -> Column:
    """Content words of a title or a description, first seen first."""
    clean = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, " "), "[]()<>{}|·,、/\\\"'“”‘’!?~*_", " " * 25)
    words = F.array_distinct(F.regexp_extract_all(clean, F.lit(r"[0-9A-Za-z가-힣]{2,}"), F.lit(0)))
    return F.slice(F.filter(words, lambda w: ~F.rlike(w, F.lit(r"^\d+$")) & ~F.lower(w).isin(*STOP)), 1, most)


def priors(media: DataFrame, most: int = 12) -> DataFrame:
    """Terms of title, uploader and description (ws, ..), the best field's last: reserved shares first, then what room is left."""
    fields = [name for name, _ in reversed(SHARES)]
    share = dict(SHARES)
    out = media.select("ws", *(prior_terms(F.col(f), most).alias(f"_{f}") for f in fields))
    taken = F.array().cast("array<string>")
    for f in fields:
        out = out.withColumn(f"_s{f}", F.slice(F.array_except(f"_{f}", taken), 1, share[f]))
        taken = F.concat(*(F.col(f"_s{x}") for x in fields[: fields.index(f) + 1]))
    out = out.withColumn("_seen", taken)
    for f in fields:
        room = F.greatest(F.lit(most) - F.size("_seen"), F.lit(0))
        out = out.withColumn(f"_x{f}", F.slice(F.array_except(f"_{f}", "_seen"), F.lit(1), room)).withColumn("_seen", F.concat("_seen", f"_x{f}"))
    return out.select("ws", F.array_join(F.concat(*(F.concat(f"_s{f}", f"_x{f}") for f, _ in SHARES)), " ").alias("terms"))


def hotwords(terms: DataFrame, cap: int = 50) -> DataFrame:
    """The terms (term, sources, n) of highest priority, lowest first: by sources, then records, then the word."""
    best = terms.orderBy(F.desc("sources"), F.desc("n"), F.desc("term")).limit(cap)
    return best.withColumn("place", F.row_number().over(W.orderBy("sources", "n", "term")).cast("long"))  # at most cap rows


def graph_entities(appearances: DataFrame, cap: int = 400) -> DataFrame:
    """Labels (label, ws) for the graph: the most frequent, of equal ones the first by name."""
    return appearances.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("ws").alias("workspaces")).orderBy(F.desc("n"), "label").limit(cap)


def intent_hits(segments: DataFrame, terms: list[str], top: int) -> DataFrame:
    """Segments (ws, id, start_ms, text) by how many distinct terms they hold, then start; top of each workspace."""
    low = F.lower("text")
    n = [F.contains(low, F.lit(t.lower())).cast("long") for t in dict.fromkeys(terms)]
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.desc("hits"), "start_ms", "id")).cast("long")
    hit = segments.withColumn("hits", sum(n[1:], n[0])).where("hits > 0")
    return hit.withColumn("rank", rank).where(F.col("rank") <= top).select("ws", "id", "hits", "rank")


def chosen(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records (id, ..) in the order asked for (place, id); found is false for unknown ids."""
    return ids.join(records.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def image_order(records: DataFrame) -> DataFrame:
    """Place of each image (ws, path, start, t) in its workspace: by span start, else instant, else last; then path."""
    at = F.coalesce("start", "t", F.lit(float("inf")))
    return records.withColumn("place", F.row_number().over(W.partitionBy("ws").orderBy(at, "path")).cast("long"))


def ribbons(segments: DataFrame) -> DataFrame:
    """Spans by speaker where a workspace has two speakers or more (ws, id, start_ms, end_ms, speakers), and whether several share one."""
    s = segments.select("ws", "id", "start_ms", "end_ms", F.size("speakers").alias("_n"), F.explode("speakers").alias("speaker"))
    many = s.groupBy("ws").agg(F.count_distinct("speaker").alias("_k")).where("_k >= 2").select("ws")
    return s.join(many, "ws", "left_semi").select("ws", "id", "speaker", "start_ms", "end_ms", (F.col("_n") > 1).alias("shared"))


def reply_locale(text: Column, asked: Column) -> Column:
    """Primary tag of the locale asked for ('' if it is none); of auto, Korean if the text has a Hangul syllable, else English."""
    own = F.lower(F.regexp_extract(F.trim(asked), r"^([A-Za-z]{2,8})(?:-[A-Za-z0-9]{1,8})*$", 1))
    return F.when(F.lower(F.trim(asked)) == "auto", F.when(F.rlike(text, F.lit("[가-힣]")), "ko").otherwise("en")).otherwise(own)


def last_reasons(log: DataFrame) -> DataFrame:
    """The last reason of each file (ws, file, n, reason)."""
    return log.groupBy("ws", "file").agg(F.max_by("reason", "n").alias("reason"))


def merged_glossary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two term tables (term, ws, n) as one; a workspace's newer count replaces its older one, so a repeat changes nothing."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    one = both.groupBy("term", "ws").agg(F.max_by("n", "_o").alias("n"))
    return one.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("sources"))


def source_states(files: DataFrame) -> DataFrame:
    """State of a ledger file (ws, present, readable, valid): absent, ready, without valid records, unreadable."""
    state = F.when(~F.col("present"), "absent").when(~F.col("readable"), "unreadable").when(F.col("valid") == 0, "present_without_valid_records").otherwise("ready")
    return files.withColumn("state", state)


def refused(requests: DataFrame) -> DataFrame:
    """The first rule that an export request (format, receipt, output, ids, sequence: booleans but the format) breaks, or null."""
    rich = F.col("format").isin(*RICH)
    code = F.when(F.col("receipt") & ~F.col("output"), "receipt_without_output").when(F.col("receipt") & ~rich, "receipt_unsupported")
    code = code.when(F.col("sequence") & F.col("ids"), "ids_and_sequence").when(F.col("sequence") & ~rich, "sequence_unsupported")
    return requests.withColumn("code", code)
