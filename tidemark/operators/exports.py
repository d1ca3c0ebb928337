"""Hand-off formats: blocks of text per row by column expressions, folded to one document per key on demand.

The blocks are the distributed result; document() gathers one key's blocks, as a file must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: CMX 3600 knows no event number beyond this.
EDL_EVENTS = 999


def placed(cuts: DataFrame) -> DataFrame:
    """Cuts (seq, ord, start_ms, length_ms, ..) with event number and record offset in their sequence."""
    order = W.partitionBy("seq").orderBy("ord")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    return cuts.withColumns({"event": F.row_number().over(order).cast("long"), "record_ms": F.sum("length_ms").over(run) - F.col("length_ms"), "events": F.count("*").over(W.partitionBy("seq"))})


def note(note_: Column, ids: Column, signals: Column) -> Column:
    """A cut's first line with what grounds it."""
    refs = F.concat(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.concat(F.lit("checkpoint:"), fn.single_line(x))), F.transform(F.coalesce(signals, F.array().cast("array<string>")), lambda x: F.concat(F.lit("signal:"), fn.single_line(x))))
    first = F.regexp_extract(note_, r"^([^\n\r]*)", 1)
    return F.when(F.size(refs) > 0, F.concat(first, F.lit(" | grounding: "), F.array_join(refs, ", "))).otherwise(first)


def edl(cuts: DataFrame, clip: str, num: int, den: int) -> DataFrame:
    """Seq, ord, block; sequences of over 999 events have none (see edl_refused)."""
    c = placed(cuts).where(F.col("events") <= EDL_EVENTS)
    s, n, r = F.col("start_ms"), F.col("length_ms"), F.col("record_ms")
    times = [fn.timecode(x, num, den) for x in (s, s + n, r, r + n)]
    head = F.format_string("%03d  AX       V     C        %s %s %s %s", "event", *times)
    return c.select("seq", "ord", F.concat(head, F.lit(f"\n* FROM CLIP NAME: {clip}\n* COMMENT: "), "note", F.lit("\n")).alias("block"))


def edl_refused(cuts: DataFrame) -> DataFrame:
    """Sequences that the format can't hold, with their number of events."""
    return cuts.groupBy("seq").agg(F.count("*").alias("events")).where(F.col("events") > EDL_EVENTS)


def xmeml(marks: DataFrame, num: int, den: int) -> DataFrame:
    """Marker blocks of checkpoints (ws, id, status, start_ms, end_ms, comment)."""
    at = lambda c: fn.frames(F.col(c), num, den).cast("string")
    block = F.concat(
        F.lit("  <marker>\n   <name>"), fn.escaped(F.col("id")), F.lit(" ["), "status", F.lit("]</name>\n   <comment>"), fn.escaped(F.trim("comment")),
        F.lit("</comment>\n   <in>"), at("start_ms"), F.lit("</in>\n   <out>"), at("end_ms"), F.lit("</out>\n  </marker>"),
    )
    return marks.select("ws", "id", block.alias("block"))


def fcpxml(cuts: DataFrame, num: int, den: int) -> DataFrame:
    """Clip blocks (seq, ord, block) of cuts (.., name, status, note), frame-aligned."""
    t = lambda c: fn.rational(F.col(c), num, den)
    block = F.concat(
        F.lit('<asset-clip ref="r2" offset="'), t("record_ms"), F.lit('" start="'), t("start_ms"), F.lit('" duration="'), t("length_ms"), F.lit('" name='), fn.escaped(F.col("name"), True),
        F.lit(' format="r1"><marker start="'), t("start_ms"), F.lit('" duration="'), t("length_ms"), F.lit('" value='), fn.escaped(F.concat("name", F.lit(" ["), "status", F.lit("]")), True),
        F.lit(" note="), fn.escaped(F.col("note"), True), F.lit("/></asset-clip>"),
    )
    return placed(cuts).select("seq", "ord", block.alias("block"))


def otio(cuts: DataFrame, num: int, den: int) -> DataFrame:
    """Clips as JSON (seq, ord, block) with source range and marker metadata."""
    span = lambda a, b: F.struct(F.lit("TimeRange.1").alias("OTIO_SCHEMA"), *(F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), F.lit(num / den).alias("rate"), fn.frames(F.col(c), num, den).cast("double").alias("value")).alias(n) for c, n in ((a, "start_time"), (b, "duration"))))
    clip = F.struct(F.lit("Clip.2").alias("OTIO_SCHEMA"), F.col("name"), span("start_ms", "length_ms").alias("source_range"), F.struct(F.col("status"), F.col("note")).alias("metadata"))
    return placed(cuts).select("seq", "ord", F.to_json(clip).alias("block"))


def srt(speech: DataFrame, screen: DataFrame | None = None) -> DataFrame:
    """Cues (ws, ord, block) of (ws, start_ms, end_ms, id, text); workspaces without speech show screen text."""
    filled = lambda d: d.where(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "").select("ws", "id", "start_ms", "end_ms", "text")
    rows = filled(speech)
    if screen is not None:
        rows = rows.unionByName(filled(screen).join(rows.select("ws").distinct(), "ws", "left_anti"))
    order = F.row_number().over(W.partitionBy("ws").orderBy("id")).cast("long")
    rows = rows.withColumn("ord", order)
    block = F.concat(F.col("ord").cast("string"), F.lit("\n"), fn.clock(F.col("start_ms"), ","), F.lit(" --> "), fn.clock(F.col("end_ms"), ","), F.lit("\n"), F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("\n"))
    return rows.select("ws", "ord", block.alias("block"))


def document(blocks: DataFrame, by: str, order: str, head: str = "", foot: str = "") -> DataFrame:
    """One text per key: blocks in order, joined by line feeds, between head and foot."""
    rows = F.array_sort(F.collect_list(F.struct(order, "block")))
    return blocks.groupBy(by).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["block"]), "\n"), F.lit(foot)).alias("text"))


def receipts(documents: DataFrame, by: str, ledger: DataFrame, form: str) -> DataFrame:
    """Digest of each document with ids, digests and states of what it shows; no time, so equal inputs agree."""
    state = F.to_json(F.struct("status", "confidence"))
    proof = ledger.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", F.sha2(F.concat_ws("\x1f", "id", state), 256).alias("revision"), "status"))).alias("checkpoints"))
    return documents.join(proof, by, "left").select(by, F.lit(form).alias("format"), F.sha2("text", 256).alias("artifact_sha256"), "checkpoints")
