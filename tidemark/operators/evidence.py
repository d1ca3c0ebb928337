"""What grounds a checkpoint or a sequence: segments, images, order of states, kind of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATES = ("assembled", "boundary_verified", "exported")


def segment_key(v: Column) -> Column:
    """Identity of a segment id in a variant: numbers by value (3 and 3.0 agree), strings trimmed, else null."""
    kind, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    text = F.btrim(F.try_variant_get(v, "$", "string"))
    digits = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return F.when(kind == "STRING", F.when(text != "", F.concat(F.lit("s:"), text))).when((kind != "BOOLEAN") & (number >= 0), F.concat(F.lit("n:"), digits))


def segment_support(checkpoints: DataFrame, segments: DataFrame) -> DataFrame:
    """Whether every declared segment (refs) exists and overlaps the span; none declared is no support.

    checkpoints: ws, id, start_ms, end_ms, refs; segments: ws, ref, start_ms, end_ms. One equi-join on
    (ws, ref); a ref that occurs more than once needs one overlap.
    """
    declared = checkpoints.select("ws", "id", "start_ms", "end_ms", F.explode_outer(F.array_distinct("refs")).alias("ref"))
    s = segments.where("0 <= start_ms and start_ms < end_ms").select("ws", "ref", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    meets = F.greatest("start_ms", "_s") < F.least("end_ms", "_e")
    hit = declared.join(s, ["ws", "ref"], "left").groupBy("ws", "id", "ref").agg(F.max(F.coalesce(meets & F.col("_s").isNotNull(), F.lit(False))).alias("_ok"))
    return hit.groupBy("ws", "id").agg(F.bool_and("_ok").alias("supported"), F.count("ref").alias("declared"))


def image_issues(images: DataFrame) -> DataFrame:
    """C17: why an image can't verify a checkpoint, as `issues`; times before the single time before the span.

    images: tracked (null: no record), kind, timestamps, t, span_start, span_end, start, end.
    """
    inside = (
        F.when(F.size(F.coalesce("timestamps", F.array().cast("array<bigint>"))) > 0, F.exists("timestamps", lambda t: (F.col("start") <= t) & (t < F.col("end"))))
        .when(F.col("t").isNotNull(), (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
        .when(F.col("span_start").isNotNull(), F.greatest("span_start", "start") < F.least("span_end", "end"))
    )
    codes = F.array(
        F.when(~F.col("tracked"), "evidence_provenance_missing"),
        F.when(F.col("kind") == "filmstrip", "evidence_role_not_verification"),
        F.when(inside.isNull(), "evidence_time_unavailable").when(~inside, "evidence_outside_checkpoint"),
    )
    return images.withColumn("issues", F.when(F.col("tracked").isNull(), F.array(F.lit("evidence_provenance_missing"))).otherwise(F.array_compact(codes)))


def visual_support(checkpoints: DataFrame, images: DataFrame) -> DataFrame:
    """Whether any referenced image (ws, path) is decodable and has no issue.

    checkpoints: ws, id, start, end, paths; images: ws, path, decodable and the columns of image_issues.
    """
    refs = checkpoints.select("ws", "id", "start", "end", F.explode_outer(F.array_distinct("paths")).alias("path"))
    judged = image_issues(refs.join(images.drop("start", "end"), ["ws", "path"], "left"))
    ok = F.coalesce(F.col("decodable") & (F.size("issues") == 0), F.lit(False))
    return judged.groupBy("ws", "id").agg(F.bool_or(ok).alias("supported"))


def sequence_codes(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """First fault of each cut (seq, ord, start_ms, end_ms, checkpoint_ids, signals), null if sound.

    known: id. Orders are unique in a sequence; a cut needs checkpoints or signals, and known ones.
    """
    many = (F.count("*").over(W.partitionBy("seq", "ord")) > 1) | F.col("ord").isNull()
    refs = sequences.select("seq", "ord", F.explode(F.array_distinct("checkpoint_ids")).alias("id"))
    # by place is enough: where two cuts share one, that fault comes first
    strange = refs.join(known.select("id").distinct(), "id", "left_anti").select("seq", "ord").distinct().withColumn("_strange", F.lit(True))
    size = lambda x: F.coalesce(F.array_size(x), F.lit(0))
    span = (F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms"))
    code = F.when(~F.coalesce(span, F.lit(False)), "span").when(F.col("_many"), "order").when((size("checkpoint_ids") == 0) & (size("signals") == 0), "grounding").when(F.col("_strange"), "unknown_checkpoint")
    return sequences.withColumn("_many", many).join(strange, ["seq", "ord"], "left").withColumn("code", code).drop("_many", "_strange")


def forward_only(log: DataFrame) -> DataFrame:
    """Rows (seq, line_no, status) with `accepted`: no state before the highest accepted one.

    The highest state of all rows before is that of the accepted ones, so one running maximum is exact.
    """
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    before = F.max("_r").over(W.partitionBy("seq").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    return log.withColumn("_r", rank).withColumn("accepted", (F.col("_r") > 0) & (F.col("_r") >= F.coalesce(before, F.lit(0)))).drop("_r")


def content_mode(work: DataFrame) -> DataFrame:
    """C14: how to read a recording, as `mode`.

    work: duration_ms, speech_ms, segments, longest_gap_ms, ocr, scenes, bursts, coverage (the last three may be null).
    """
    long = F.greatest("duration_ms", F.lit(1))
    talks = F.col("speech_ms") * 100 >= long * 35
    hole = talks & (F.col("longest_gap_ms") >= 120_000)
    mode = (
        F.when(~talks & (F.col("ocr") >= 5) & (F.col("ocr") * 60_000 >= 5 * long), "text_led")
        .when((F.col("segments") == 0) & (F.col("scenes") <= 1) & (F.col("bursts") == 0), "loop")
        .when((F.col("segments") == 0) & (F.col("ocr") > 0), "silent_with_text")
        .when(F.col("segments") == 0, "silent")
        .when(hole & (F.col("coverage") < 0.5), "mixed_unsure")
        .when(hole, "mixed")
        .when(talks & (F.col("ocr") > 0), "text_on_screen")
        .when(~talks, "visual_led")
        .otherwise("speech_led")
    )
    return work.withColumn("mode", mode)
