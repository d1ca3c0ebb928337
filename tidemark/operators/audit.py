"""Verification: grounding levels, audits, priorities, cut grounding, drift and the states that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals

#: Weights of the doubt signals, confidence below which a segment is weak, and doubt where none is stated.
WEIGHTS = {"self_doubt": 0.4, "transcript_silence": 0.25, "asr_weakness": 0.2, "speaker_shift": 0.15}
LOW_CONF, UNSTATED = 0.6, 0.5
#: Slack at a cut's edges (ms, share of the cut), and drift of spans beyond the duration that is mended.
SLACK_MS, SLACK_SHARE = 2000, 0.1


def modality(visual: Column, transcript: Column) -> Column:
    """Level that two kinds of evidence make together."""
    return F.when(visual & transcript, "cross_modal").when(visual, "visual_only").when(transcript, "transcript_only").otherwise("unsupported")


def levels(checkpoints: DataFrame, visual: DataFrame, segments: DataFrame) -> DataFrame:
    """Declared and grounded level of each checkpoint (ws, id, ..), and whether it is supported.

    visual: ws, id, artifact, code (null: the artifact supports); one good artifact is enough. segments: ws, id, ok,
    a row for each declared segment; all must be there. Both are aggregated before they are joined.
    """
    v = visual.groupBy("ws", "id").agg(F.bool_or(F.col("code").isNull()).alias("_v"))
    t = segments.groupBy("ws", "id").agg(F.bool_and("ok").alias("_t"))
    j = checkpoints.join(v, ["ws", "id"], "left").join(t, ["ws", "id"], "left")
    no = F.lit(False)
    seen, heard = F.coalesce("_v", no), F.coalesce("_t", no)
    declared = modality(F.col("_v").isNotNull(), F.col("_t").isNotNull())
    return j.withColumns({"declared": declared, "grounded": modality(seen, heard), "supported": seen | heard}).drop("_v", "_t")


def issues(graded: DataFrame, visual: DataFrame) -> DataFrame:
    """What is wrong with each checkpoint: (ws, id, code, artifact). graded has legacy and noted (booleans) and status."""
    none = F.lit(None).cast("string").alias("artifact")
    wrong = graded.where("not supported")
    out = wrong.select("ws", "id", F.lit("missing_support").alias("code"), none)
    out = out.unionByName(wrong.where("legacy").select("ws", "id", F.lit("legacy_unstructured").alias("code"), none))
    out = out.unionByName(graded.where("status = 'corrected' and not noted").select("ws", "id", F.lit("correction_note_missing").alias("code"), none))
    return out.unionByName(visual.where("code is not null").join(graded.select("ws", "id"), ["ws", "id"], "left_semi").select("ws", "id", "code", "artifact"))


def audit(graded: DataFrame, wrong: DataFrame, duration: int) -> DataFrame:
    """Terminal and supported checkpoints, covered share of the supported, and issues of each workspace."""
    counts = graded.groupBy("ws").agg(F.count("*").alias("terminal_count"), F.count_if("supported").alias("supported_count"))
    spans = graded.where("supported").select("ws", F.greatest("start_us", F.lit(0)).alias("start_us"), F.least("end_us", F.lit(duration)).alias("end_us"))
    share = intervals.union(spans, ["ws"], "start_us", "end_us").groupBy("ws").agg(F.round(F.sum(F.col("end_us") - F.col("start_us")) / F.lit(float(duration)), 4).alias("share"))
    bad = wrong.groupBy("ws").agg(F.count("*").alias("issues"))
    j = counts.join(share, "ws", "left").join(bad, "ws", "left")
    return j.select("ws", "terminal_count", "supported_count", F.coalesce("share", F.lit(0.0)).alias("supported_ratio"), F.coalesce("issues", F.lit(0)).alias("issues"))


def priorities(open_: DataFrame, segments: DataFrame, bucket: int) -> DataFrame:
    """Doubt of each open hypothesis by four weighted signals.

    open_: ws, id, start_us, end_us, confidence. segments: ws, rstart, rend, conf, speaker. The overlap join is an
    equi-join on time buckets; a hypothesis without an overlapping segment keeps its silence.
    """
    both = intervals.overlap_join(open_.select("ws", "id", "start_us", "end_us"), segments, ["ws"], bucket, "start_us", "end_us")
    weak = F.coalesce(F.col("conf") < LOW_CONF, F.lit(False))
    heard = both.groupBy("ws", "id").agg(F.count("*").alias("n"), F.count_if(weak).alias("weak"), F.count_distinct(F.when(F.col("speaker") != "", F.col("speaker"))).alias("speakers"))
    j = open_.join(heard, ["ws", "id"], "left")
    doubt = {
        "self_doubt": F.round(F.coalesce(1 - F.col("confidence"), F.lit(UNSTATED)), 4),
        "transcript_silence": F.when(F.col("n").isNull(), 1.0).otherwise(0.0),
        "asr_weakness": F.round(F.coalesce(F.col("weak") / F.col("n"), F.lit(0.0)), 4),
        "speaker_shift": F.when(F.col("speakers") >= 2, 1.0).otherwise(0.0),
    }
    j = j.withColumns(doubt)
    terms = [F.col(k) * w for k, w in WEIGHTS.items()]
    return j.withColumn("score", F.round(sum(terms[1:], terms[0]), 3)).select("ws", "id", "start_us", "end_us", *WEIGHTS, "score")


def queue(scored: DataFrame, top: int = 5) -> DataFrame:
    """The first by score, then start and id, of each workspace."""
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.desc("score"), "start_us", "id")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def uncovered(cuts: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Stretches of each cut (by.., start, end) that no evidence span (by.., s, e) covers, and which are blocking.

    A stretch at an edge of its cut is let pass up to two seconds or a tenth of the cut, whichever is less.
    """
    inside = cuts.join(evidence, by).select(*by, F.greatest("start", "s").alias("s"), F.least("end", "e").alias("e")).where("s < e")
    parts = intervals.union(inside, by, "s", "e").drop("n").join(cuts.select(*by, "start", "end"), by)
    order = W.partitionBy(*by).orderBy("s")
    before = parts.select(*by, "start", "end", F.coalesce(F.lag("e").over(order), F.col("start")).alias("gap_start"), F.col("s").alias("gap_end"))
    tail = parts.groupBy(*by, "start", "end").agg(F.max("e").alias("gap_start")).withColumn("gap_end", F.col("end"))
    bare = cuts.join(parts.select(*by).distinct(), by, "left_anti").select(*by, "start", "end", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    gaps = before.unionByName(tail).unionByName(bare).where("gap_start < gap_end")
    edge = (F.col("gap_start") == F.col("start")) | (F.col("gap_end") == F.col("end"))
    slack = F.least(F.lit(float(SLACK_MS)), (F.col("end") - F.col("start")) * SLACK_SHARE)
    return gaps.withColumn("blocking", ~(edge & (F.col("gap_end") - F.col("gap_start") <= slack)))


def grounded_sequences(cuts: DataFrame, refs: DataFrame, gaps: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per sequence the unknown and unsupported checkpoints its cuts name, blocking stretches, and the verdict.

    refs: seq, ord, id; checkpoints: id, supported. A cut must name a checkpoint, and all that it names must support it.
    """
    named = refs.join(checkpoints.withColumn("_known", F.lit(True)), "id", "left")
    by_cut = named.groupBy("seq", "ord").agg(F.count_if(F.col("_known").isNull()).alias("unknown"), F.count_if(~F.coalesce("supported", F.lit(True))).alias("unsupported"))
    blocks = gaps.where("blocking").groupBy("seq", "ord").agg(F.count("*").alias("blocking"))
    j = cuts.select("seq", "ord").join(by_cut, ["seq", "ord"], "left").join(blocks, ["seq", "ord"], "left")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = j.groupBy("seq").agg(F.count_if(F.col("unknown").isNull()).alias("bare"), zero("unknown").alias("unknown"), zero("unsupported").alias("unsupported"), zero("blocking").alias("blocking"))
    return out.withColumn("grounded", F.col("bare") + F.col("unknown") + F.col("unsupported") + F.col("blocking") == 0)


def drift(pins: DataFrame, current: DataFrame) -> DataFrame:
    """Pinned revisions (seq, id, pin) whose checkpoint is gone or has another hash (id, hash)."""
    return pins.join(current, "id", "left").where(F.col("hash").isNull() | (F.col("hash") != F.col("pin"))).select("seq", "id")


def cut_states(refs: DataFrame, pins: DataFrame, drifted: DataFrame, cuts: DataFrame) -> DataFrame:
    """Grounding state of each cut: signals only, drifted, unpinned or current. cuts: seq, ord, has_signals, length."""
    j = refs.join(pins.select("seq", "id", F.lit(True).alias("_p")), ["seq", "id"], "left").join(drifted.select("seq", "id", F.lit(True).alias("_d")), ["seq", "id"], "left")
    g = j.groupBy("seq", "ord").agg(F.bool_or(F.col("_d").isNotNull()).alias("_d"), F.bool_or(F.col("_p").isNull()).alias("_u"))
    state = F.when(F.col("_d").isNull() & F.col("has_signals"), "signal_only").when(F.col("_d"), "drifted").when(F.col("_u"), "unpinned").otherwise("current")
    return cuts.join(g, ["seq", "ord"], "left").select("seq", "ord", "length", state.alias("state"))


def clamped(spans: DataFrame, duration: Column, floor: float = 5.0, share: float = 0.01) -> DataFrame:
    """Ends of derived spans that lie a little beyond the duration are drawn back to it, others stay as they are."""
    over = (F.col("end") > duration) & (F.col("start") < duration) & (F.col("end") - duration <= F.greatest(F.lit(floor), duration * share))
    return spans.withColumn("end", F.when((duration > 0) & over, duration).otherwise(F.col("end")))


def mended(log: DataFrame, duration: int) -> DataFrame:
    """Ends that drift beyond the duration by at most min(3 s, max(0.05 s, 0.5 %)) are drawn back to it."""
    most = int(min(3.0, max(0.05, 0.005 * duration / 1e6)) * 1e6)
    drifts = (F.col("end_us") > duration) & (F.col("end_us") - duration <= most) & (F.col("start_us") < duration)
    return log.withColumn("end_us", F.when(drifts, F.lit(duration).cast("long")).otherwise(F.col("end_us")))


def probe_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """C11: workspaces whose probe differs: duration by over 0.05 s, rate by over 0.01, or other sizes; old and new share ws."""
    j = old.alias("a").join(new.alias("b"), "ws")
    fields = F.array_compact(
        F.array(
            F.when(F.abs(F.col("a.duration") - F.col("b.duration")) > 0.05, "duration"),
            F.when(F.abs(F.col("a.fps") - F.col("b.fps")) > 0.01, "fps"),
            F.when(F.col("a.width") != F.col("b.width"), "width"),
            F.when(F.col("a.height") != F.col("b.height"), "height"),
        )
    )
    return j.select("ws", F.array_join(fields, ",").alias("drift")).where("drift <> ''")


def binding(manifest: DataFrame) -> DataFrame:
    """What a manifest row (readable, ids found and wanted, draft) allows."""
    state = (
        F.when(~F.col("readable"), "unreadable").when((F.col("ids") > 0) & (F.col("ids") < F.col("wanted")), "incomplete").when(F.col("ids") >= F.col("wanted"), "bound")
    )
    return manifest.withColumn("state", state.when(F.col("draft"), "draft").otherwise("legacy"))


def presence(judged: DataFrame, duration: float, half: float = 0.5) -> DataFrame:
    """Checkpoints that judgments of a person's presence (t, state) make: a second around t, terminal unless uncertain."""
    start, end = F.greatest(F.lit(0.0), F.col("t") - half), F.least(F.lit(duration), F.col("t") + half)
    out = judged.withColumns({"start": start, "end": end, "status": F.when(F.col("state") == "uncertain", "hypothesized").otherwise("verified")})
    return out.where("start <= t and t < end")
