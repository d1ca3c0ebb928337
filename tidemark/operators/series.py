"""Series and boundaries: alignment, joins, departures, uncertainty, timelines, picks, strips, speech coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals

#: Fixed values of boundary checks: least tail and its multiple (ms), steps of loudness (dB), likeness of a jump cut.
TAIL_MS, ROOM, STEP_DB, JUMP = 120, 2.5, 12.0, 0.75
#: Fixed values of strips: longest window and widest cell in seconds, cells at most.
TILE, CELL, CELLS = 112, 7, 16
#: The tail in which an end card is looked for, what is left out at its end, and its samples.
TAIL, TAIL_REST, TAIL_SAMPLES = 2500, 200, 5


def aligned(points: DataFrame, words: DataFrame) -> DataFrame:
    """Word that an instant t (ws, p, t) cuts, end of the last word before and start of the next; gaps in ms.

    Three as-of passes over one partitioning by workspace; words do not overlap.
    """
    spans = words.select("ws", "start_ms", "end_ms", F.struct("start_ms", "end_ms", "word").alias("_w"))
    out = intervals.asof(points, spans.withColumn("_s", F.col("start_ms") + 1), ["ws"], "t", "_s", "_w")  # began before t
    out = intervals.asof(out, words.select("ws", F.col("end_ms").alias("prev_end"), F.col("end_ms").alias("_e")), ["ws"], "t", "_e", "prev_end")
    out = intervals.asof(out, words.select("ws", F.col("start_ms").alias("next_start"), F.col("start_ms").alias("_n")), ["ws"], "t", "_n", "next_start", False)
    inside = F.coalesce(F.col("_w.end_ms") > F.col("t"), F.lit(False))
    out = out.withColumn("in_word", F.when(inside, F.col("_w.word")))
    return out.withColumn("gap", F.when(~inside, F.col("next_start") - F.col("prev_end"))).withColumn("tail_gap", F.when(~inside, F.col("t") - F.col("prev_end"))).drop("_w")


def boundary_flags(alignment: DataFrame) -> DataFrame:
    """flags of each instant; alignment has rms_before and rms_after beside the columns of aligned."""
    flags = F.array_compact(
        F.array(
            F.when(F.abs(F.round(F.col("rms_before") - F.col("rms_after"), 2)) > STEP_DB, "loud_step"),
            F.when((F.col("tail_gap") < TAIL_MS) & (F.col("gap") >= ROOM * TAIL_MS), "tight_tail"),
            F.when(F.col("in_word").isNotNull(), "word_interior"),
        )
    )
    return alignment.withColumn("flags", F.array_join(flags, ","))


def join_reports(cuts: DataFrame, frame_ms: int) -> DataFrame:
    """for each two cuts that meet (seq, ord, start, end, rms_in, rms_out, look): loudness step and jump risk.

    look is what the likeness of two frames is taken from: 1 - |difference|.
    """
    order = W.partitionBy("seq").orderBy("ord")
    j = cuts.withColumns({f"_{c}": F.lead(c).over(order) for c in ("start", "rms_in", "look")}).where("_start is not null")
    step, alike = F.round(F.abs(F.col("rms_out") - F.col("_rms_in")), 2), F.round(1 - F.abs(F.col("look") - F.col("_look")), 4)
    flags = F.array_compact(F.array(F.when((alike > JUMP) & (F.col("_start") - F.col("end") > frame_ms), "jump_cut_risk"), F.when(step > STEP_DB, "loud_join")))
    return j.select("seq", "ord", F.col("end").alias("from_t"), F.col("_start").alias("to_t"), step.alias("step_db"), alike.alias("alike"), F.array_join(flags, ",").alias("flags"))


def departures(samples: DataFrame) -> DataFrame:
    """from the last sight of a person to the first absence (ws, t, n, state, grounded).

    Samples of one instant are one group; states that differ there are a conflict, after which nothing is carried on.
    """
    first = F.struct(F.when(F.col("grounded"), 0).otherwise(1).alias("o"), F.col("n"), F.col("state"), F.col("grounded"))
    g = samples.groupBy("ws", "t").agg(F.count_distinct("state").alias("states"), F.min(first).alias("rep"), F.max(F.when(F.col("state") == "absent", 1).otherwise(0)).alias("absent"))
    order = W.partitionBy("ws").orderBy("t")
    g = g.withColumns({"p_states": F.lag("states").over(order), "p_rep": F.lag("rep").over(order), "p_t": F.lag("t").over(order)})
    left = g.where("p_states = 1 and p_rep.state = 'present' and ((states = 1 and rep.state = 'absent') or (states > 1 and absent = 1))")
    sure = (F.col("states") == 1) & F.col("p_rep.grounded") & F.col("rep.grounded")
    reason = F.when(F.col("states") > 1, "conflicting_state_at_timestamp").when(~sure, "endpoint_evidence_missing")
    return left.select("ws", F.col("p_t").alias("before_t"), F.col("t").alias("after_t"), sure.alias("verified"), reason.alias("reason"))


def unobserved(samples: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Workspaces (ws) without a sample."""
    return workspaces.select("ws").distinct().join(samples.select("ws").distinct(), "ws", "left_anti")


def uncertainty(samples: DataFrame, duration: int, workspaces: DataFrame | None = None) -> DataFrame:
    """unobserved edges and runs of uncertain samples of each workspace; of equal bounds the last reason.

    Of the workspaces (ws) that are named, one without a sample is unobserved as a whole.
    """
    resolved = F.col("state") != "uncertain"
    ends = samples.groupBy("ws").agg(F.min(F.when(resolved, F.col("t"))).alias("lo"), F.max(F.when(resolved, F.col("t"))).alias("hi"))
    edge = lambda name, s, e, ok: ends.where(ok).select("ws", s.cast("long").alias("start"), e.cast("long").alias("end"), F.lit(name).alias("reason"))
    zero, whole = F.lit(0), F.lit(duration)
    out = edge("presence_unresolved", zero, whole, "lo is null").withColumn("_o", F.lit(0))
    out = out.unionByName(edge("unobserved_prefix", zero, F.col("lo"), "lo > 0").withColumn("_o", F.lit(0)))
    out = out.unionByName(edge("unobserved_suffix", F.col("hi"), whole, F.col("hi") < duration).withColumn("_o", F.lit(1)))
    order = W.partitionBy("ws").orderBy("t", "n")
    s = samples.withColumn("_new", F.when((F.col("state") == "uncertain") & ~F.coalesce(F.lag("state").over(order) == "uncertain", F.lit(False)), 1).otherwise(0))
    s = s.withColumns({"_k": F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)), "_p": F.lag("t").over(order), "_q": F.lead("t").over(order)})
    runs = s.where("state = 'uncertain'").groupBy("ws", "_k").agg(F.min_by("_p", F.struct("t", "n")).alias("start"), F.max_by("_q", F.struct("t", "n")).alias("end"))
    runs = runs.select("ws", F.coalesce("start", zero).cast("long").alias("start"), F.coalesce("end", whole).cast("long").alias("end"), F.lit("presence_unresolved").alias("reason"), (F.col("_k") + 2).cast("int").alias("_o"))
    runs = runs.where("start < end").join(ends.where("lo is not null").select("ws"), "ws", "left_semi")
    out = out.unionByName(runs).groupBy("ws", "start", "end").agg(F.max_by("reason", "_o").alias("reason"))
    if workspaces is None:
        return out
    none = unobserved(samples, workspaces).select("ws", zero.cast("long").alias("start"), whole.cast("long").alias("end"), F.lit("no_presence_observations").alias("reason"))
    return out.unionByName(none)


def follow_ups(samples: DataFrame, duration: int, workspaces: DataFrame | None = None) -> DataFrame:
    """instants to look at: the middles of unobserved edges and every uncertain sample; all of them if none is resolved.

    Of the workspaces (ws) that are named, one without a sample is looked at in the middles of its four quarters.
    """
    resolved = F.col("state") != "uncertain"
    ends = samples.groupBy("ws").agg(F.min(F.when(resolved, F.col("t"))).alias("lo"), F.max(F.when(resolved, F.col("t"))).alias("hi"))
    out = samples.where(~resolved).select("ws", F.col("t").cast("double").alias("t"))
    out = out.unionByName(ends.where("lo > 0").select("ws", (F.col("lo") / 2).alias("t"))).unionByName(ends.where(F.col("hi") < duration).select("ws", ((F.col("hi") + duration) / 2).alias("t")))
    if workspaces is not None:
        quarter = F.explode(F.array(*(F.lit((i + 0.5) * duration / 4) for i in range(4))))
        out = out.unionByName(unobserved(samples, workspaces).select("ws", quarter.alias("t")))
    return out.distinct()


def speaker_runs(motion: DataFrame, dwell_ms: int) -> DataFrame:
    """who moves most, frame by frame (ws, t_ms, roi, amount), as runs; short runs join the one before.

    A run counts if it is the first or long enough; the others are part of the counting run before them, and
    counting runs of one region in a row are one. Windows alone say so; nothing is folded.
    """
    top = motion.groupBy("ws", "t_ms").agg(F.max_by("roi", F.struct("amount", (-F.col("roi")).alias("low"))).alias("roi"))
    order = W.partitionBy("ws").orderBy("t_ms")
    new = lambda w: F.when(F.coalesce(F.lag("roi").over(w) == F.col("roi"), F.lit(False)), 0).otherwise(1)
    top = top.withColumn("_n", new(order)).withColumn("_k", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = top.groupBy("ws", "_k").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.first("roi").alias("roi"))
    by = W.partitionBy("ws").orderBy("_k")
    counts = F.when((F.col("_k") == 1) | (F.col("end_ms") - F.col("start_ms") >= dwell_ms), 1).otherwise(0)
    runs = runs.withColumn("_c", counts).withColumn("_g", F.sum("_c").over(by.rowsBetween(W.unboundedPreceding, 0)))
    held = runs.groupBy("ws", "_g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("roi", "_k").alias("roi"))
    by = W.partitionBy("ws").orderBy("_g")
    held = held.withColumn("_n", new(by)).withColumn("_r", F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return held.groupBy("ws", "_r").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("roi", "_g").alias("roi")).drop("_r")


def caption_runs(lines: DataFrame, every_ms: int) -> DataFrame:
    """equal captions of a regular scan in a row (ws, t_ms, text) as one; empty ones break nothing."""
    order = W.partitionBy("ws").orderBy("t_ms")
    s = lines.where("text <> ''")
    s = s.withColumn("_n", F.when(F.coalesce(F.lag("text").over(order) == F.col("text"), F.lit(False)), 0).otherwise(1))
    s = s.withColumn("_k", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("ws", "_k", "text").agg(F.min("t_ms").alias("start_ms"), (F.max("t_ms") + every_ms).alias("end_ms"), F.count("*").alias("n")).drop("_k")


def excluded(cuts: DataFrame, by: list[str], start: str, end: str, duration: int) -> DataFrame:
    """what no cut uses of [0, duration), per group."""
    clipped = cuts.select(*by, F.greatest(F.col(start), F.lit(0)).alias(start), F.least(F.col(end), F.lit(duration)).alias(end)).where(F.col(start) < F.col(end))
    return intervals.gaps(clipped, by, start, end, F.lit(duration).cast("long"), F.lit(0))


def sharpest(targets: DataFrame, frames: DataFrame, reach: int) -> DataFrame:
    """best frame (ws, i, t_ms, score) within `reach` steps of each target (ws, i): by score, nearness, earliness."""
    near = targets.select("ws", F.col("i").alias("at"), F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("i")).join(frames, ["ws", "i"])
    best = F.struct("score", (-F.abs(F.col("i") - F.col("at"))).alias("near"), (-F.col("t_ms")).alias("early"))
    return near.groupBy("ws", "at").agg(F.max_by("t_ms", best).alias("t_ms"), F.max("score").alias("score"))


def end_card(frames: DataFrame, least_luma: float = 16.0) -> DataFrame:
    """the steadiest legible frame (ws, t_ms, luma, look) of each workspace: most like a neighbour, of equal ones the later."""
    order = W.partitionBy("ws").orderBy("t_ms")
    f = frames.where(F.col("luma") >= least_luma)
    like = lambda c: F.round(1 - F.abs(F.col("look") - c), 4)
    f = f.withColumn("alike", F.greatest(like(F.lag("look").over(order)), like(F.lead("look").over(order))))
    return f.groupBy("ws").agg(F.max_by("t_ms", F.struct(F.coalesce("alike", F.lit(-1.0)), "t_ms")).alias("t_ms"), F.max("alike").alias("alike"))


def tail_samples(media: DataFrame, limit: str | None = None) -> DataFrame:
    """the times (ws, t_ms) at which an end card is looked for: five evenly over the last 2.5 s of media (ws, duration_ms)
    but for 0.2 s, or before `limit`, a column of the last time allowed; nothing for media without length."""
    last = F.greatest(F.col("duration_ms") - TAIL_REST, F.lit(0))
    last = F.least(last, F.col(limit)) if limit else last  # a null limit allows all
    first = F.greatest(F.col("_last") - TAIL, F.lit(0))
    at = F.transform(F.sequence(F.lit(0), F.lit(TAIL_SAMPLES - 1)), lambda k: F.least(F.round(first + (F.col("_last") - first) * k / (TAIL_SAMPLES - 1)).cast("long"), F.col("_last")))
    return media.where("duration_ms > 0").withColumn("_last", last.cast("long")).where("_last >= 0").select("ws", F.explode(F.array_distinct(at)).alias("t_ms"))


def tail_card(media: DataFrame, frames: DataFrame, least_luma: float = 16.0) -> DataFrame:
    """the end card among the frames (ws, t_ms, luma, look) that stand at the tail's samples: (ws, t_ms of the sample, alike)."""
    seen = intervals.asof(tail_samples(media), frames.select("ws", "t_ms", F.struct("luma", "look").alias("seen")), ["ws"], "t_ms", "t_ms", "seen")
    return end_card(seen.select("ws", "t_ms", "seen.luma", "seen.look"), least_luma)


def inherited(log: DataFrame) -> DataFrame:
    """evidence of each revision (ws, id, line_no, has, evidence): a row without the field has that of the last row with it."""
    order = W.partitionBy("ws", "id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("_e", F.last(F.when(F.col("has"), F.struct("evidence")), True).over(order)).withColumn("evidence", F.col("_e.evidence")).drop("_e")


def strip_windows(media: DataFrame) -> DataFrame:
    """windows of at most 112 s of each medium (ws, start, end in seconds), with cells of at most 7 s and their middles."""
    span = F.col("end") - F.col("start")
    k = F.ceil(span / TILE)
    w = media.where("end > start").withColumns({"_k": k, "_w": span / k}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    cells = F.least(F.lit(CELLS), F.greatest(F.lit(1), F.ceil(F.col("_w") / CELL))).cast("long")
    edge = lambda j: F.round(F.col("start") + j * F.col("_w"), 3)
    w = w.select("ws", "i", edge(F.col("i")).alias("from_s"), edge(F.col("i") + 1).alias("to_s"), cells.alias("cells"))
    step = (F.col("to_s") - F.col("from_s")) / F.col("cells")
    return w.withColumn("middles", F.transform(F.sequence(F.lit(0), F.col("cells").cast("int") - 1), lambda j: F.round(F.col("from_s") + (j + 0.5) * step, 3)))


def colour_check(scenes: DataFrame, distance: DataFrame, window_ms: int, least: float) -> DataFrame:
    """Largest colour distance (ws, t_ms, d) within the window of each scene (ws, t_ms), 0 if there is none.

    A band join as an equi-join: a scene asks in the three buckets of a window's width around it.
    """
    ask = scenes.select("ws", "t_ms", F.explode(F.sequence(F.floor(F.col("t_ms") / window_ms) - 1, F.floor(F.col("t_ms") / window_ms) + 1)).alias("_b"))
    there = distance.select("ws", F.col("t_ms").alias("_t"), "d", F.floor(F.col("t_ms") / window_ms).alias("_b"))
    near = ask.join(there, ["ws", "_b"]).where(F.abs(F.col("_t") - F.col("t_ms")) <= window_ms).groupBy("ws", "t_ms").agg(F.max("d").alias("d"))
    out = scenes.select("ws", "t_ms").join(near, ["ws", "t_ms"], "left")
    return out.select("ws", "t_ms", F.round(F.coalesce("d", F.lit(0.0)), 3).alias("color"), (F.coalesce("d", F.lit(0.0)) >= least).alias("confirmed"))


def nearest_beats(points: DataFrame, beats: DataFrame, by: list[str]) -> DataFrame:
    """The beat (by.., beat) nearest to each instant t of points, of two as near the earlier."""
    b = beats.select(*by, F.col("beat").alias("_x"), "beat")
    before = intervals.asof(points, b.withColumnRenamed("beat", "_before"), by, "t", "_x", "_before")
    both = intervals.asof(before, b.withColumnRenamed("beat", "_after"), by, "t", "_x", "_after", False)
    early = F.col("_after").isNull() | (F.col("t") - F.col("_before") <= F.col("_after") - F.col("t"))
    return both.withColumn("beat", F.when(F.col("_before").isNotNull() & early, F.col("_before")).otherwise(F.col("_after"))).drop("_before", "_after")


def speech_coverage(segments: DataFrame, chunks: DataFrame, stall: DataFrame, least_ms: int = 60_000, share: float = 0.5) -> DataFrame:
    """Spoken and detected speech of each workspace, whether the transcript collapsed, and speech before the stall (ws, stall)."""
    spoken = segments.groupBy("ws").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"))
    cut = F.greatest(F.lit(0), F.least("end_ms", "stall") - F.col("start_ms"))
    heard = chunks.join(stall, "ws").groupBy("ws").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.sum(cut).alias("prefix_ms"))
    j = heard.join(spoken, "ws", "left").withColumn("spoken_ms", F.coalesce("spoken_ms", F.lit(0)))
    bad = (F.col("speech_ms") >= least_ms) & (F.col("spoken_ms") / F.col("speech_ms") < share)
    intact = (F.col("prefix_ms") <= 0) | (F.col("spoken_ms") / F.col("prefix_ms") >= share)
    return j.select("ws", "spoken_ms", "speech_ms", "prefix_ms", bad.alias("collapsed"), F.coalesce(intact, F.lit(True)).alias("prefix_intact"))


def repetition(segments: DataFrame, least: int = 12) -> DataFrame:
    """Share of a segment's most frequent token (ws, id, text), 0 below twelve tokens."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    t = segments.select("ws", "id", F.explode(words).alias("w")).groupBy("ws", "id", "w").agg(F.count("*").alias("c"))
    most = t.groupBy("ws", "id").agg(F.max("c").alias("c"), F.sum("c").alias("n"))
    return most.select("ws", "id", F.when(F.col("n") >= least, F.round(F.col("c") / F.col("n"), 6)).otherwise(0.0).alias("ratio"))


def words_in(segments: DataFrame, words: DataFrame, slack: int = 10, bucket: int = 10_000) -> DataFrame:
    """Words (ws, pos, start_ms, end_ms) that lie within each segment but for 10 ms, by time buckets."""
    s = segments.select("ws", "id", (F.col("start_ms") - slack).alias("lo"), (F.col("end_ms") + slack).alias("hi"))
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    w = words.select("ws", "start_ms", "end_ms", F.floor(F.col("start_ms") / bucket).alias("_b"))
    return s.join(w, ["ws", "_b"]).where("start_ms >= lo and end_ms <= hi").groupBy("ws", "id").agg(F.count("*").alias("n_words"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def tumbling(series: DataFrame, width_ms: int) -> DataFrame:
    """Loudness of tumbling windows: mean square of (ws, t_ms, value) in each."""
    return series.groupBy("ws", (F.floor(F.col("t_ms") / width_ms) * width_ms).alias("window_ms")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * F.col("value") * 100).cast("long")).alias("energy"))
