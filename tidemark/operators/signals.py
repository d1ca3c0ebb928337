"""Signal series: adaptive scenes, bursts, label merges, lattice proof, cuts and beats, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of scene detection and of label merging.
SCENE, FLOOR, TIMES, MERGE_MS, TAIL_MS = 0.3, 0.04, 3.0, 2000, 1500


def scenes(series: DataFrame, n: int, scale: float) -> DataFrame:
    """hits by score, or by three times the mean of the n scores before; ws, i, t_ms, score."""
    order = W.partitionBy("ws").orderBy("i").rowsBetween(-n, -1)
    s = series.select("ws", "i", "t_ms", F.round(F.col("value") / scale, 6).alias("score"))
    s = s.withColumn("mean", F.avg((F.col("score") * 1_000_000).cast("long")).over(order) / 1_000_000.0)
    return s.where((F.col("score") >= SCENE) | ((F.col("score") >= FLOOR) & (F.col("score") >= TIMES * F.col("mean")))).drop("mean")


def bursts(series: DataFrame, top: int = 5) -> DataFrame:
    """stretches above max(p75, median + 3) with index gaps of two at most, by their excess; five a workspace.

    The median is the mean of the two middle values, p75 the value at index floor(0.75 (n - 1)); a stretch is widened
    by one window on either side, but not beyond the series.
    """
    order = W.partitionBy("ws").orderBy("i")
    sized = series.withColumn("_r", F.row_number().over(W.partitionBy("ws").orderBy("value")))
    level = series.groupBy("ws").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("_n"), F.min("t_ms").alias("_lo"), F.max("t_ms").alias("_hi"))
    p75 = sized.join(level.select("ws", "_n"), "ws").where(F.col("_r") == F.floor(0.75 * (F.col("_n") - 1)) + 1).select("ws", F.col("value").alias("p75"))
    over = series.join(level.join(p75, "ws"), "ws").where("_n >= 4").where(F.col("value") >= F.greatest("p75", F.col("median") + 3))
    over = over.withColumn("_o", F.when(F.coalesce(F.col("i") - F.lag("i").over(order) <= 2, F.lit(False)), 0).otherwise(1))
    over = over.withColumn("_k", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)))
    got = over.groupBy("ws", "_k").agg(
        F.min(F.greatest(F.col("t_ms") - 40, F.col("_lo"))).alias("start_ms"), F.max(F.least(F.col("t_ms") + 40, F.col("_hi")) + 40).alias("end_ms"), F.sum(F.round((F.col("value") - F.col("median")) * 100).cast("long")).alias("excess")
    )
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.desc("excess"), "start_ms"))
    return got.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("_k")


def merged(hits: DataFrame) -> DataFrame:
    """hits (ws, t_ms, label) merged with the last event only: same label, within 2 s of its extended end."""
    order = W.partitionBy("ws").orderBy("t_ms", "label")
    joins = (F.lag("label").over(order) == F.col("label")) & (F.col("t_ms") - (F.lag("t_ms").over(order) + TAIL_MS) <= MERGE_MS)
    m = hits.withColumn("_o", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    m = m.withColumn("event", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return m.groupBy("ws", "event").agg(F.min("label").alias("label"), F.min("t_ms").alias("start_ms"), (F.max("t_ms") + TAIL_MS).alias("end_ms"), F.count("*").alias("n"))


def cut_offsets(cuts: DataFrame) -> DataFrame:
    """Record offsets of cuts in their sequence, and the instants where two join."""
    order = W.partitionBy("seq").orderBy("ord")
    at = F.sum("length_s").over(order.rowsBetween(W.unboundedPreceding, 0))
    return cuts.select("seq", "ord", "start_s", "length_s", (at - F.col("length_s")).alias("record_in"), at.alias("record_out"), F.lead("ord").over(order).isNotNull().alias("joins"))


def beat_offsets(joins: DataFrame, period_ms: int) -> DataFrame:
    """Distance of joins to the nearest beat of a regular grid, maximum and nearest-rank p90 per sequence."""
    ms = F.col("record_out") * 1000
    d = joins.where("joins").withColumn("_d", F.least(ms % period_ms, period_ms - ms % period_ms))
    return d.groupBy("seq").agg(F.max("_d").alias("max_ms"), F.expr("percentile_disc(0.9) within group (order by _d)").cast("long").alias("p90_ms"), F.count("*").alias("n"))


def scenes_by_rate(series: DataFrame, scale: float, window_ms: int = 2000) -> DataFrame:
    """hits by score, or by three times the mean of the scores of the window before; (ws, i, t_ms, score).

    The window holds as many scores as two seconds have by the distance of the first two (i from 1 without gaps; 40 ms if
    they fall together), one at least; the first score has none. Window sums are differences of two running sums, fetched by place.
    """
    s = series.select("ws", "i", "t_ms", F.round(F.col("value") / scale, 6).alias("score"))
    first = s.where("i <= 2").groupBy("ws").agg((F.max("t_ms") - F.min("t_ms")).alias("_dt"))
    n = F.greatest(F.lit(1), F.bround(window_ms / F.when(F.col("_dt") == 0, 40).otherwise(F.col("_dt")))).cast("long")
    before = W.partitionBy("ws").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    run = s.withColumn("_c", F.coalesce(F.sum((F.col("score") * 1_000_000).cast("long")).over(before), F.lit(0)))
    at = run.join(first, "ws").withColumn("_from", F.greatest(F.lit(1), F.col("i") - n))
    back = run.select("ws", F.col("i").alias("_from"), F.col("_c").alias("_b"))
    mean = F.when(F.col("i") > 1, (F.col("_c") - F.col("_b")) / (F.col("i") - F.col("_from")) / 1_000_000.0)
    hit = (F.col("score") >= SCENE) | F.coalesce((F.col("score") >= FLOOR) & (F.col("score") >= TIMES * mean), F.lit(False))
    return at.join(back, ["ws", "_from"]).where(hit).select("ws", "i", "t_ms", "score")


def cadence(frames: DataFrame, streams: DataFrame, num: int, den: int) -> DataFrame:
    """What the stream's header (ws, start_pts, nb_frames, duration_ts; the last two may be null) and the decoded frames
    (ws, idx, pts, duration) agree on: first time, count, length and lattice; proven if all do. Media without frames prove nothing.
    """
    own = frames.groupBy("ws").agg(F.min_by("pts", "idx").alias("_first"), F.count("*").alias("_n"), F.max_by(F.col("pts") + F.col("duration"), "idx").alias("_end"))
    even = lattice(frames.select("ws", "idx", "pts"), num, den).select("ws", "constant")
    j = streams.join(own, "ws", "left").join(even, "ws", "left")
    agree = {
        "first_ok": F.col("_first") == F.col("start_pts"),
        "count_ok": F.col("nb_frames").isNull() | (F.col("nb_frames") == F.col("_n")),
        "length_ok": F.col("duration_ts").isNull() | (F.col("_end") - F.col("_first") == F.col("duration_ts")),
        "lattice_ok": F.col("constant"),
    }
    out = j.select("ws", *(F.coalesce(F.col("_n").isNotNull() & c, F.lit(False)).alias(k) for k, c in agree.items()))
    return out.withColumn("proven", F.col("first_ok") & F.col("count_ok") & F.col("length_ok") & F.col("lattice_ok"))


def lattice(frames: DataFrame, num: int, den: int) -> DataFrame:
    """Whether all frame times (ws, idx, pts) lie on one lattice of num/den units, by integer products."""
    order = W.partitionBy("ws").orderBy("idx")
    slack = F.col("pts") * den - F.col("idx") * num
    whole = frames.withColumn("_s", slack).withColumn("_g", F.col("idx") - F.lag("idx").over(order))
    out = whole.groupBy("ws").agg(F.count("*").alias("n"), F.min("_s").alias("low"), F.max("_s").alias("high"), F.max(F.coalesce("_g", F.lit(1))).alias("step"))
    return out.withColumn("constant", (F.col("high") - F.col("low") < den) & (F.col("step") == 1))


def hellinger(histograms: DataFrame) -> DataFrame:
    """Distance of each histogram (by, k, p) to the one before it in its group."""
    order = W.partitionBy("by").orderBy("k")
    h = histograms.withColumn("q", F.lag("p").over(order)).where("q is not null")
    same = F.aggregate(F.zip_with("p", "q", lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda a, x: a + x)
    return h.select("by", "k", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - same)), 6).alias("distance"))
