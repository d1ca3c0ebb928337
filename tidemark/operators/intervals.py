"""Interval algebra over half-open spans: union, gaps, complement, difference, overlap and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans of each group merged where they overlap or touch; (by.., start, end, n).

    One exchange by the group: a span opens an island if it starts after all earlier ends.
    """
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col(start) > reach, F.lit(True)), 1).otherwise(0)
    marked = df.select(*by, start, end).withColumn("_o", opens)
    marked = marked.withColumn("_i", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_i")


def union_within(df: DataFrame, by: list[str], start: str, end: str, whole: Column) -> DataFrame:
    """The union of what spans have within [0, whole]; spans wholly outside have nothing."""
    low, high = F.greatest(F.col(start), F.lit(0).cast(df.schema[start].dataType)), F.least(F.col(end), whole)
    return union(df.select(*by, low.alias(start), high.alias(end)).where(F.col(start) <= F.col(end)), by, start, end)


def gaps(df: DataFrame, by: list[str], start: str, end: str, whole: Column, least: Column) -> DataFrame:
    """uncovered stretches of [0, whole) of more than `least`, the tail included; groups with spans only."""
    order = W.partitionBy(*by).orderBy(start, end)
    cursor = F.coalesce(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(df.schema[end].dataType))
    inner = df.select(*by, cursor.alias("gap_start"), F.col(start).alias("gap_end"))
    tail = df.groupBy(*by).agg(F.max(end).alias("gap_start")).withColumn("gap_end", whole)
    return inner.unionByName(tail).where(F.col("gap_end") - F.col("gap_start") > least)


def difference(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What the union of `left` has beyond the union of `right`, per group; (by.., start, end).

    A sweep over the ends of both unions: +1 for the left, -1 for the right side; a stretch belongs to
    the difference while the left is open and the right is not.
    """
    ends = []
    for side, df in (("_l", union(left, by, start, end)), ("_r", union(right, by, start, end))):
        for at, step in ((start, 1), (end, -1)):
            ends.append(df.select(*by, F.col(at).alias("_t"), F.lit(step if side == "_l" else 0).alias("_l"), F.lit(step if side == "_r" else 0).alias("_r")))
    events = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    events = events.groupBy(*by, "_t").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    order = W.partitionBy(*by).orderBy("_t")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    swept = events.select(*by, "_t", F.lead("_t").over(order).alias("_n"), F.sum("_l").over(run).alias("_a"), F.sum("_r").over(run).alias("_b"))
    parts = swept.where("_n is not null and _a > 0 and _b = 0").select(*by, F.col("_t").alias(start), F.col("_n").alias(end))
    return union(parts, by, start, end).drop("n")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], bucket: int, ls="start", le="end", rs="rstart", re="rend") -> DataFrame:
    """Pairs of overlapping spans of a group, by an equi-join on time buckets.

    Each span is listed under the buckets it meets; a pair counts in the bucket where its overlap begins,
    so that it appears once. Spans much longer than the bucket cost rows, shorter ones share buckets.
    """
    cover = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket)))
    a = left.where(F.col(ls) < F.col(le)).withColumn("_b", cover(ls, le))
    b = right.where(F.col(rs) < F.col(re)).withColumn("_b", cover(rs, re))
    both = a.join(b, [*by, "_b"]).where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    return both.where(F.col("_b") == F.floor(F.greatest(ls, rs) / bucket)).drop("_b")


def asof(points: DataFrame, events: DataFrame, by: list[str], at: str, time: str, value: str, backward: bool = True) -> DataFrame:
    """For each point the last event at or before it (or the first at or after it), by one sort per group."""
    p = points.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(events.schema[value].dataType).alias("_v"), F.struct(*points.columns).alias("_p"))
    e = events.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    # looking ahead is looking back from the end: a frame that follows would be summed anew for each row
    order = W.partitionBy(*by).orderBy(F.col("_t") if backward else F.desc("_t"), "_k").rowsBetween(W.unboundedPreceding, 0)
    return p.unionByName(e).withColumn("_v", F.last("_v", True).over(order)).where("_p is not null").select("_p.*", F.col("_v").alias(value))
