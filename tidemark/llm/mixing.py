"""Mixing sources to target weights by a curriculum that changes over time.

Every source has a weight and a schedule: a piecewise linear factor of its weight over training time 0 to 1,
whose integral is made one, so that the weights hold over the whole training. A source's tokens are demanded
in the order of a hash of its documents, once again from the first when they are used up; the cumulative demand
of time t is its target times the integral of its schedule to t. A copy's position is the time at which its first
word is demanded, the inverse of that integral, and copies are range-sorted by position. Cumulative sizes come from
the counts of sorted ranges, so a source with most of the rows is spread over many tasks. The driver sees two
numbers a round while it looks for the sources that reach their cap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranked, staged

#: Weights of the sources in their order, repeating, and how often a document may be taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Schedules in the same order, as (time, factor): the heavy sources give way in the last fifth, the light ones grow there.
SCHEDULES = (((0.0, 1.0), (0.8, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.8, 1.0), (1.0, 3.0)))


def inverse(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the schedule has given this share (0 to 1) of its whole."""
    areas = [(t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, F.lit(None).cast("double")
    for (t0, f0), (t1, f1), area in zip(schedule, schedule[1:], areas, strict=False):
        rest = F.greatest(share * F.lit(whole) - F.lit(before), F.lit(0.0))
        # f0 x + slope x^2 / 2 = rest, solved so that a slope of zero divides by f0
        root = F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * (f1 - f0) / (t1 - t0)) * rest, F.lit(0.0)))
        time = F.when(rest == 0, F.lit(t0)).otherwise(F.least(F.lit(t0) + F.lit(2.0) * rest / (F.lit(f0) + root), F.lit(t1)))
        out = F.when(share * F.lit(whole) >= F.lit(before), time).otherwise(out)
        before += area
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, total) with weight, place (in the order of sources, null last) and target.

    All words are shared by weight; a source stops at `most` times its own, and what it leaves is shared among
    the others by weight, until none is above. Totals are whole numbers, so reruns give the same targets.
    """
    named = sources.select(F.lit("").alias("g"), F.col("source").isNull().alias("last"), "source", "total")
    rows, ranges = ranked(named, ["last", "source"])
    placed = rows.join(ranges, ["g", "_part"]).withColumn("place", F.col("before_n") + F.col("_row") - F.col("_first"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("long")
    placed = staged(placed.select("source", "total", "place", weight.alias("weight")), "sources")
    cap = F.col("total") * most
    words, share = placed.agg(F.sum("total"), F.sum("weight")).collect()[0]
    left, level = words or 0, share or 0
    while True:
        # at a level of left / level words a weight, these stop; the level only rises, so none comes back
        full = cap.cast("decimal(38,0)") * F.lit(level) < F.col("weight").cast("decimal(38,0)") * F.lit(left)
        took, gave = placed.where(full).agg(F.sum(cap), F.sum("weight")).collect()[0]
        now = ((words or 0) - (took or 0), (share or 0) - (gave or 0))
        if now == (left, level):
            break
        left, level = now
    target = F.when(full, cap.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(level or 1)))
    return placed.withColumn("target", target)


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple = SCHEDULES,
    most: int = MOST,
    seed: int = 42,
) -> DataFrame:
    """Copies of documents in training order: (row, key, source, size, source_size, target, copy, words, position).

    size is the number of words (a null text has none); the null source is one of its own, the last. copy
    counts from 0 and its words are those taken of it: all, but for the one copy at which a source's target ends.
    Documents that are not taken have a row with copy, position null and no words, behind all others, and so have those
    without words. `row` tells equal rows apart; repeated rows are documents of their own. An empty table gives an empty mix.
    """
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    name = F.col(source).cast("string")
    told = df.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"), name.alias("source"), F.col(key).alias("key"), size.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("-"))).cast("binary")).alias("order"), F.xxhash64(text).alias("tie"),
    )
    told = staged(told, "sizes")  # the range sort reads its input twice
    rows, ranges = ranked(told, ["order", "key", "size", "tie"], ("size",))
    whole = staged(rows.groupBy("g", "source").agg(F.sum("size").alias("total")), "totals")
    goal = targets(whole.select("source", "total"), weights, most)
    goal = goal.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), (F.col("place") % len(schedules)).alias("kind"), F.col("total").alias("source_size"), "target")
    ranges = ranges.select("g", "_part", "before_size").join(goal, "g")
    local = Window.partitionBy("g", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(local), F.lit(0))).join(ranges, ["g", "_part"])
    placed = placed.withColumn("start", F.col("before_size") + F.col("inner")).withColumn("due", F.floor("target"))
    copies = F.when((F.col("size") > 0) & (F.col("start") < F.col("due")), F.least(F.lit(most), F.ceil((F.col("due") - F.col("start")) / F.col("source_size"))))
    placed = placed.withColumn("copies", F.sequence(F.lit(0), copies.cast("int") - 1)).withColumn("copy", F.explode_outer("copies"))
    at = F.col("start") + F.col("copy") * F.col("source_size")
    words = F.when(F.col("copy").isNull(), F.lit(0)).otherwise(F.least("size", F.col("due") - at)).cast("long")
    share, position = at / F.col("due"), F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        position = F.when(F.col("kind") == i, inverse(share, schedule)).otherwise(position)
    out = placed.select(F.col("_row").alias("row"), F.col("key").alias(key), "source", "size", "source_size", "target", "copy", words.alias("words"), position.alias("position"))
    # written before the range sort, which reads its input twice; a written sort would not be read back in order
    return staged(out, "mix").orderBy(F.col("position").asc_nulls_last(), "row", "copy")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when for the first time; documents in training order, those not taken last."""
    copies = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = copies.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("words").alias("taken"), F.min("position").alias("first_position")
    )
    return each.select("doc_id", "size", "source_size", "target", "taken", "first_position").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


#: Schedules as SQL: the same inverse, piece by piece.
def _inverse_sql(share: str, schedule: tuple[tuple[float, float], ...]) -> str:
    areas = [(t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(schedule, schedule[1:], strict=False)]
    out, before = [], math.fsum(areas)
    for (t0, f0), (t1, f1), area in reversed(list(zip(schedule, schedule[1:], areas, strict=False))):
        before -= area
        slope = (f1 - f0) / (t1 - t0)
        rest = f"({share} * {math.fsum(areas)!r} - {before!r})"
        solved = f"({rest} / {f0!r})" if slope == 0 else f"((sqrt(greatest({f0!r} * {f0!r} + 2 * ({slope!r}) * {rest}, 0)) - {f0!r}) / ({slope!r}))"
        out.append(f"WHEN {rest} >= 0 THEN {t0!r} + {solved}" if before > 1e-12 else f"ELSE {t0!r} + {solved}")
    return f"CASE {' '.join(out)} END" if len(out) > 1 else out[0].removeprefix("ELSE ")


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '-')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, place % 3 AS kind, {MOST} * total AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights, (SELECT sum(total) FROM s) AS words, sum(weight) OVER () AS share
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (share - weights) < weight * (words - caps) AS is_full FROM r),
l AS (SELECT words - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS rest, share - coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS level, * FROM f),
t AS (SELECT source, total, kind, CASE WHEN is_full THEN cap::DOUBLE ELSE rest::DOUBLE * weight / CASE WHEN level = 0 THEN 1 ELSE level END END AS target FROM l),
p AS (SELECT doc_id, size, total, kind, target, floor(target)::BIGINT AS due, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN size > 0 AND start < due THEN start / due::DOUBLE END AS share FROM p)
SELECT doc_id, size, total AS source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE {" + ".join(f"least(size, greatest(due - start - {c} * total, 0))" for c in range(MOST))} END)::BIGINT AS taken,
  CASE WHEN share IS NULL THEN NULL {" ".join(f"WHEN kind = {k} THEN {_inverse_sql('share', s)}" for k, s in enumerate(SCHEDULES))} END AS first_position
FROM q"""
