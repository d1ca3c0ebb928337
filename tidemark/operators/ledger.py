"""Append-only checkpoint ledgers: validation, transition guard, latest state, coverage, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals

TERMINAL = ("verified", "corrected")
#: Gap in microseconds that counts, and the readiness bounds and weights.
GAP_US, COVERED, VERIFIED = 3_000_000, 0.999, 0.6


def validated(log: DataFrame, duration: int) -> DataFrame:
    """Log plus code, the first rule that a row breaks (null: valid)."""
    code = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id")
        .when(~F.coalesce(F.col("status").isin("hypothesized", *TERMINAL), F.lit(False)), "status")
        .when(F.coalesce((F.col("start_us") < 0) | (F.col("start_us") >= F.col("end_us")), F.lit(True)), "span")
        .when(F.col("end_us") > duration, "duration")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence"), "confidence")
    )
    return log.withColumn("code", code)


def guarded(valid: DataFrame) -> DataFrame:
    """A row that goes back from a terminal status is rejected; terminal rows never are."""
    earlier = F.count_if(F.col("status").isin(*TERMINAL)).over(W.partitionBy("ws", "id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    return valid.withColumn("accepted", ~((F.col("status") == "hypothesized") & (F.coalesce(earlier, F.lit(0)) > 0)))


def latest(log: DataFrame, duration: int) -> DataFrame:
    """the last accepted row of each id; guard and rank share one exchange by (ws, id)."""
    ok = guarded(validated(log, duration).where("code is null")).where("accepted")
    last = F.row_number().over(W.partitionBy("ws", "id").orderBy(F.desc("line_no")))
    return ok.withColumn("_n", last).where("_n = 1").select("ws", "id", "line_no", "status", "start_us", "end_us", "confidence")


def coverage(state: DataFrame) -> DataFrame:
    """Merged spans of each workspace."""
    return intervals.union(state, ["ws"], "start_us", "end_us")


def readiness(state: DataFrame, duration: int) -> DataFrame:
    """Counts, covered and verified ratios, gaps, mean confidence, score and verdict of each workspace."""
    counts = state.groupBy("ws").agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("hypothesized", *TERMINAL)),
        F.sum(F.round(F.col("confidence") * 1_000_000).cast("long")).alias("_c"),
        F.count("confidence").alias("_n"),
    )
    share = lambda df, name: coverage(df).groupBy("ws").agg((F.sum(F.col("end_us") - F.col("start_us")) / F.lit(float(duration))).alias(name))
    holes = intervals.gaps(state, ["ws"], "start_us", "end_us", F.lit(duration).cast("long"), F.lit(GAP_US)).groupBy("ws").agg(F.count("*").alias("n_gaps"))
    j = counts.join(share(state, "covered"), "ws").join(share(state.where(F.col("status").isin(*TERMINAL)), "verified"), "ws", "left").join(holes, "ws", "left")
    covered, verified, n_gaps = F.col("covered"), F.coalesce("verified", F.lit(0.0)), F.coalesce("n_gaps", F.lit(0))
    mean = F.coalesce(F.col("_c") / 1_000_000.0 / F.col("_n"), F.lit(0.0))
    verdict = F.when((n_gaps > 0) | (covered < COVERED), "cover_gaps").when(verified < VERIFIED, "verify_more").otherwise("converged")
    return j.select(
        "ws", "n_hypothesized", "n_verified", "n_corrected", F.round(covered, 4).alias("covered_ratio"), F.round(verified, 4).alias("verified_ratio"), n_gaps.alias("n_gaps"),
        F.round(mean, 3).alias("mean_confidence"), F.round(0.4 * covered + 0.4 * verified + 0.2 * F.least(mean, F.lit(1.0)), 3).alias("score"), verdict.alias("readiness"),
    )
