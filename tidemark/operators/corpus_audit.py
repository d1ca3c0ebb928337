"""One audit of all workspaces, from what the operators say of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: rows of a list that are shown, beside its uncut total.
SHOWN = 20


def _of(df: DataFrame, metric: str, key: str, n=None) -> DataFrame:
    return df.groupBy(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key")).agg((F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0))).cast("long").alias("n"))


def _all(df: DataFrame, metric: str, n=None) -> DataFrame:
    total = F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0))
    return df.agg(total.cast("long").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")


def corpus_audit(workspaces: DataFrame, audits: DataFrame, issues: DataFrame, graded: DataFrame, ready: DataFrame, bindings: DataFrame, relations: DataFrame, images: DataFrame) -> DataFrame:
    """(metric, key, n), counts of all workspaces (ws), key '' for totals.

    audits: ws, terminal_count, supported_count; issues: ws, id, code; graded: ws, id, declared, grounded; ready: ws,
    readiness, a workspace without one counts as 'cover_gaps'; bindings: ws, state; relations: ws, id; images: ws, catalog,
    indexed, stale, of which workspaces without any image do not count. Each table is summed up by itself, so that
    nothing but counts is joined or moved.
    """
    every = workspaces.select("ws").distinct()
    verdict = every.join(ready.select("ws", "readiness"), "ws", "left").select(F.coalesce("readiness", F.lit("cover_gaps")).alias("readiness"))
    seen = images.where("catalog > 0 or indexed > 0")
    parts = [
        _all(every, "workspaces"), _all(audits, "terminal", F.col("terminal_count")), _all(audits, "supported", F.col("supported_count")), _of(issues, "issue", "code"),
        _of(verdict, "readiness", "readiness"), _of(graded, "declared", "declared"), _of(graded, "grounded", "grounded"), _of(bindings, "binding", "state"), _all(relations, "relation_candidates"),
        _all(seen, "image_workspaces"), _all(seen.where("stale"), "image_mismatches"), _all(seen, "image_catalog", F.col("catalog")), _all(seen, "image_indexed", F.col("indexed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def workspace_rows(workspaces: DataFrame, audits: DataFrame, issues: DataFrame, ready: DataFrame) -> DataFrame:
    """(ws, readiness, terminal_count, supported_count, supported_ratio, issue_counts) of every workspace; issue_counts
    lists codes in their order, as `code=n`."""
    per = issues.groupBy("ws", "code").agg(F.count("*").alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat(x["code"], F.lit("="), x["n"].cast("string"))), ",")
    j = workspaces.select("ws").distinct().join(ready.select("ws", "readiness"), "ws", "left").join(audits, "ws", "left").join(per.groupBy("ws").agg(told.alias("issue_counts")), "ws", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terminal_count", "supported_count")]
    return j.select("ws", F.coalesce("readiness", F.lit("cover_gaps")).alias("readiness"), *zero, F.coalesce("supported_ratio", F.lit(0.0)).alias("supported_ratio"), F.coalesce("issue_counts", F.lit("")).alias("issue_counts"))


def shown(rows: DataFrame, order: list[str], most: int = SHOWN) -> DataFrame:
    """The first rows by `order`, with the uncut total of all."""
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))  # a list of `most` rows
    return first.crossJoin(F.broadcast(total))
