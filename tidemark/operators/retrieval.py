"""Text retrieval: substring, coverage and BM25 rankings, and their reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: BM25 and fusion constants, least inverse document frequency, families by priority.
K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60
FAMILIES = ("understanding", "screen", "transcript")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def substring(docs: DataFrame, terms: list[str], top: int) -> DataFrame:
    """Documents that hold every term (case counts), by occurrences; top of each family. The filter is in the scan's stage."""
    hit = docs
    for t in terms:
        hit = hit.where(F.contains("text", F.lit(t)))
    score = sum((occurrences(F.col("text"), t) for t in terms[1:]), occurrences(F.col("text"), terms[0]))
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.desc("score"), "ws", "doc"))
    return hit.withColumn("score", score).withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("family", "ws", "doc", "score", "rank")


def coverage(docs: DataFrame, terms: list[str], top: int) -> DataFrame:
    """Documents with more than half of the distinct lower-cased terms, by terms, then occurrences."""
    terms = sorted({t.lower() for t in terms})
    low = docs.withColumn("_l", F.lower("text"))
    got = [F.contains("_l", F.lit(t)).cast("long") for t in terms]
    many = [occurrences(F.col("_l"), t) for t in terms]
    out = low.withColumn("matched", sum(got[1:], got[0])).withColumn("occurrences", sum(many[1:], many[0])).where(F.col("matched") >= len(terms) // 2 + 1)
    return out.orderBy(F.desc("matched"), F.desc("occurrences"), "family", "ws", "doc").limit(top).select("family", "ws", "doc", "matched", "occurrences")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bm25(docs: DataFrame, prefixes: list[str]) -> DataFrame:
    """BM25 of documents in which every term is the prefix of some token; statistics over all documents.

    Only the query's postings are exploded: a token that no term begins goes no further than its row.
    """
    d = docs.select("family", "ws", "doc", tokens(F.col("text")).alias("_t"))
    count = [F.size(F.filter(F.col("_t"), _starts(p))).cast("long") for p in prefixes]
    d = d.select("family", "ws", "doc", F.size("_t").cast("long").alias("size"), *(c.alias(f"f{i}") for i, c in enumerate(count)))
    stats = d.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(prefixes))))
    hit = d
    for i in range(len(prefixes)):
        hit = hit.where(F.col(f"f{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)))
        f = F.col(f"f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return hit.crossJoin(F.broadcast(stats)).select("family", "ws", "doc", F.round(score, 6).alias("score"))  # one row of statistics


def _starts(prefix: str):
    return lambda x: F.startswith(x, F.lit(prefix))


def ranked(scores: DataFrame, pool: int) -> DataFrame:
    """Rank within each family, at most `pool` of each."""
    rank = F.row_number().over(W.partitionBy("family").orderBy(F.desc("score"), "ws", "doc"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= pool)


def fused(lists: list[DataFrame], top: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (family, ws, doc, rank)."""
    both = lists[0].select("family", "ws", "doc", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("family", "ws", "doc", "rank"))
    both = both.groupBy("family", "ws", "doc").agg(F.round(F.sum(F.round(F.lit(1e12) / (RRF + F.col("rank"))).cast("long")) / 1e12, 4).alias("score"))
    priority = F.when(F.col("family") == FAMILIES[0], 0).when(F.col("family") == FAMILIES[1], 1).otherwise(2)
    return both.orderBy(F.desc("score"), priority, "ws", "doc").limit(top)
