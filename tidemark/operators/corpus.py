"""Corpus roll-ups: procedures, entities, relations, tags, glossary, storage, links, access log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

LEVELS = ("cross_modal", "visual_only", "transcript_only", "unsupported")


def evidence(steps: DataFrame) -> DataFrame:
    """Steps by level, per task and overall (task null), zeros kept; one pass with grouping sets."""
    return steps.rollup("task").agg(F.count("*").alias("steps"), *(F.count_if(F.col("level") == x).alias(f"n_{x}") for x in LEVELS))


def durable(appearances: DataFrame, least: int = 2) -> DataFrame:
    """Entities with the number of their appearances and workspaces, durable from two on."""
    return appearances.groupBy("entity").agg(F.count("*").alias("appearances"), F.count_distinct("ws").alias("workspaces")).withColumn("durable", F.col("appearances") >= least)


def relations(triples: DataFrame, limit: int = 60) -> DataFrame:
    """The first distinct (s, p, o), by value."""
    ok = triples.where("coalesce(s,'') <> '' and coalesce(p,'') <> '' and coalesce(o,'') <> ''")
    return ok.select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(limit)


def storage(files: DataFrame) -> DataFrame:
    """Bytes per workspace and category with subtotals and the grand total."""
    return files.rollup("ws", "category").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def access(log: DataFrame) -> DataFrame:
    """Calls, empty reads and last time by command."""
    return log.groupBy("command").agg(F.count("*").alias("calls"), F.count_if(F.col("hits") == 0).alias("empty"), F.max("ts").alias("last"))


def terms(pairs: DataFrame, stop: int = 2) -> DataFrame:
    """Tokens of the corrected text that the original lacks, with pairs and workspaces."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= stop))
    new = pairs.select("ws", F.explode(F.array_except(words("corrected"), words("asr"))).alias("term"))
    return new.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("ws").alias("sources"))


def links(pages: DataFrame) -> DataFrame:
    """Targets of a page's links, each once, with how often."""
    hrefs = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return hrefs.groupBy("path", "target").agg(F.count("*").alias("n"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes that edges (src, dst) lead to from the roots, with their distance.

    A level's nodes are deduplicated before they are joined again, and written, so that no level computes those
    before it anew; it ends when a level finds nothing new. The driver learns only that.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    last = written(roots.select("node", F.lit(0).cast("long").alias("depth")).distinct(), "reached")
    seen, k = last, 0
    while not last.isEmpty():
        k += 1
        step = last.join(edges, last.node == edges.src).select(F.col("dst").alias("node")).distinct()
        last = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k).cast("long")), "reached")
        seen = seen.unionByName(last)
    return seen


def merged_images(events: DataFrame) -> DataFrame:
    """One record an image: last non-null score, distinct causes, tracked if any event is canonical."""
    order = F.struct("t_us", "seq")
    return events.groupBy("image_id").agg(
        F.count_distinct("edge_id").alias("causes"), F.bool_or(F.col("source") != "inventory").alias("tracked"), F.max_by("score", F.when(F.col("score").isNotNull(), order)).alias("score"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")
    )


def image_counts(records: DataFrame, links: DataFrame) -> DataFrame:
    """Counts over records (image_id, path, exists, tracked, causes): all, available, tracked and not, those that a
    checkpoint links (links: image, by path or id), their causes, and those of unknown cause."""
    named = links.select("image").distinct()
    by = lambda c: records.select("image_id", F.col(c).cast("string").alias("image")).join(named, "image", "left_semi").select("image_id")
    linked = by("path").union(by("image_id")).distinct().withColumn("linked", F.lit(True))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    causes = F.coalesce("causes", F.lit(0))
    return records.join(linked, "image_id", "left").agg(
        F.count("*").alias("images"), F.count_if("exists").alias("available_images"), F.count_if("tracked").alias("tracked_images"), F.count_if(no("tracked")).alias("legacy_untracked_images"),
        F.count_if("linked").alias("checkpoint_linked_images"), F.coalesce(F.sum(causes), F.lit(0)).alias("causal_edges"), F.count_if(causes == 0).alias("unknown_inventory_links"),
    )


def top_share(counts: DataFrame, by: str, value: str, limit: int) -> DataFrame:
    """The first rows by value with the uncapped total beside them."""
    total = counts.agg(F.count("*").alias("total_rows"))
    return counts.orderBy(F.desc(value), by).limit(limit).crossJoin(F.broadcast(total))  # one row
