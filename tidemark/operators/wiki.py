"""Corpus knowledge: labels, tags, relations, procedures and their coherence, set differences, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VISUAL = ("cross_modal", "visual_only")


def labels(names: Column) -> Column:
    """Distinct trimmed non-empty labels, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")))


def valid_relations(triples: Column) -> Column:
    """Triples whose three parts are all there."""
    return F.filter(triples, lambda r: (F.coalesce(r["s"], F.lit("")) != "") & (F.coalesce(r["p"], F.lit("")) != "") & (F.coalesce(r["o"], F.lit("")) != ""))


def relation_candidates(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (ws, id, entities, speakers, relations) of two labels or more that have no valid relation yet."""
    c = checkpoints.withColumn("labels", labels(F.concat("entities", "speakers")))
    return c.where((F.size(valid_relations(F.col("relations"))) == 0) & (F.size("labels") >= 2)).select("ws", "id", F.array_join("labels", ",").alias("labels"))


def entities(checkpoints: DataFrame, notes: DataFrame) -> DataFrame:
    """Labels with their appearances, workspaces, quotes and relations; durable from two appearances on,
    or if quoted, related or with notes (label) of their own."""
    seen = checkpoints.select("ws", "id", F.explode(labels(F.concat("entities", "speakers"))).alias("label")).groupBy("label").agg(F.count("*").alias("appearances"), F.array_join(F.array_sort(F.collect_set("ws")), ",").alias("workspaces"))
    quoted = checkpoints.where("quote <> ''").select(F.explode(labels(F.col("speakers"))).alias("label")).groupBy("label").agg(F.count("*").alias("quotes"))
    related = checkpoints.select(F.explode(valid_relations(F.col("relations"))).alias("r")).select(F.explode(F.array("r.s", "r.o")).alias("label")).groupBy("label").agg(F.count("*").alias("relations"))
    j = seen.join(quoted, "label", "left").join(related, "label", "left").join(notes.select("label").distinct().withColumn("_n", F.lit(True)), "label", "left")
    durable = (F.col("appearances") >= 2) | F.col("quotes").isNotNull() | F.col("relations").isNotNull() | F.col("_n").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("label", "appearances", "workspaces", zero("quotes"), zero("relations"), durable.alias("durable"))


def tag_index(checkpoints: DataFrame) -> DataFrame:
    """By mode and tag the checkpoints and their workspaces."""
    t = checkpoints.select("ws", "id", "mode", F.explode(F.array_distinct("tags")).alias("tag"))
    return t.groupBy("mode", "tag").agg(F.count("*").alias("n"), F.count_distinct("ws").alias("workspaces"))


def procedure_steps(checkpoints: DataFrame) -> DataFrame:
    """A step for each task-* tag of a supported checkpoint, with its tool-* tags and evidence."""
    after = lambda prefix: F.transform(F.filter("tags", lambda t: F.startswith(t, F.lit(prefix)) & (F.length(t) > len(prefix))), lambda t: F.substring(t, len(prefix) + 1, 200))
    evidence = F.when(F.col("level").isin(*VISUAL), "visual_verified").when(F.col("level") == "transcript_only", "speech_only").otherwise("agent_estimated")
    c = checkpoints.where("level <> 'unsupported'")
    return c.select("ws", "id", F.explode(after("task-")).alias("task"), after("tool-").alias("tools"), "tokens", "level", evidence.alias("evidence"))


def coherence(steps: DataFrame) -> DataFrame:
    """By task the tools that a strict majority of tool-tagged workspaces share, and the workspaces without any of them.

    Two or more tagged workspaces without a shared tool are all off the task's domain.
    """
    used = steps.select("task", "ws", F.explode("tools").alias("tool")).distinct()
    tagged = used.select("task", "ws").distinct()
    size = tagged.groupBy("task").agg(F.count("*").alias("tagged"))
    shared = used.groupBy("task", "tool").agg(F.count("*").alias("n")).join(size, "task").where(F.col("n") >= F.floor(F.col("tagged") / 2) + 1).select("task", "tool")
    off = tagged.join(used.join(shared, ["task", "tool"]).select("task", "ws").distinct(), ["task", "ws"], "left_anti").groupBy("task").agg(F.count("*").alias("off"))
    tools = shared.groupBy("task").agg(F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("consensus"))  # no more than its tools
    j = size.join(tools, "task", "left").join(off, "task", "left")
    off = F.when(F.col("consensus").isNull() & (F.col("tagged") < 2), 0).otherwise(F.coalesce("off", F.lit(0)))
    return j.select("task", "tagged", F.coalesce("consensus", F.lit("")).alias("consensus"), off.cast("long").alias("off_domain"))


def maturity(steps: DataFrame, least: int = 3) -> DataFrame:
    """Workspaces, steps, visual share, coherence, warning and route of each task."""
    s = steps.groupBy("task").agg(F.count_distinct("ws").alias("workspaces"), F.count("*").alias("steps"), F.count_if(F.col("level").isin(*VISUAL)).alias("visual"))
    j = s.join(coherence(steps), "task", "left").withColumns({"off_domain": F.coalesce("off_domain", F.lit(0)), "consensus": F.coalesce("consensus", F.lit(""))})
    candidate = (F.col("workspaces") >= least) & (F.col("off_domain") == 0)
    route = F.when(candidate, "draft").when(F.col("off_domain") > 0, "blocked-intent").otherwise(F.concat(F.lit("needs-workspaces("), F.col("workspaces").cast("string"), F.lit(f"/{least})")))
    return j.select("task", "workspaces", "steps", F.round(F.col("visual") / F.col("steps"), 4).alias("visual_ratio"), "consensus", "off_domain", candidate.alias("candidate"), (F.col("visual") < 0.5 * F.col("steps")).alias("warning"), route.alias("route"))


def unverified_tokens(steps: DataFrame, limit: int = 20) -> DataFrame:
    """Speech-only steps with exact tokens: the first rows, each with the totals of all."""
    rows = steps.where("evidence = 'speech_only'").select("task", "ws", "id", F.filter("tokens", lambda t: F.trim(t) != "").alias("tokens")).where(F.size("tokens") > 0)
    totals = rows.agg(F.count("*").alias("step_count"), F.sum(F.size("tokens")).cast("long").alias("token_count"))
    first = rows.orderBy("task", "ws", "id").limit(limit).select("task", "ws", "id", F.array_join("tokens", " ").alias("tokens"))
    return first.crossJoin(F.broadcast(totals))  # one row


def group_rollup(spaces: DataFrame, path: str) -> DataFrame:
    """Workspaces by the first segment of their path, with their items."""
    first = F.regexp_extract(path, r"^/?([^/?]+)", 1)
    return spaces.groupBy(F.when(first == "", "(root)").otherwise(first).alias("grp")).agg(F.count("*").alias("workspaces"), F.sum("items").alias("items"))


def stale_workspaces(files: DataFrame, now, keep_days: int) -> DataFrame:
    """Newest change of each workspace (ws, mtime) and its age in days, where that is beyond what is kept."""
    newest = files.groupBy("ws").agg(F.max("mtime").alias("newest"))
    return newest.withColumn("age_days", F.datediff(now, "newest").cast("long")).where(F.col("age_days") > keep_days)


def index_consistency(catalog: DataFrame, indexed: DataFrame) -> DataFrame:
    """By workspace the images in the catalogue and in the index (ws, image), those missing and orphaned, and staleness."""
    j = catalog.select("ws", "image", F.lit(1).alias("_c")).distinct().join(indexed.select("ws", "image", F.lit(1).alias("_i")).distinct(), ["ws", "image"], "full_outer")
    out = j.groupBy("ws").agg(
        F.count("_c").alias("catalog"), F.count("_i").alias("indexed"), F.count_if(F.col("_i").isNull()).alias("missing"), F.count_if(F.col("_c").isNull()).alias("orphaned")
    )
    return out.withColumn("stale", (F.col("missing") > 0) | (F.col("orphaned") > 0))


def published(catalog: DataFrame, indexed: DataFrame, documents: DataFrame) -> DataFrame:
    """The consistency of an index with what its document (ws, declared) says of itself; (ws, doc_present, catalog,
    indexed, declared, missing, orphaned, stale) for each workspace of any of the three.

    Without a document nothing is indexed, and it is stale if the catalogue has images; a document that declares no number, or
    another than the catalogue's, is stale. Of several documents of a workspace the largest number counts.
    """
    doc = documents.groupBy("ws").agg(F.max("declared").cast("long").alias("declared"), F.lit(True).alias("_d"))
    told = indexed.join(doc.select("ws"), "ws", "left_semi")
    counts = index_consistency(catalog, told).drop("stale")
    j = counts.join(doc, "ws", "full_outer")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("catalog", "indexed", "missing", "orphaned")]
    j = j.select("ws", F.coalesce("_d", F.lit(False)).alias("doc_present"), *zero, "declared")
    off = (F.col("missing") > 0) | (F.col("orphaned") > 0) | F.coalesce(F.col("declared") != F.col("catalog"), F.lit(True))
    return j.withColumn("stale", F.when(F.col("doc_present"), off).otherwise(F.col("catalog") > 0))


def backlinks(images: DataFrame, references: DataFrame) -> DataFrame:
    """Checkpoints that refer to each image (ws, image) by its path or its id (ws, ref, id)."""
    by = images.select("ws", "image", F.explode(F.array_distinct(F.array("image", "path"))).alias("ref"))
    j = by.join(references, ["ws", "ref"]).select("ws", "image", "id").distinct()
    return j.groupBy("ws", "image").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("checkpoints"))


def qualified_only(tokens: DataFrame, markers: list[str]) -> DataFrame:
    """Tokens (ws, token, qualified) that occur only qualified, without the markers."""
    t = tokens.where(~F.col("token").isin(*markers)).groupBy("ws", "token").agg(F.bool_and("qualified").alias("only"))
    return t.where("only").select("ws", "token")


def reassigned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slugs (slug, label) that name another label than before."""
    return new.join(old.withColumnRenamed("label", "was"), "slug").where("was <> label").select("slug", "was", "label")


def unseen(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Events whose key the ledger does not have, each key once (its first by seq)."""
    new = events.join(known.select(key).distinct(), key, "left_anti")
    return new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), "seq").alias("_e")).select(key, "_e.*")
