"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

The leaves are range-sorted by group and key; counts of each (group, range) give every leaf its place. Each
range then builds by itself all nodes whose leaves it holds whole, holding one open run a level. What is
left at its ragged ends, at most two runs a level, is shuffled by coordinate (group, level, run), and the
upper levels are finished from there, one level a step. The same is done over the groups' roots. Runs are
the text of their nodes' digests; a row's proof is the chain of runs above it, joined downwards by coordinate.
Only the number of levels and the root reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, ranked, staged

#: Nodes that one hash joins, and the length of a digest in hexadecimal digits.
ARITY, DIGEST = 16, 64
RUNS = "g string, level int, run long, slot int, nodes string, of long"


class Tree(NamedTuple):
    rows: DataFrame  # the leaves' rows with `at` (place in the group) and `of` (the group's leaves)
    runs: DataFrame  # g, level, run, nodes, of (nodes of the group at this level)
    roots: DataFrame  # g, root
    levels: int  # of the highest tree


def digest(*columns: Column | str) -> Column:
    """SHA-256 of the columns, each `-` if null, else its UTF-8 bytes' count, `:` and the value; hexadecimal."""
    told = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        told.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*told), 256)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted leaves (g, at, of, leaf), whole or as far as these leaves go, at every level; of = 1 is a root."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
    out: list[tuple] = []
    held: list[tuple[int, list[str], int]] = []  # at each level the first place, the nodes and the level's size
    group, due = None, 0

    def close(level: int) -> None:
        first, nodes, of = held[level]
        held[level] = (0, [], 0)
        if not nodes:
            return
        text = "".join(nodes)
        out.append((group, level, first // ARITY, first % ARITY, text, of))
        if first % ARITY == 0 and len(nodes) == min(ARITY, of - first):
            push(level + 1, first // ARITY, -(-of // ARITY), hashlib.sha256(text.encode()).hexdigest())

    def push(level: int, at: int, of: int, node: str) -> None:
        if of == 1:
            out.append((group, level, 0, 0, node, 1))
            return
        if len(held) <= level:
            held.append((0, [], 0))
        first, nodes, _ = held[level]
        if nodes and first + len(nodes) != at:
            close(level)
            first, nodes, _ = held[level]
        if not nodes:
            held[level] = (at, nodes := [], of)
        nodes.append(node)
        if at % ARITY == ARITY - 1 or at == of - 1:
            close(level)

    def end() -> None:
        for level in range(len(held) + 1):  # closing a run may open one above
            if level < len(held):
                close(level)

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for g, at, of, leaf in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if g != group or at != due:
                end()
                group = g
            due = at + 1
            push(0, at, of, leaf)
        if out:
            yield told()
    end()
    if out:
        yield told()


def tree(leaves: DataFrame, by: list) -> Tree:
    """The tree of each group g of leaves (g, leaf, ..), its leaves in the order of `by`."""
    rows, ranges = ranked(leaves, by)
    placed = rows.join(ranges, ["g", "_part"]).withColumn("at", F.col("before_n") + F.col("_row") - F.col("_first"))
    placed = placed.select(*leaves.columns, "at", F.col("all_n").alias("of"))
    # a broadcast of the ranges keeps the order, a shuffle by (g, range) does not
    found = staged(placed.select("g", "at", "of", "leaf").sortWithinPartitions("g", "at").mapInArrow(_local, RUNS), "runs")
    wide = F.least(F.lit(ARITY), F.col("of") - F.col("run") * ARITY)
    whole = (F.col("slot") == 0) & (F.length("nodes") == wide * DIGEST)
    roots = found.where("of = 1").select("g", F.col("nodes").alias("root"))
    runs = found.where(F.col("of") > 1).where(whole).select("g", "level", "run", "nodes", "of")
    ragged = found.where(F.col("of") > 1).where(~whole)
    most, levels = ranges.agg(F.max("all_n")).collect()[0][0] or 0, 0
    while most > 1:
        most, levels = -(-most // ARITY), levels + 1
    up = None
    for level in range(levels):
        ends = ragged.where(F.col("level") == level).select("g", "run", "slot", "nodes", "of")
        ends = ends.unionByName(up) if up is not None else ends
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "nodes"))), lambda x: x["nodes"]), "")
        done = ends.groupBy("g", "run").agg(joined.alias("nodes"), F.max("of").alias("of"))
        done = staged(done.select("g", F.lit(level).alias("level"), "run", "nodes", "of"), "boundary")
        runs = runs.unionByName(done)
        up = done.select("g", (F.col("run") / ARITY).cast("long").alias("run"), (F.col("run") % ARITY).cast("int").alias("slot"), F.sha2("nodes", 256).alias("nodes"), F.ceil(F.col("of") / ARITY).cast("long").alias("of"))
        roots = roots.unionByName(up.where("of = 1").select("g", F.col("nodes").alias("root")))
        up = up.where("of > 1")
    return Tree(placed, runs, roots, levels)


def proved(t: Tree, above: DataFrame) -> DataFrame:
    """The rows of a tree with `group_root` and `path`: the runs from the leaf's own up to the group's root, and
    from there what `above` (g, path) holds; each with the slot of what comes from below."""
    step = lambda at: F.array(F.struct((F.col(at) % ARITY).cast("int").alias("slot"), F.col("nodes")))
    upper = None
    for level in reversed(range(t.levels)):
        here = t.runs.where(F.col("level") == level).select("g", "run", "nodes", "of")
        chain = here.where(F.col("of") <= ARITY).join(above, "g").select("g", "run", "nodes", F.sha2("nodes", 256).alias("group_root"), "path")
        if upper is not None:
            low = here.where(F.col("of") > ARITY).select("g", F.col("run").alias("at"), (F.col("run") / ARITY).cast("long").alias("run"), F.col("nodes").alias("own"))
            low = low.join(upper, ["g", "run"]).select("g", F.col("at").alias("run"), F.col("own").alias("nodes"), "group_root", F.concat(step("at"), "path").alias("path"))
            chain = chain.unionByName(low)
        upper = chain
    alone = t.rows.where("of = 1").join(above, "g").withColumn("group_root", F.col("leaf"))
    if upper is None:
        return alone
    many = t.rows.where("of > 1").withColumn("run", (F.col("at") / ARITY).cast("long")).join(upper, ["g", "run"])
    return many.withColumn("path", F.concat(step("at"), "path")).drop("run", "nodes").unionByName(alone)


def folded(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and the siblings on its path give."""
    put = lambda node, x: F.sha2(F.overlay(x["nodes"], node, x["slot"] * DIGEST + 1, F.lit(DIGEST)), 256)
    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, put)


def siblings(path: Column | str = "path") -> Column:
    """The digests beside a leaf's path, from the leaf's run to the root's, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.overlay(x["nodes"], F.lit(""), x["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def manifest(leaves: DataFrame, group: str, by: list[str], leaf: str = "leaf") -> DataFrame:
    """leaves (group, by.., leaf and others) with at, of, group_root, path and root; columns of these names are replaced.

    Leaves of a group ascend by the columns `by` (null first), equal ones by their digest; groups ascend by name, the
    null group first. Equal rows are leaves of their own; of an empty table the manifest is empty.
    """
    made = ["at", "of", "group_root", "path", "root"]
    names, columns = plain(leaves, leaf, *made)
    named = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"), F.col(f"`{leaf}`").alias("leaf"), *columns)
    named = staged(named, "leaves")  # the range sort reads its input twice
    low = tree(named, [*(f"c{names.index(c)}" for c in by), "leaf"])
    tops = low.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("leaf"))
    high = tree(tops, ["name"])
    root = high.roots.collect()
    empty = leaves.sparkSession.createDataFrame([("", [])], "g string, path array<struct<slot:int,nodes:string>>")
    above = staged(proved(high, empty).select(F.col("name").alias("g"), "path"), "tops")
    rows = proved(low, above).withColumn("root", F.lit(root[0].root if root else None).cast("string"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("leaf").alias(leaf), *made)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that a tampered text folds to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    capital = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate("text", capital, capital.lower())
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, digest(*fields, lower))
    leaves = docs.select("doc_id", "source", digest(*fields, "text").alias("leaf"), tampered.alias("tampered"))
    rows = manifest(leaves, "source", ["doc_id"])
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", F.col("group_root").alias("subroot"), "root", F.sha2(siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
