"""Authored text in generated files, and names under which it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written

#: White space at both ends that does not count.
SPACE = " \t\n\x0b\x0c\r"


def authored(text: str | Column, start: str, end: str, template: str) -> Column:
    """Whether the block between the first start marker and the next end marker says something other than the template;
    false without both markers, null for null."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.instr(text, F.lit(start))
    rest = F.substring(text, at + F.lit(len(start)), F.length(text))
    to = F.instr(rest, F.lit(end))
    block = F.btrim(F.substring(rest, F.lit(1), to - 1), F.lit(SPACE))
    return F.when(text.isNull(), F.lit(None)).otherwise((at > 0) & (to > 0) & (block != template.strip(SPACE))).cast("boolean")


def block(text: str | Column, start: str, end: str, template: str) -> Column:
    """What stands between the first start marker and the next end marker, the template where there is no such block."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.instr(text, F.lit(start))
    rest = F.substring(text, at + F.lit(len(start)), F.length(text))
    to = F.instr(rest, F.lit(end))
    return F.when((at > 0) & (to > 0), F.substring(rest, F.lit(1), to - 1)).otherwise(F.lit(template))


def head(block: str | Column, heading: str) -> Column:
    """The first line of the section `## heading` that is neither empty nor wholly in parentheses; else null."""
    block = F.col(block) if isinstance(block, str) else block
    mark = f"## {heading}\n"
    at = F.instr(block, F.lit(mark))
    section = F.split(F.substring(block, at + F.lit(len(mark)), F.length(block)), "\n##", 2)[0]
    lines = F.transform(F.split(section, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    told = F.filter(lines, lambda x: (x != "") & ~x.startswith("("))
    return F.when(at > 0, F.get(told, F.lit(0)))


def numbered(name: Column, slot: Column) -> Column:
    """The name of a slot: the plain name for 1, else `stem--slot.suffix`; a leading or closing point makes no suffix."""
    suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.when(slot == 1, name).otherwise(F.concat(stem, F.lit("--"), slot.cast("string"), suffix))


def slots(files: DataFrame) -> DataFrame:
    """files with (base, slot): each file as slot 1 of its own name and, called `stem--n.suffix` with n from 2 on and without
    leading zeros, as slot n of `stem.suffix`."""
    n = F.regexp_extract("name", r"--([2-9]|[1-9][0-9]{1,17})(\.[^.]+)?$", 1)
    other = files.where(n != "").withColumns({"base": F.regexp_replace("name", r"--[0-9]+(\.[^.]+)?$", "$1"), "slot": n.cast("long")})
    other = other.where(numbered(F.col("base"), F.col("slot")) == F.col("name"))
    return files.withColumns({"base": F.col("name"), "slot": F.lit(1).cast("long")}).unionByName(other)


def kept_names(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """(ws, name, n, target, moved), where each source (ws, name, n, digest; n orders those of one name) goes.

    A source is offered the slots of its name one after another and takes the first that is free (moved) or holds its digest
    already among existing (ws, name, digest); sources before it count as existing. The order matters, as each move closes
    a gap and so shows files behind it: a file behind g gaps is met only after g moves. So there is no walk: a digest's first
    source is free of its repeats, its file (if any) has its count of gaps, and the moves before a source are a running count,
    folded over the sources with a file alone, as numbers. A slot is then the place of the k-th gap among the files.

    Names of a ws are independent: a source whose name is itself `stem--n` does not see a move of `stem` in the same call.
    Null ws, name or digest are values of their own; sources of equal n are taken in the order of their digests.
    """
    key = ["ws", "base"]
    src = sources.select("ws", F.col("name").alias("base"), "n", "digest")
    bases = src.select(*key).distinct()
    files = slots(existing.select("ws", "name", "digest")).select("ws", "base", "slot", "digest")
    files = files.alias("f").join(bases.alias("b"), F.col("f.ws").eqNullSafe(F.col("b.ws")) & F.col("f.base").eqNullSafe(F.col("b.base")), "left_semi")
    at = W.partitionBy(*key).orderBy("slot")
    files = files.withColumn("gaps", F.col("slot") - F.row_number().over(at))  # free slots below this one
    held = files.groupBy(*key, "digest").agg(F.min_by(F.struct("slot", "gaps"), "slot").alias("own"))
    first = src.groupBy(*key, "digest").agg(F.min("n").alias("first"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*key, "digest")]
    first = first.alias("s").join(held.alias("h"), same[0] & same[1] & same[2], "left").select("s.*", "h.own")
    order = W.partitionBy(*key).orderBy(F.col("first").asc_nulls_first(), F.col("digest").asc_nulls_first())
    before = F.sum(F.when(F.col("own").isNull(), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    first = first.withColumns({"place": F.row_number().over(order).cast("long"), "sure": F.coalesce(before, F.lit(0)).cast("long")})
    first = written(first, "kept-first")
    # moves of sources that have a file somewhere: the one with g gaps before it moves if fewer moves came before
    known = first.where("own is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "sure", F.col("own.gaps").alias("gaps")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("extra"), F.array().cast("array<struct<place:long,after:long>>").alias("steps"))

    def step(s, x):
        moved = x["gaps"] > x["sure"] + s["extra"]
        extra = s["extra"] + moved.cast("long")
        return F.struct(extra.alias("extra"), F.when(moved, F.concat(s["steps"], F.array(F.struct(x["place"].alias("place"), extra.alias("after"))))).otherwise(s["steps"]).alias("steps"))

    steps = known.select(*key, F.explode(F.aggregate("all", start, step)["steps"]).alias("x")).select(*key, "x.place", "x.after")
    same = F.col("f.ws").eqNullSafe(F.col("x.ws")) & F.col("f.base").eqNullSafe(F.col("x.base")) & (F.col("f.place") == F.col("x.place"))
    first = first.alias("f").join(steps.alias("x"), same, "left").select("f.*", "x.after")
    order = W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    extra = F.coalesce(F.max("after").over(order), F.lit(0))
    moved = F.col("own").isNull() | F.col("after").isNotNull()
    first = first.withColumns({"moved": moved, "k": F.when(moved, F.col("sure") + extra + F.when(F.col("own").isNull(), 1).otherwise(0))})
    first = written(first, "kept-moves")
    # the k-th free slot is k and as many more as files have fewer than k gaps below them
    marks = files.select(*key, (F.col("gaps") + 1).alias("k"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("digest"))
    asked = first.where("moved").select(*key, "k", F.lit(1).alias("kind"), "digest")
    run = W.partitionBy(*key).orderBy("k", "kind").rowsBetween(W.unboundedPreceding, 0)
    free = marks.union(asked).withColumn("slot", F.col("k") + F.sum(1 - F.col("kind")).over(run)).where("kind = 1")
    got = first.where("not moved").select(*key, "digest", F.col("own.slot").alias("slot"), F.lit(None).cast(src.schema["n"].dataType).alias("first"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"x.{c}")) for c in (*key, "digest")]
    taken = free.alias("f").join(first.where("moved").alias("x"), same[0] & same[1] & same[2]).select("f.ws", "f.base", "f.digest", "f.slot", "x.first")
    taken = taken.withColumn("new", F.lit(True)).unionByName(got.withColumn("new", F.lit(False)))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*key, "digest")]
    placed = src.alias("s").join(taken.alias("t"), same[0] & same[1] & same[2])
    once = F.row_number().over(W.partitionBy("s.ws", "s.base", "s.digest").orderBy(F.col("s.n").asc_nulls_first())) == 1
    return placed.select("s.ws", F.col("s.base").alias("name"), "s.n", numbered(F.col("s.base"), F.col("slot")).alias("target"), (F.col("new") & once).alias("moved"))
