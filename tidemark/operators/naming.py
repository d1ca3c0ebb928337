"""Labels that may mean the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Similarity of two labels' tokens from which they may mean the same, as a fraction.
NUM, DEN = 1, 2


def similar(labels: DataFrame) -> DataFrame:
    """(a, b), a < b: labels (label, distinct) whose token sets have a Jaccard similarity of NUM / DEN or more.

    Tokens are words outside parentheses, or the label itself if there are none. Two such labels share one of the
    rarest size - least overlap + 1 tokens of each, and their sizes are near; only pairs that share one of these and fit in
    size are compared, so a frequent word joins nothing that a rare one does not.
    """
    words = F.filter(F.split(F.regexp_replace("label", r"\([^)]*\)", " "), r"\s+"), lambda w: w != "")
    own = labels.select("label", F.array_distinct(words).alias("t"))
    own = written(own.select("label", F.when(F.size("t") > 0, F.col("t")).otherwise(F.array("label")).alias("t")), "labels")
    each = own.select("label", F.explode("t").alias("w"))
    ranked = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    size = F.size("r")
    least = F.floor((size * NUM + DEN - 1) / DEN).cast("int")  # the least overlap with any partner
    keys = ranked.select("label", F.transform("r", lambda x: x["w"]).alias("t"), F.explode(F.slice("r", F.lit(1), size - least + 1)).alias("k"))
    keys = written(keys.select("label", "t", F.col("k.w").alias("w")), "prefixes")
    near = keys.alias("x").join(keys.alias("y"), "w").where("x.label < y.label").where((F.size("x.t") * DEN >= F.size("y.t") * NUM) & (F.size("y.t") * DEN >= F.size("x.t") * NUM))
    both = F.size(F.array_intersect("x.t", "y.t"))
    enough = both * DEN >= (F.size("x.t") + F.size("y.t") - both) * NUM
    return near.where(enough).select(F.col("x.label").alias("a"), F.col("y.label").alias("b")).distinct()


def alias_groups(labels: DataFrame) -> DataFrame:
    """(leader, label) of labels in groups of two or more, by the order of labels: the first label that belongs to no
    group takes all later free ones that are similar to it.

    Not components: a member brings nobody in. Leaders are the first maximal independent set in the order: a label whose smaller
    neighbours are all members leads, one with a leader among them is a member. Each round decides all labels whose smaller
    neighbours are decided, and is written; the driver learns only whether any is left.
    """
    pairs = written(similar(labels), "similar")
    open_ = pairs.select(F.col("a").alias("label")).union(pairs.select(F.col("b").alias("label"))).distinct()
    open_, leaders = written(open_, "open"), None
    while not open_.isEmpty():
        # the label that no open smaller neighbour precedes leads; all its open neighbours are members
        live = pairs.join(open_.withColumnRenamed("label", "a"), "a", "left_semi").join(open_.withColumnRenamed("label", "b"), "b", "left_semi")
        first = written(open_.join(live.select(F.col("b").alias("label")), "label", "left_anti"), "leaders")
        leaders = first if leaders is None else leaders.union(first)
        taken = live.join(first.withColumnRenamed("label", "a"), "a", "left_semi").select(F.col("b").alias("label"))
        open_ = written(open_.join(first.union(taken), "label", "left_anti"), "open")
    if leaders is None:
        return labels.sparkSession.createDataFrame([], "leader string, label string")
    found = pairs.join(leaders.withColumnRenamed("label", "a"), "a", "left_semi").join(leaders.withColumnRenamed("label", "b"), "b", "left_anti")
    members = found.groupBy("b").agg(F.min("a").alias("leader")).select("leader", F.col("b").alias("label"))
    return members.union(members.select("leader", F.col("leader").alias("label")).distinct())
