"""The pool of candidate keyframes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates that are no farther apart may be one.
NEAR_MS = 500
SCHEMA = "ws long, t_ms long, weight double, source string, n long"


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One island in the order of insertion: a candidate joins the earliest kept one that is near, or is kept."""
    kept: list[list] = []
    shelf: dict[int, list[int]] = {}
    for t, weight, source in rows.sort_values("n")[["t_ms", "weight", "source"]].itertuples(index=False, name=None):
        cell = t // NEAR_MS
        near = [i for c in (cell - 1, cell, cell + 1) for i in shelf.get(c, ()) if abs(kept[i][0] - t) <= NEAR_MS]
        if near:
            own = kept[min(near)]
            own[1], own[3] = max(own[1], weight), own[3] + 1
            own[2].setdefault(source)
        else:
            shelf.setdefault(cell, []).append(len(kept))
            kept.append([t, weight, {source: None}, 1])
    ws = rows["ws"].iloc[0]
    return pd.DataFrame([(ws, t, w, "+".join(s), n) for t, w, s, n in kept], columns=["ws", "t_ms", "weight", "source", "n"])


def candidates(found: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(ws, t_ms, weight, source, n) of the pool of found (ws, n, t_ms, weight, source), inserted in the order of n.

    Merging follows that order, not time: near is near the kept candidate, which keeps its time, takes the greatest weight and names the
    sources in the order in which they came. What is out of the range goes first. Candidates that a pause of more than NEAR_MS parts can
    never merge, so a workspace is folded in islands of time, each dealt by itself; the insertion order holds within them.
    """
    inside = found.where("t_ms is not null")
    inside = inside if start is None else inside.where(F.col("t_ms") >= start)
    inside = inside if end is None else inside.where(F.col("t_ms") <= end)
    order = W.partitionBy("ws").orderBy("t_ms")
    opens = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > NEAR_MS, F.lit(True)).cast("long")
    islands = inside.withColumn("_o", opens).withColumn("island", F.sum("_o").over(order.rangeBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("ws", "island").applyInPandas(_merged, SCHEMA)
