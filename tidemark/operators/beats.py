"""Cuts on a beat grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The shortest cut that a snap may leave.
LEAST_MS = 50
MOVED = "seq long, ord long, start_ms long, end_ms long, delta_ms long, snapped boolean, reason string"


def nearest(beats: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The beats nearest to the times t, the earlier of two; beats ascend and are not empty."""
    after = np.searchsorted(beats, t)
    low, high = beats[np.maximum(after - 1, 0)], beats[np.minimum(after, len(beats) - 1)]
    return np.where(np.abs(low - t) <= np.abs(high - t), low, high)


def _moved(cuts: pd.DataFrame, beats: pd.DataFrame) -> pd.DataFrame:
    """All sequences of a part side by side, a cut of each at a time, as each join follows from those before it."""
    cuts = cuts.sort_values(["seq", "ord"], ignore_index=True)
    grid = np.sort(beats["beat_ms"].to_numpy())
    start, end, most = (cuts[c].to_numpy() for c in ("start_ms", "end_ms", "duration_ms"))
    at, size = cuts.groupby("seq").cumcount().to_numpy(), cuts.groupby("seq")["ord"].transform("size").to_numpy()
    delta, reason = np.zeros(len(cuts), np.int64), np.full(len(cuts), None, object)
    heads = np.flatnonzero(at == 0)
    elapsed, lengths = np.zeros(len(heads), np.int64), size[heads]
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(lengths > k)
        rows = heads[live] + k
        joint = elapsed[live] + end[rows] - start[rows]
        move = nearest(grid, joint) - joint if len(grid) else np.zeros(len(rows), np.int64)
        bad = (end[rows] + move - start[rows] < LEAST_MS) | (end[rows] + move > most[rows])
        last = at[rows] == size[rows] - 1
        why = np.where(last, "tail-cut", np.where(bad, "span-bounds", None)) if len(grid) else np.where(last, "tail-cut", "no-beats")
        delta[rows] = np.where(last | bad, 0, move)
        reason[rows] = why
        elapsed[live] = joint + delta[rows]
    out = cuts[["seq", "ord", "start_ms"]].copy()
    out["end_ms"], out["delta_ms"], out["snapped"], out["reason"] = end + delta, delta, [r is None for r in reason], reason
    return out


def snapped(cuts: DataFrame, beats: DataFrame) -> DataFrame:
    """Cuts (seq, ord, start_ms, end_ms, duration_ms, grid) with ends moved so that joins fall on beats (grid, beat_ms).

    From a sequence's first cut on, each tail moves to the beat nearest to its join, and all that follows moves with it; a
    cut that would become too short or leave the media stays, and so does the last. Sequences of a grid are dealt by their
    key to as many parts as there are shuffle partitions, each of which meets the grid once; without beats nothing moves.
    """
    n = int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cuts.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int"))
    copies = beats.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.groupBy("grid", "part").cogroup(copies.groupBy("grid", "part")).applyInPandas(_moved, MOVED)
