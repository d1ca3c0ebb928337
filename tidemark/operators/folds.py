"""Order-dependent folds: each depends on what it has kept so far, so it runs group by group over sorted rows."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


def scene_gap(hits: DataFrame, least_ms: int = 1000) -> DataFrame:
    """Of hits within a second the strongest; the anchor moves to the survivor. (ws, t_ms, score)"""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, float]] = []
        for t, s in g.sort_values("t_ms")[["t_ms", "score"]].itertuples(index=False):
            if not kept or t - kept[-1][0] >= least_ms:
                kept.append((t, s))
            elif s > kept[-1][1]:
                kept[-1] = (t, s)
        return pd.DataFrame({"ws": [g["ws"].iloc[0]] * len(kept), "t_ms": [k[0] for k in kept], "score": [k[1] for k in kept]})

    return hits.select("ws", "t_ms", "score").groupBy("ws").applyInPandas(fold, "ws string, t_ms long, score double")


def lanes(spans: DataFrame) -> DataFrame:
    """The smallest free lane for each span in order of start. (ws, id, lane)"""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        free: list[int] = []
        busy: list[tuple[int, int]] = []
        lane, top = [], 0
        g = g.sort_values(["start_us", "end_us", "id"])
        for s, e in g[["start_us", "end_us"]].itertuples(index=False):
            while busy and busy[0][0] <= s:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                at = heapq.heappop(free)
            else:
                at, top = top, top + 1
            heapq.heappush(busy, (e, at))
            lane.append(at)
        return pd.DataFrame({"ws": g["ws"], "id": g["id"], "lane": lane})

    return spans.select("ws", "id", "start_us", "end_us").groupBy("ws").applyInPandas(fold, "ws long, id string, lane long")


def keyframes(candidates: DataFrame, budget: int, ideal_ms: int, least_ms: int) -> DataFrame:
    """Greedy choice by weight plus half the distance to what is chosen (capped at ideal); ties to the earlier."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(g["t_ms"], g["score"], strict=True))
        near = [float("inf")] * len(rows)
        chosen: list[tuple[int, float]] = []
        while len(chosen) < budget:
            best, at = None, -1
            for i, (_, w) in enumerate(rows):
                if near[i] >= least_ms:
                    v = w + 0.5 * min(near[i] / ideal_ms, 1.0)
                    if best is None or v > best:
                        best, at = v, i
            if at < 0:
                break
            chosen.append(rows[at])
            near = [min(n, abs(r[0] - rows[at][0])) for n, r in zip(near, rows, strict=True)]
        return pd.DataFrame({"ws": [g["ws"].iloc[0]] * len(chosen), "pick": range(len(chosen)), "t_ms": [c[0] for c in chosen], "score": [c[1] for c in chosen]})

    return candidates.select("ws", "t_ms", "score").groupBy("ws").applyInPandas(fold, "ws string, pick long, t_ms long, score double")


def rolling(cues: DataFrame, most_ms: int = 12_000) -> DataFrame:
    """Cues whose beginning repeats the end of the one before lose the repeat; empty rests extend it."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for s, e, t in g.sort_values(["start_ms", "id"])[["start_ms", "end_ms", "text"]].itertuples(index=False):
            words = t.split()
            if out:
                last = out[-1][2]
                k = next((n for n in range(min(len(last), len(words)), 0, -1) if last[-n:] == words[:n]), 0)
                rest = words[k:]
                if k and e - out[-1][0] <= most_ms:
                    out[-1][1] = max(out[-1][1], e)
                    out[-1][2] = last + rest
                    continue
                words = rest
            if words:
                out.append([s, e, words])
        return pd.DataFrame({"ws": [g["ws"].iloc[0]] * len(out), "start_ms": [o[0] for o in out], "end_ms": [o[1] for o in out], "text": [" ".join(o[2]) for o in out]})

    return cues.select("ws", "id", "start_ms", "end_ms", "text").groupBy("ws").applyInPandas(fold, "ws long, start_ms long, end_ms long, text string")


def trigger_alignment(log: DataFrame, top: int = 3) -> DataFrame:
    """For each change of a hypothesis to a terminal status, whether it was among the open ones most in doubt."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        open_: dict[str, tuple[float, int]] = {}
        n = hit = 0
        for i, st, c, s in g.sort_values(["start_us", "id", "line_no"])[["id", "status", "confidence", "start_us"]].itertuples(index=False):
            if st == "hypothesized":
                open_[i] = (c if c == c and c is not None else 0.0, s)
            elif i in open_:
                queue = heapq.nsmallest(top, open_.items(), key=lambda x: (x[1][0], x[1][1], x[0]))
                n += 1
                hit += any(k == i for k, _ in queue)
                del open_[i]
        return pd.DataFrame({"ws": [g["ws"].iloc[0]], "transitions": [n], "aligned": [hit]})

    return log.select("ws", "id", "line_no", "status", "confidence", "start_us").groupBy("ws").applyInPandas(fold, "ws long, transitions long, aligned long")
