"""Keyed state over arriving rows: the order of arrival counts, not the time that a row tells.

Each operator keeps one small state a key, reads a micro-batch's rows of a key in the order of its columns `by`, and emits what
changed (update mode), with a version that grows, so that the greatest version of a key is its state (`current`).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import TERMINAL
from ..operators.signals import MERGE_MS, TAIL_MS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Hands the rows of a key on in the order of their arrival, as tuples of `columns`."""

    by: list[str]
    columns: list[str]
    made: list[str]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        every = pd.concat(list(rows)).sort_values(self.by)
        out = self.turned(key, every[self.columns].itertuples(index=False, name=None))
        yield pd.DataFrame(out, columns=self.made)

    def turned(self, key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Merged(_Ordered):
    by, columns, made = ["t_ms", "label"], ["t_ms", "label"], ["ws", "event", "label", "start_ms", "end_ms", "n"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event long, label string, start_ms long, end_ms long, n long")

    def turned(self, key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        open_ = tuple(self.last.get()) if self.last.exists() else (0, None, 0, 0, 0)
        done = []
        for t, label in rows:
            event, name, start, end, n = open_
            if n and name == label and t - end <= MERGE_MS:
                open_ = (event, name, start, int(t) + TAIL_MS, n + 1)
            else:
                if n:
                    done.append((*key, *open_))
                open_ = (event + 1, label, int(t), int(t) + TAIL_MS, 1)
        self.last.update(open_)
        return [*done, (*key, *open_)]


class _Latest(_Ordered):
    by, columns = ["line_no"], ["line_no", "status", "start_us", "end_us", "confidence"]
    made = ["ws", "id", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "yes boolean")

    def turned(self, key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        ended, last = self.ended.exists(), None
        for row in rows:
            if row[1] in TERMINAL:
                ended, last = True, row
            elif not ended:
                last = row
        if ended:
            self.ended.update((True,))
        return [(*key, *last)] if last else []


class _Aligned(_Ordered):
    by, columns, made = ["start_us", "id", "line_no"], ["id", "status", "confidence", "start_us"], ["ws", "rows", "transitions", "aligned"]

    def __init__(self, top: int):
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "id string", "doubt double, start_us long")
        self.counts = handle.getValueState("counts", "n long, transitions long, aligned long")

    def turned(self, key: tuple, rows: Iterator[tuple]) -> list[tuple]:
        before = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        now = dict(before)
        n, transitions, aligned = tuple(self.counts.get()) if self.counts.exists() else (0, 0, 0)
        for i, status, doubt, start in rows:
            n += 1
            if status == "hypothesized":
                now[i] = (float(doubt) if doubt == doubt and doubt is not None else 0.0, int(start))
            elif i in now:
                first = heapq.nsmallest(self.top, now.items(), key=lambda x: (x[1], x[0]))
                transitions, aligned = transitions + 1, aligned + any(k == i for k, _ in first)
                del now[i]
        for i in before.keys() - now.keys():
            self.open.removeKey((i,))
        for i, v in now.items():
            if before.get(i) != v:
                self.open.updateValue((i,), v)
        self.counts.update((n, transitions, aligned))
        return [(*key, n, transitions, aligned)]


def _run(stream: DataFrame, by: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(*by).transformWithStateInPandas(processor, schema, "Update", "None")


def merged(hits: DataFrame) -> DataFrame:
    """Label hits (ws, t_ms, label) merged with the last event only; the state of a workspace is that event."""
    return _run(hits, ["ws"], _Merged(), "ws string, event long, label string, start_ms long, end_ms long, n long")


def latest(log: DataFrame) -> DataFrame:
    """The last accepted row of each id (ws, id, line_no, status, ..); the state of an id is whether it came to its end."""
    return _run(log, ["ws", "id"], _Latest(), "ws long, id string, line_no long, status string, start_us long, end_us long, confidence double")


def aligned(log: DataFrame, top: int = 3) -> DataFrame:
    """Changes to a terminal status, and how many were among the open hypotheses most in doubt; the state of a
    workspace is its open hypotheses."""
    return _run(log, ["ws"], _Aligned(top), "ws long, rows long, transitions long, aligned long")


def changes(stream: DataFrame, at: str, checkpoint: str) -> None:
    """Writes a stream's changes of what is there now, a folder an epoch: a batch that is tried again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/epoch={epoch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def current(spark: SparkSession, at: str, keys: list[str], version: str) -> DataFrame:
    """The greatest version of each key in a folder of changes."""
    rows = spark.read.parquet(at).drop("epoch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")
