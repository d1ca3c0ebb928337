"""Best-fit packing by patterns of few documents, fitted to the length histogram.

The plan depends on the histogram of piece lengths alone, which has at most `limit` bins whatever the
input: patterns of two and three lengths that fill a sequence exactly get repeat counts by non-negative
least squares, the counts are rounded down to what is there, and the residual histogram is packed
best-fit decreasing, a run of equal sequences at a time. Where best-fit decreasing alone needs fewer
sequences, its plan is taken. Pieces then find their place by their rank among those of their length.
Ranks come from salted counts, so that a length with a third of all pieces is spread over many tasks;
the plan and the counts are the only broadcasts (bounds below).
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, default_path
from .common import staged

#: Groups that each length is dealt into for ranking, and patterns in a plan at most. A plan has a row for each
#: length of a pattern and for each change of length in a residual sequence; cut at the groups' ends it has
#: limit * SALTS rows more. With 2048 lengths all in use that is under 200,000 rows of 48 bytes, at any input.
SALTS, PATTERNS = 64, 8192
#: Shares of the fitted counts that are tried; none of them is best-fit decreasing alone.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.3, 0.15, 0.05, 0.0)


def pieces(df: DataFrame, path: str, limit: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document, whose ids are cut after each `limit`.

    A null text is an empty one; each document ends with the id `end`, so even an empty one has a piece.
    Repeated rows yield repeated pieces. Texts are encoded in one pass without a shuffle.
    """
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                rows = []
                coded = codec(path).encode_batch([x or "" for x in b.column("text").to_pylist()])
                for k, ids in zip(b.column("key").to_pylist(), coded, strict=True):
                    ids += tail
                    for i in range(0, len(ids), 4 * limit):
                        part = ids[i : i + 4 * limit]
                        rows.append((k, i // 4 // limit, i // 4, len(part) // 4, binascii.crc32(part)))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(list(zip(names, kinds, strict=True))))

    names = [key, "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"{key} long, piece int, start long, length long, ids_crc32 long"
    )


def patterns(limit: int, there: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of lengths that are there and fill a sequence exactly; c = 0 for pairs."""
    a = np.flatnonzero(there)
    a = a[(a > 0) & (a < limit)]
    x, y = np.meshgrid(a, a, indexing="ij")
    x, y = x[x >= y], y[x >= y]
    z = limit - x - y
    ok = (z >= 0) & (z <= y)
    x, y, z = x[ok], y[ok], z[ok]
    ok = (z == 0) | there[z]
    return np.stack([x[ok], y[ok], z[ok]], axis=1)


def fitted(pats: np.ndarray, hist: np.ndarray, rounds: int, close: float = 1e-9) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |sum of patterns - histogram|^2, by accelerated projected gradients.

    Ends when x is optimal up to `close` of the histogram's square (no gradient to descend along), or after so many rounds.
    """
    n, p = len(hist), len(pats)
    if not p:
        return np.zeros(0)
    flat = pats.ravel()
    target = hist.astype(float).copy()
    target[0] = 0

    def apply(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, np.repeat(x, 3), n)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return r[pats].sum(axis=1) - r[0] * (pats == 0).sum(axis=1)

    step = np.ones(p)  # the largest eigenvalue of the normal matrix, by power iteration
    for _ in range(12):
        step = back(apply(step))
        top = np.linalg.norm(step)
        step /= top
    x = z = np.zeros(p)
    t = 1.0
    for k in range(rounds):
        slope = back(apply(z) - target)
        new = np.maximum(0, z - slope / (top * 1.02))
        if (slope * (new - x)).sum() > 0:  # the momentum leads uphill: begin anew
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = new, new + (t - 1) / t2 * (new - x), t2
        if k % 25 == 24:
            slope = back(apply(x) - target)
            if abs((x * slope).sum()) + x.sum() * max(0.0, -slope.min()) <= close * (target * target).sum():
                break
    return x


#: (length, first rank, ranks, first sequence, offset, pieces a sequence)
Row = tuple[int, int, int, int, int, int]


def best_fit(left: np.ndarray, used: np.ndarray, limit: int, sequence: int) -> tuple[list[Row], int]:
    """Rows that place what is left of each length best-fit decreasing, from a sequence number on, and the next number.

    Sequences with one remaining room are held as ranges, so that a step places a piece in a whole range.
    """
    rows: list[Row] = []
    open_: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
    some = np.zeros(limit + 1, bool)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_[room].append((first, n))
            some[room] = True

    for v in np.flatnonzero(left)[::-1].tolist():
        rank, c = int(used[v]), int(left[v])
        while c:
            room = v + int(np.argmax(some[v:]))
            if some[room]:
                first, n = open_[room].pop()
                some[room] = bool(open_[room])
            else:  # none has room: new ones
                room, first, n = limit, sequence, -(-c // (limit // v))
                sequence += n
            k = room // v
            for per, m in ((k, min(n, c // k)), (c % k, 1)):
                if n and per and m and c:
                    rows.append((v, rank, per * m, first, limit - room, per))
                    put(room - per * v, first, m)
                    rank, c, first, n = rank + per * m, c - per * m, first + m, n - m
                if n and c >= k:
                    break  # the range is not used up, which only the last pieces leave so
            put(room, first, n)
    return rows, sequence


def plan(hist: np.ndarray, limit: int) -> list[Row]:
    """Rows of the placed pieces of each length by rank: number r, first <= r < first + ranks, goes to sequence
    first sequence + (r - first) // pieces a sequence, behind those of its row that come before it there.

    The fitted counts are taken at several shares, as the residual packs the better the more small pieces it has;
    of the shares that one with the fewest sequences counts, and best-fit decreasing alone only if it beats them all.
    """
    whole = hist.astype(np.int64)
    pats = patterns(limit, (whole > 0) & (np.arange(len(whole)) < limit))
    x = fitted(pats, whole, 75)
    pats = pats[np.argsort(-x, kind="stable")[:PATTERNS]]  # the heaviest, fitted to the end
    x = fitted(pats, whole, 1500)
    heaviest = np.argsort(-x, kind="stable")
    found: tuple[list[Row], int] | None = None
    for share in SHARES:
        left, used, rows, sequence = whole.copy(), np.zeros_like(whole), [], 0
        for i in heaviest:
            if x[i] * share < 1:
                break
            lengths, counts = np.unique(pats[i][pats[i] > 0], return_counts=True)
            times = min(int(x[i] * share + 1e-6), *(int(left[v]) // int(c) for v, c in zip(lengths, counts, strict=True)))
            if times < 1:
                continue
            offset = 0
            for v, c in zip(lengths.tolist(), counts.tolist(), strict=True):
                rows.append((v, int(used[v]), times * c, sequence, offset, c))
                used[v] += times * c
                left[v] -= times * c
                offset += v * c
            sequence += times
        rest, total = best_fit(left, used, limit, sequence)
        if found is None or total < found[1]:
            found = rows + rest, total
        if total * limit < (whole * np.arange(len(whole))).sum() + limit:
            break  # no plan has fewer
    return found[0]


def pack(cut: DataFrame, limit: int = 2048) -> DataFrame:
    """Pieces (with a column length, 1 to limit) plus sequence_id and offset.

    The pieces must be a stored table: it is read for the histogram and again for the ranks. Other
    columns of orderable types pass through, but columns sequence_id and offset are replaced and names that
    begin with an underscore are taken. Pieces of one length are interchangeable, so ties are free; repeated
    rows are separate pieces; no pieces give no rows. A length that is null, below 1 or above the limit is an error.
    """
    spark = cut.sparkSession
    order = [c for c in cut.columns if c.lower() not in ("sequence_id", "offset")]
    salted = cut.select(*order).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    wrong = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > limit)
    if not cut.where(wrong).isEmpty():
        raise ValueError(f"lengths must be from 1 to {limit}")
    counts = salted.groupBy("length", "_salt").count().collect()  # at most limit * SALTS rows
    table = np.zeros((limit + 1, SALTS), np.int64)
    for r in counts:
        table[r.length, r._salt] = r["count"]
    rows = plan(table.sum(axis=1), limit)
    before = np.cumsum(table, axis=1) - table
    # each (length, salt) has ranks before .. before + count: the stretches of the plan that these meet
    by: dict[int, list[Row]] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    spread: list[list[int]] = []
    for v, of in by.items():
        firsts, ends = np.array([r[1] for r in of]), np.array([r[1] + r[2] for r in of])
        by_first = np.argsort(firsts)
        firsts, ends = firsts[by_first], ends[by_first]
        for s in np.flatnonzero(table[v]).tolist():
            lo, hi = int(before[v, s]), int(before[v, s] + table[v, s])
            for k in range(int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(firsts, hi))):
                _, first, n, sequence, offset, per = of[by_first[k]]
                a, b = max(lo, first), min(hi, first + n)
                spread.append([v, s, a - lo, b - lo, sequence, a - first, per, offset])
    names = ["_length", "_s", "_from", "_to", "_seq", "_skip", "_per", "_offset"]
    there = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in np.array(spread, np.int64).reshape(-1, len(names)).T], names=names))
    # ranks of one (length, salt): a running number within it, dealt by both
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)).cast("long") - 1)
    # the plan's size is bounded by the histogram's, not by the input (above)
    placed = ranked.join(F.broadcast(there), (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from") + F.col("_skip")
    sequence = F.col("_seq") + F.floor(nth / F.col("_per")).cast("long")
    return placed.select(*order, sequence.alias("sequence_id"), (F.col("_offset") + nth % F.col("_per") * F.col("length")).alias("offset"))


def op2_pack(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens, packed into sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = staged(pieces(docs, default_path("word_bpe_49k.json")), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
