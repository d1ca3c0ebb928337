"""SimHash near-duplicates by segment bit counts.

A fingerprint's 64 bits form 32 segments of two bits; the vector of their bit counts differs between
two fingerprints by no more in Manhattan distance than they differ in bits. The vector's eight groups
of four segments are the axes of a grid: within distance d at most d groups differ, so two linked
fingerprints share a cell in at least one choice of 8 - d axes. The range-join is an equi-join over
these choices; of the pairs in a cell those beyond Manhattan distance d are rejected, and the rest is
verified by its exact bit difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_links, components, labels_of, staged

GROUPS = 8


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash over the shingles (repeats included) of a text; 0 without words."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    if len(ws) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed)], np.uint64)
    else:
        flat = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = (np.r_[0, ends[:-1]])[: len(ws) - words + 1].tolist()
        cut = map(flat.__getitem__, map(slice, starts, (ends[words - 1 :] - 1).tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 8192):
        ones += np.unpackbits(h[s : s + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)
    return int(bits[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(x, words) for x in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key"), fp], names=[key, "fp"])

    given = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(run, given.select(F.col("key").alias(key), F.lit(None).cast("long").alias("fp")).schema)


def embedded(bits: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments in unary (0, 1, 3): differing bits are then the Manhattan distance."""
    half = np.uint64(0x5555555555555555)
    other = bits >> np.uint64(1)
    return ((bits | other) & half) | (((bits & other) & half) << np.uint64(1))


def close(block: list[np.ndarray], other: list[np.ndarray] | None, most: int) -> list[tuple[int, int]]:
    """Links that connect what differs in at most `most` bits, within a block or across two.

    Pairs whose counts lie farther apart are rejected, the others verified by their bits.
    """
    a = block[0].view(np.uint64)
    b = a if other is None else other[0].view(np.uint64)
    near = np.bitwise_count(embedded(a)[:, None] ^ embedded(b)[None, :]) <= most
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count(a[i] ^ b[j]) <= most
    if other is None:
        if len(a) == 2:
            return [(0, 1)] if near[0, 1] and a[0] != a[1] else []
        label = labels_of(near)
        return [(i, int(k)) for i, k in enumerate(label) if k != i]
    n = len(a)
    whole = np.zeros((n + len(b), n + len(b)), bool)
    whole[:n, n:], whole[n:, :n] = near, near.T
    label = labels_of(whole)
    # as pairs across the two blocks: every member with one member of the other side in its component
    first = {}
    for j in range(n, n + len(b)):
        first.setdefault(int(label[j]), j - n)
    out = [(i, first[int(k)]) for i, k in enumerate(label[:n]) if int(k) in first]
    low = {}
    for i in range(n):
        low.setdefault(int(label[i]), i)
    return out + [(low[int(k)], j) for j, k in enumerate(label[n:]) if int(k) in low]


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4, words: int = 4) -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the smallest key reachable over links.

    Two rows are linked if their fingerprints differ in at most `most` (under 8) bits; equal texts and equal
    fingerprints are one class, of which only one member takes part in the join. Null and wordless texts
    have fingerprint zero and are linked like any other. Keys are of any orderable type. Rows with one key are
    rows of their own, each in the component of its text; null keys count as smallest only where a component
    has no other (then component_id is null). Extra columns are left out, an empty table gives no rows.
    """
    if not 0 <= most < GROUPS:
        raise ValueError("most must be from 0 to 7")
    fps = staged(fingerprints(df, key, text, words), "fp")
    classes = staged(fps.groupBy("fp").agg(F.min(key).alias("low")), "fp-class")
    half = 0x5555555555555555
    odd, even = F.col("fp").bitwiseAND(F.lit(half)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(half))
    counts = F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseXOR(even))  # two bits hold each segment's count
    masks = []
    for chosen in combinations(range(GROUPS), GROUPS - most):
        mask = sum(0xFF << (8 * g) for g in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    cells = classes.select("fp", counts.alias("c")).select(
        "fp", F.explode(F.array(*(F.xxhash64(F.col("c").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(masks)))).alias("key")
    )
    links = bucket_links(
        cells.select("key", "fp", F.col("fp").alias("bits")), "fp", ["bits"], lambda x, y: close(x, y, most)
    )
    linked = components(links)
    low = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    of = staged(low.join(least, "component").select(F.col("fp").alias("_fp"), "component_id"), "fp-component")
    return fps.join(of, F.col("fp") == F.col("_fp")).select(key, "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document, links at 4 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
