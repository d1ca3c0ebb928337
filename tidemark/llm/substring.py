"""Substring dedup by paragraph MinHash banding, and by equal runs of words.

A paragraph ends at a line feed or a sentence end, so that a passage has the same paragraphs wherever it
is put in; neighbouring short sentences are joined and very long ones divided where their words say so.
Their five-word shingles are MinHashed into bands tuned for the recall asked for, colliding
paragraphs are joined, candidates verified by exact Jaccard similarity of their shingle sets, and each
component of equal or similar paragraphs keeps its first one.

Equal runs of RUN words or more are found whatever their sentences, and to their true ends: a window of
RUN words is looked up only if the smallest hash of its GRAM-word pieces occurs twice, and windows that
occur elsewhere are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_links, components, dropped, parts, staged, with_last

#: Words of a shingle, words that a paragraph has at least, and the similarity of copies.
WORDS, LEAST, SIMILAR = 5, 8, 0.8
#: Words at which joined short sentences are cut at the latest, and from which a sentence is divided.
JOINED, LONG = 40, 64
#: Words of an equal run at least, and of its pieces.
RUN, GRAM = 51, 12
#: Rows of a band, and the share of pairs at SIMILAR that the bands are to find.
ROWS, RECALL = 2, 0.98
#: Characters worked on at a time (arrays that fit a processor's cache), and paragraph hashes that a task remembers to have sent keys for.
CHARS, SENT = 1 << 17, 1 << 18
#: Windows that are compared at a time, and classes of a piece from which on its windows are dealt by their own hashes.
HELD, MANY = 1 << 16, 4096
U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bands(similar: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of `rows` rows that find a pair of that similarity with that probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of slices, from running sums."""
    up, down = powers(len(values) + 1)
    run = np.zeros(len(values) + 1, U)
    np.cumsum((values + U(1)) * up[:-1], out=run[1:])
    return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U))


def worded(texts: list[str]) -> dict[str, np.ndarray]:
    """Words of texts: text, start, end (code points of the text), h, and stop: whether a line or sentence ends there.

    Case of A-Z and the white space between words do not count.
    """
    joined = "\n".join(texts) + "\n"
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    none = np.zeros(0, np.int64)
    if not len(starts):
        return {"text": none, "start": none, "end": none, "h": none.astype(U), "stop": none.astype(bool)}
    low = a.astype(U)
    low[(a >= 65) & (a <= 90)] += U(32)
    last = a[ends - 1]
    line = np.cumsum(a == 10)[starts]
    text = np.searchsorted(first, starts, side="right") - 1
    return {
        "text": text,
        "start": starts - first[text],
        "end": ends - first[text],
        "h": hashed(low, starts, ends),
        "stop": (last == 46) | (last == 33) | (last == 63) | np.r_[line[1:] != line[:-1], True],
    }


def units(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of paragraphs: sentences, joined short ones, pieces of very long ones.

    Only short sentences of under LEAST words in all that stand between longer ones, or alone in a text,
    are in none; as parts of a longer passage the equal runs have them.
    """
    ends = np.flatnonzero(w["stop"]) + 1
    cut = (w["h"] >> U(7)) % U(16) == 0
    out: list[tuple[int, int]] = []
    held = joins = at = -1  # start of the open join, whether it follows another one, its text
    done = 0

    def close(e: int) -> None:
        nonlocal held
        if held >= 0 and e - held >= LEAST:
            out.append((held, e))
        elif held >= 0 and joins and e > held:
            out[-1] = (out[-1][0], e)
        held = -1

    for e, t, c in zip(ends.tolist(), w["text"][ends - 1].tolist(), (w["h"][ends - 1] >> U(7)) % U(2) == 0, strict=True):
        s, done = done, e
        if held >= 0 and (t != at or e - s >= LEAST):
            close(s)
        if e - s >= LEAST:
            if e - s <= LONG:
                out.append((s, e))
                continue
            low = s
            for k in (np.flatnonzero(cut[s : e - 1]) + s + 1).tolist() + [e]:
                while k - low > LONG + LEAST:  # no word says where: cut anyway
                    out.append((low, low + LONG))
                    low += LONG
                if k - low >= 2 * LEAST and e - k >= LEAST or k == e:
                    out.append((low, k))
                    low = k
            continue
        if held < 0:
            held, joins, at = s, False, t
        if e - held >= LEAST and (c or e - held >= JOINED):
            out.append((held, e))
            held, joins = e, True
    close(done)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def paragraphs(texts: list[str]) -> dict[str, np.ndarray]:
    """Paragraphs of at least LEAST words: text, start, end (code points), n_words, h, and shingles with their starts."""
    w = worded(texts)
    words = w["h"]
    unit_start, unit_end = units(w)
    none = np.zeros(0, np.int64)
    if not len(unit_start):
        return {k: none for k in ("text", "start", "end", "n_words", "h", "at", "size")} | {"shingles": none.astype(U)}
    size = unit_end - unit_start - WORDS + 1
    shingle = np.zeros(max(0, len(words) - WORDS + 1), U)
    for k in range(WORDS):
        shingle = shingle * BASE + words[k : len(words) - WORDS + 1 + k]
    shingle = mixed(shingle)
    at = np.cumsum(size) - size
    index = np.repeat(unit_start - at, size) + np.arange(int(size.sum()))
    return {
        "text": w["text"][unit_start],
        "start": w["start"][unit_start],
        "end": w["end"][unit_end - 1],
        "n_words": unit_end - unit_start,
        "h": hashed(words, unit_start, unit_end).view(np.int64),
        "at": at,
        "size": size,
        "shingles": shingle[index],
    }


def keys(found: dict[str, np.ndarray], n_bands: int) -> np.ndarray:
    """Band keys of paragraphs: a row each."""
    out = np.zeros((len(found["at"]), n_bands), U)
    if len(out):
        for b in range(n_bands):
            key = np.full(len(out), b + 1, U)
            for r in range(ROWS):
                odd = mixed(np.array([b * ROWS + r + 1], U))[0] | U(1)
                key = key * BASE + np.minimum.reduceat(found["shingles"] * odd, found["at"])
            out[:, b] = mixed(key)
    return out.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of some CHARS characters at a time."""
    for batch in batches:
        held, texts, n = [], [], 0
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.append(k)
            texts.append(t or "")
            n += len(texts[-1])
            if n >= CHARS:
                yield held, texts
                held, texts, n = [], [], 0
        if held:
            yield held, texts


def duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(key, start, end, n_words, component_id, component_start, copies, kept) of each paragraph with a copy.

    Two paragraphs are linked if their texts are equal but for case and white space, or the Jaccard
    similarity of their shingle sets is 0.8 or more and a band holds both. Of each component the one with
    the smallest (key, start) is kept; component_id and component_start name it. Equal paragraphs are one
    class, compared once; a task sends the keys of a paragraph it has seen only once. Null, empty and
    short texts have no paragraphs. Repeated keys share their paragraphs' classes; extra columns are left out.
    """
    spark = df.sparkSession
    n, n_bands = parts(spark), bands(recall=recall)
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for ids, texts in slices(batches):
            p = paragraphs(texts)
            if not len(p["h"]):
                continue
            new, hs = np.zeros(len(p["h"]), bool), p["h"].tolist()
            for i, h in enumerate(hs):
                if h not in sent:
                    new[i] = True
                    sent.add(h)
            if len(sent) > SENT:
                sent.clear()
            ks = keys(p, n_bands)[new]
            offsets = np.r_[0, np.cumsum(np.where(new, n_bands, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(p["text"])),
                    *(pa.array(p[c].astype(np.int32)) for c in ("start", "end", "n_words")),
                    pa.array(p["h"]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ks.ravel())),
                ],
                names=["key", "start", "end", "n_words", "h", "keys"],
            )

    pieces = staged(source.mapInArrow(cut, "key long, start int, end int, n_words int, h long, keys array<long>"), "paragraph")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, h), once each, of the buckets with two or more h; sorted rows in, one row held."""
        held, open_ = None, False  # the last row, and whether it has gone out
        for last, b in with_last(batches):
            k, h = b.column("bucket").to_numpy(), b.column("h").to_numpy()
            if held is not None:
                k, h = np.r_[held[0], k], np.r_[held[1], h]
            if not len(k):
                continue
            first = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])]
            out_first = open_ and held is not None
            k, h = k[first], h[first]
            same = k[1:] == k[:-1]
            more = np.r_[False, same] | np.r_[same, False]
            if out_first:
                more[0] = False  # it is out already
                if len(more) > 1 and same[0]:
                    more[1] = True
            held = (k[-1:], h[-1:])
            open_ = bool(more[-1]) or (out_first and len(k) == 1)
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[more]), pa.array(h[more])], names=["bucket", "h"])

    spread = pieces.where("keys is not null and size(keys) > 0").select(F.explode("keys").alias("bucket"), "h")
    colliding = staged(spread.repartition(n, "bucket").sortWithinPartitions("bucket", "h").mapInArrow(shared, "bucket long, h long"), "band")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            p = paragraphs(texts)
            offsets = np.r_[p["at"], len(p["shingles"])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["h"]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p["shingles"].view(np.int64)))], names=["h", "shingles"]
            )

    wanted = colliding.select("h").distinct()
    # grouped before it is joined, as one paragraph may have a third of all rows
    where = pieces.groupBy("h").agg(F.min("key").alias("key")).join(wanted, "h")
    some = where.select(F.col("key").alias("k")).distinct()  # the null key too: a paragraph may stand under no other
    of = source.join(some, F.col("key").eqNullSafe(F.col("k")), "left_semi").mapInArrow(sets, "h long, shingles array<long>")
    of = staged(of.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("shingles").alias("shingles")), "shingles")

    def similar(block: list[np.ndarray], other: list[np.ndarray] | None) -> list[tuple[int, int]]:
        mine = [frozenset(x.tolist()) for x in block[0]]
        if other is not None:
            theirs = [frozenset(x.tolist()) for x in other[0]]
            at, links = len(mine), []
            mine = mine + theirs
        else:
            at, links = 0, []
        root = list(range(len(mine)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(at, len(mine)):
            for j in range(at if other is not None else i):
                if find(i) != find(j):
                    both = len(mine[i] & mine[j])
                    if both >= SIMILAR * (len(mine[i]) + len(mine[j]) - both):
                        root[max(find(i), find(j))] = min(find(i), find(j))
                        links.append((j, i - at))
        return links

    found = bucket_links(colliding.withColumnRenamed("bucket", "key").join(of, "h").select("key", "h", "shingles"), "h", ["shingles"], similar)
    linked = components(found)
    classes = pieces.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("low"))
    classes = classes.join(linked, classes.h == linked.node, "left").where("n > 1 or component is not null")
    classes = staged(classes.select("h", "n", "low", F.coalesce("component", "h").alias("component")), "paragraph-class")
    dropped(colliding)
    dropped(of)
    whole = classes.groupBy("component").agg(F.sum("n").alias("copies"), F.min("low").alias("low"))
    named = classes.select("h", "component").join(whole, "component").select("h", "copies", "low")
    out = pieces.select("key", "start", "end", "n_words", "h").join(named, "h")
    return out.select(
        F.col("key").alias(key),
        "start",
        "end",
        "n_words",
        F.col("low.key").alias("component_id"),
        F.col("low.start").alias("component_start"),
        "copies",
        (F.col("key").eqNullSafe(F.col("low.key")) & (F.col("start") == F.col("low.start"))).alias("kept"),
    )


def windows(texts: list[str]) -> dict[str, np.ndarray]:
    """Windows of RUN words within a text: text, pos, start, end, h, and low, the least hash of their pieces."""
    w = worded(texts)
    n = len(w["h"]) - RUN + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("text", "pos", "start", "end", "h", "low")}
    at = np.arange(len(w["h"]) - GRAM + 1)
    low = hashed(w["h"], at, at + GRAM)
    span = 1
    while span < RUN - GRAM + 1:
        step = min(span, RUN - GRAM + 1 - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = np.flatnonzero(w["text"][:n] == w["text"][RUN - 1 :])
    text = w["text"][at]
    return {
        "text": text,
        "pos": at - np.searchsorted(w["text"], text),
        "start": w["start"][at],
        "end": w["end"][at + RUN - 1],
        "h": hashed(w["h"], at, at + RUN).view(np.int64),
        "low": low[at].view(np.int64),
    }


def stretches(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows and ends of the stretches with one least piece, and which repeat within their own width."""
    low, text = w["low"], w["text"]
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[first[1:], len(low)]
    own = end - first > RUN - GRAM + 1  # longer than one piece can be the least of
    by = np.lexsort((first, low[first], text[first]))
    near = (low[first[by]][1:] == low[first[by]][:-1]) & (text[first[by]][1:] == text[first[by]][:-1]) & (np.diff(first[by]) < 2 * RUN)
    own[by[1:][near]] = own[by[:-1][near]] = True
    return first, end, own


def runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words of which every RUN in a row occur elsewhere, in the columns of duplicates.

    Equal words but for case and white space, from the first to the last word that two places share. A window
    is kept where it is the first by (key, place), and left out where it overlaps its own first place; runs are
    the maximal rows of windows that are kept, or that are not. component_id and component_start name the first
    place of the run's beginning, or an earlier one, copies the most places that a window of it has.

    Windows in a row with the same least piece are a stretch. Equal stretches are one class, and only if a
    piece has several classes are the windows of each class's first stretch compared one by one.
    """
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            w = windows(texts)
            if not len(w["low"]):
                continue
            first, end, own = stretches(w)
            # hashes of windows are those of the words, so that those of all windows name the stretch
            whole = hashed(w["h"].view(U), first, end)
            at = np.array([hash_of(t) for t in texts], np.int64)[w["text"][first]]
            whole[own] = mixed(whole[own] ^ mixed(at[own].view(U) + w["pos"][first[own]].astype(U)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(w["text"][first])),
                    pa.array(at),
                    *(pa.array(x.astype(np.int32)) for x in (w["pos"][first], end - first, w["start"][first], w["end"][end - 1])),
                    pa.array(w["low"][first]),
                    pa.array(whole.view(np.int64)),
                    pa.array(own.astype(np.int64) + 1),
                ],
                names=["key", "of", "pos", "n", "start", "end", "low", "h", "weight"],
            )

    found = staged(source.mapInArrow(low, "key long, of long, pos int, n int, start int, end int, low long, h long, weight long"), "stretch")
    again = found.groupBy("low").agg(F.sum("weight").alias("w")).where("w > 1").select("low")
    rows = staged(found.join(again, "low").distinct(), "stretch-again")
    dropped(found)
    place = F.struct("key", "pos", "of", "start")
    classes = rows.groupBy("low", "h").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max("weight").alias("weight"))
    several = classes.groupBy("low").agg(F.count("*").alias("k"), F.max("weight").alias("own"))
    several = several.select("low", ((F.col("k") > 1) | (F.col("own") > 1)).alias("several"), (F.col("k") > MANY).alias("many"))
    classes = staged(classes.join(several, "low").select("h", F.col("low").alias("l"), "copies", "first", "several", "many"), "stretch-class")
    of_class = rows.join(classes.where("several or copies > 1").withColumnRenamed("h", "ch"), (F.col("low") == F.col("l")) & (F.col("h") == F.col("ch")))
    of_class = of_class.withColumn("is_first", F.col("first").eqNullSafe(place))
    whole = of_class.where("not is_first or not several").select("key", "of", F.col("is_first").alias("kept"), "pos", "n", "start", "end", "first", "copies")
    wanted = classes.where("several").select(
        F.col("first.key").alias("k"), F.struct(F.col("first.of").alias("of"), F.col("first.pos").alias("pos"), "copies", F.col("l").alias("low"), "many").alias("x")
    )
    wanted = wanted.groupBy("k").agg(F.collect_list("x").alias("xs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the wanted stretches, a row for each stretch."""
        for batch in batches:
            for k, t, xs in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("xs").to_pylist(), strict=True):
                t = t or ""
                of = hash_of(t)
                asked = {x["pos"]: x for x in xs if x["of"] == of}
                if not asked:
                    continue
                w = windows([t])
                first, end, _ = stretches(w)
                some = np.flatnonzero(np.isin(w["pos"][first], list(asked)))
                xs = [asked[p] for p in w["pos"][first[some]].tolist()]
                index = np.repeat(first[some] - np.r_[0, np.cumsum((end - first)[some])[:-1]], (end - first)[some]) + np.arange(int((end - first)[some].sum()))
                offsets = pa.array(np.r_[0, np.cumsum((end - first)[some])].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(xs), pa.int64()), pa.array([of] * len(xs), pa.int64()), pa.array([x["low"] for x in xs], pa.int64()), pa.array([x["copies"] for x in xs], pa.int64()), pa.array([x["many"] for x in xs])]
                    + [pa.array(w["pos"][first[some]].astype(np.int32))]
                    + [pa.ListArray.from_arrays(offsets, pa.array(w[c][index].astype(kind))) for c, kind in (("h", np.int64), ("start", np.int32), ("end", np.int32))],
                    names=["key", "of", "low", "c", "many", "pos", "h", "start", "end"],
                )

    one = source.join(wanted, F.col("key").eqNullSafe(F.col("k"))).select("key", "text", "xs")
    one = staged(one.mapInArrow(cut, "key long, of long, low long, c long, many boolean, pos int, h array<long>, start array<int>, end array<int>"), "run")
    # equal windows have equal pieces: the windows of a piece meet in one task, and a piece with many classes is dealt by window
    few = one.where("not many").drop("many").repartition(parts(df.sparkSession), "low").sortWithinPartitions("low")
    found_runs = few.mapInArrow(
        compared, "key long, of long, kept boolean, pos int, n int, start int, end int, first struct<key:long,pos:int,of:long,start:int>, copies long"
    )
    each = one.where("many").select("key", "of", "c", F.posexplode(F.arrays_zip("h", "start", "end")).alias("i", "x"), F.col("pos").alias("p"))
    each = each.select("key", "of", "c", (F.col("p") + F.col("i")).cast("int").alias("pos"), "x.h", "x.start", "x.end").dropDuplicates(["key", "of", "pos"])
    at = F.struct("key", "of")
    apart = (F.max("c") > 1) | (F.max("pos") - F.min("pos") >= RUN) | ~F.max(at).eqNullSafe(F.min(at))  # more than its own overlaps
    first = each.groupBy(F.col("h").alias("fh")).agg(F.sum("c").alias("copies"), F.min(place).alias("first"), apart.alias("apart")).where("apart")
    same = F.col("first.key").eqNullSafe(F.col("key")) & (F.col("first.of") == F.col("of"))
    each = each.join(first, F.col("h") == F.col("fh")).withColumn("kept", same & (F.col("first.pos") == F.col("pos")))
    each = each.where(F.col("kept") | ~same | (F.col("pos") - F.col("first.pos") >= RUN))
    rows = whole.unionByName(found_runs).unionByName(each.select("key", "of", "kept", "pos", F.lit(1).alias("n"), "start", "end", "first", "copies"))
    by = Window.partitionBy("key", "of", "kept").orderBy("pos")
    rows = rows.withColumn("new", F.when(F.lag(F.col("pos") + F.col("n")).over(by) == F.col("pos"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    out = rows.groupBy("key", "of", "kept", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("n") + RUN - 1).cast("int").alias("n_words"), F.min_by("first", "pos").alias("first"), F.max("copies").alias("copies")
    )
    return out.select(F.col("key").alias(key), "start", "end", "n_words", F.col("first.key").alias("component_id"), F.col("first.start").alias("component_start"), "copies", "kept")


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that occur elsewhere, from stretches sorted by piece; whole pieces, some HELD windows at a time."""
    rest: list[pa.Table] = []
    held = 0
    for last, batch in with_last(batches):
        t = pa.Table.from_batches([batch])
        low = t.column("low").to_numpy()
        if rest and len(low) and low[0] == low[-1] == rest[-1].column("low")[-1].as_py() and not last:
            rest.append(t)  # in the midst of a piece
            continue
        n = len(low) if last or not len(low) else int(np.searchsorted(low == low[-1], True))
        rest.append(t.slice(0, n))
        held += sum(len(x.column("h").combine_chunks().flatten()) for x in rest[-1:])
        if n and (held >= HELD or last):
            yield from ranges(pa.concat_tables(rest))
            rest, held = [], 0
        if n < len(low):
            rest.append(t.slice(n))
    if rest and sum(x.num_rows for x in rest):
        yield from ranges(pa.concat_tables(rest))


def ranges(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (key, of, kept, pos, n, start, end, first, copies) of the windows in t that occur elsewhere, joined where they follow one another."""
    lists = t.column("h").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    some = t.column("key").is_valid().to_numpy()[row]  # a null key comes first, as in Spark's order
    key = t.column("key").fill_null(0).to_numpy()[row]
    of, c = t.column("of").to_numpy()[row], t.column("c").to_numpy()[row]
    pos = t.column("pos").to_numpy()[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    h, start, end = lists.flatten().to_numpy(), *(t.column(x).combine_chunks().flatten().to_numpy() for x in ("start", "end"))
    order = np.lexsort((of, pos, key, some, h))
    order = order[np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (h, some, key, pos, of)], axis=0)]] if len(order) else order
    if not len(order):
        return
    h, some, key, pos, of, c, start, end = (x[order] for x in (h, some, key, pos, of, c, start, end))
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    to = first[group]
    same = (some == some[to]) & (key == key[to]) & (of == of[to])
    apart = (np.maximum.reduceat(c, first) > 1) | (np.maximum.reduceat(pos, first) - np.minimum.reduceat(pos, first) >= RUN) | np.logical_or.reduceat(~same, first)
    copies = np.add.reduceat(c, first)[group]
    kept = same & (pos == pos[to])
    at = np.flatnonzero(apart[group] & (kept | ~same | (pos - pos[to] >= RUN)))
    at = at[np.lexsort((pos[at], kept[at], of[at], key[at], some[at]))]
    if not len(at):
        return
    new = np.r_[True, np.any([x[at][1:] != x[at][:-1] for x in (some, key, of, kept)], axis=0) | (np.diff(pos[at]) != 1)]
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(at)])
    a, z, f = at[begin], at[begin + n - 1], to[at[begin]]
    int32 = lambda x: pa.array(x.astype(np.int32))
    place = pa.StructArray.from_arrays([pa.array(key[f], mask=~some[f]), int32(pos[f]), pa.array(of[f]), int32(start[f])], names=["key", "pos", "of", "start"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[a], mask=~some[a]), pa.array(of[a]), pa.array(kept[a]), int32(pos[a]), int32(n), int32(start[a]), int32(end[z]), place, pa.array(np.maximum.reduceat(copies[at], begin))],
        names=["key", "of", "kept", "pos", "n", "start", "end", "first", "copies"],
    )


def hash_of(text: str) -> int:
    """A text's own hash (signed), to tell rows of one key apart."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated paragraphs, equal or similar, and equal runs of RUN words or more."""
    return duplicates(df, key, text).unionByName(runs(df, key, text))


@F.pandas_udf(T.StringType())
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without the ranges that cut them, in one pass."""

    def one(text: str, cuts: list) -> str:
        at, out = 0, []
        for c in cuts:
            out.append(text[at : max(at, c["start"])])
            at = max(at, c["end"])
        return "".join(out) + text[at:]

    for texts, cuts in parts:
        yield pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)


def removed(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the passages of found that are not kept cut out of its texts; columns as they were, whatever their names.

    Passages are cut by key, so rows of one key must be one document; a row without a key is left as it is.
    """
    cuts = found.where("not kept").groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = df.select(F.col(f"`{key}`").alias("k"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    joined = rows.join(cuts, "k", "left")
    own = F.col(f"row.`{text}`")
    cut = joined.where(F.col("cuts").isNotNull() & own.isNotNull()).select("row", _without(own, "cuts").alias("new"))
    whole = joined.where(F.col("cuts").isNull() | own.isNull()).select("row", own.alias("new"))
    return whole.unionByName(cut).select(*(F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Each paragraph and equal run of documents that has a copy elsewhere, with its component and whether it stays."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
