"""Alignment of two tokenizers over a corpus by its distinct segments.

A text is split before runs of white space, where neither tokenizer can join what lies on both sides. That
is read off the vocabularies (`breaks`), not assumed. Texts are dealt into blocks; a block keeps its distinct
segments and each text as numbers of these, so a common word is one row a block however often it occurs.
Distinct segments of all blocks are then tokenised and aligned once, the pairs' counts are summed over the
corpus, and the alignments return to the blocks, where documents are composed from them. A text is read
twice at most (by the scan and as numbers), and a task holds one block and its segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols, default_path
from .common import parts, staged

#: Characters of texts after which a block ends, and segments that are tokenised in one call.
BLOCK_CHARS, CALL = 24_000_000, 4096
#: A pair with more than one in HEAVY of all links of distinct segments is joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1024
#: White space in any reading of Unicode, and characters that some reading takes for it: no split stands beside one that is not a break.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎" + "".join(map(chr, range(0x2000, 0x200E))) + "    ⁠　﻿"
#: Fixed value: the sign for a space in vocabularies of pieces.
SPACE_SIGN = "▁"


class Pair:
    """Both tokenizers with the bytes of their ids, and the splitting that they allow."""

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {s: bytes([i]) for i, s in enumerate(byte_symbols())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = b"".join(byte.get(c, c.encode()) for c in entry)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        told = json.loads(open(path_a, encoding="utf-8").read())["pre_tokenizer"]
        cuts = told["type"] == "ByteLevel" and told["use_regex"] and not told["add_prefix_space"]
        texts_b = [p.replace(SPACE_SIGN, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.breaks = self._breaks(texts_b) if cuts else ""
        # an anchor that no piece holds, before which the model's own leading space stands alone
        self.anchor = "\n" if "\n" in self.breaks and not any("\n" in t for t in texts_b) else None
        if self.anchor is None:
            self.breaks = ""
        self.lead = self.b.encode(self.anchor) if self.anchor else []
        blank, ends = f"[{re.escape(BLANK)}]", f"[{re.escape(self.breaks)}]"
        self.other = re.compile(f"[{re.escape(''.join(c for c in BLANK if c not in self.breaks))}]")
        self.runs = re.compile(f"{blank}+[^{re.escape(BLANK)}]*")
        self.cut = re.compile(f"(?<=[^{re.escape(BLANK)}])(?={ends})") if self.breaks else None

    def _breaks(self, texts_b: list[str]) -> str:
        """White space that stands only at the beginning of entries of both vocabularies, or after white space.

        The byte-level pattern never continues a match from another character into white space, so what is
        left of such a break does not reach over it; what is right of it is matched from there.
        """
        out = ""
        for c in " \n\t":
            inner = re.compile(f"[^{re.escape(BLANK)}]{re.escape(c)}")
            in_a = any(inner.search(t.decode("utf-8", "replace")) for t in self.bytes_a)
            if not in_a and not any(inner.search(t) for t in texts_b):
                out += c
        return out

    def segments(self, text: str) -> list[str]:
        """Space and text, cut before white space that begins with a break."""
        text = " " + text
        if not self.cut:
            return [text]
        return self.cut.split(text) if self.other.search(text) else self.runs.findall(text)

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]
        if not self.cut:
            return a, self.b.encode([t[1:] for t in texts], num_threads=1)
        n = len(self.lead)  # segments are coded behind the anchor, as a text of its own would get a space
        return a, [x[n:] for x in self.b.encode([self.anchor + t for t in texts], num_threads=1)]

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[list[int], list[int], str, int] | None:
        """Both sides of the links, the groups as text and their number; None if the tokens' bytes are not the text's."""
        raw = text.encode()
        size_a, size_b = [len(self.bytes_a[i]) for i in a], [len(self.bytes_b[i]) for i in b]
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        link_a, link_b, groups = [], [], []
        i = j = from_i = from_j = 0
        end_a, end_b = size_a[0], size_b[0]
        while True:
            link_a.append(a[i])
            link_b.append(b[j])
            if end_a == end_b:
                groups.append(f"{','.join(map(str, a[from_i : i + 1]))}|{','.join(map(str, b[from_j : j + 1]))}")
                i, j = i + 1, j + 1
                if i == len(a):
                    return link_a, link_b, ";".join(groups), len(groups)
                from_i, from_j = i, j
                end_a, end_b = end_a + size_a[i], end_b + size_b[j]
            elif end_a < end_b:
                i += 1
                end_a += size_a[i]
            else:
                j += 1
                end_b += size_b[j]


_pairs: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def _shrunk(ids: np.ndarray) -> bytes:
    """Numbers of segments, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(1).compress(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _grown(coded: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(coded), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<i4").ravel()


def _batch(schema: list[tuple[str, pa.DataType]], **columns) -> pa.RecordBatch:
    """A batch of these columns; the others of the schema are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in schema], names=[c for c, _ in schema])


BLOCKS = [("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("segment", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("coded", pa.binary())]


def _blocked(paths: tuple[str, str], chars: int):
    """Blocks of texts: rows (block, place, segment, n) of kind 0 and (block, key, texts as numbers of segments) of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pair(*paths).segments
        block, held, known, names, count, keys, coded = TaskContext.get().partitionId() << 32, 0, {}, [], [], [], []

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            for s in range(0, len(names), 20_000):
                part = names[s : s + 20_000]
                yield _batch(BLOCKS, kind=[0] * len(part), block=[block] * len(part), place=range(s, s + len(part)), segment=part, n=count[s : s + 20_000])
            for s in range(0, len(keys), 500):
                part = keys[s : s + 500]
                yield _batch(BLOCKS, kind=[1] * len(part), block=[block] * len(part), key=part, coded=coded[s : s + 500])
            block, held = block + 1, 0
            known.clear(), names.clear(), count.clear(), keys.clear(), coded.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = cut(text) if text else []
                ids = np.empty(len(found), np.int32)
                for i, s in enumerate(found):
                    at = known.get(s)
                    if at is None:
                        at = known[s] = len(names)
                        names.append(s)
                        count.append(0)
                    count[at] += 1
                    ids[i] = at
                keys.append(key)
                coded.append(_shrunk(ids))
                held += len(text or "") + 64
                if held >= chars:
                    yield from told()
        if keys:
            yield from told()

    return run


SEGMENTS = [
    ("kind", pa.int32()), ("sid", pa.int64()), ("segment", pa.string()), ("n", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("n_groups", pa.int32()),
    ("groups", pa.string()), ("links", pa.list_(pa.int64())), ("block", pa.int64()), ("place", pa.int32()),
]


def _tokenised(paths: tuple[str, str]):
    """Rows (segment, block, place, n), sorted, become a row of kind 0 for each distinct segment, with a number, its
    count in all blocks and its alignment (n_a null where bytes differ; links as a << 32 | b), and kind 1 for each place of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(*paths)
        sid, at, total = (TaskContext.get().partitionId() << 32) - 1, None, 0
        held: list[tuple[int, str, int]] = []

        def told() -> pa.RecordBatch:
            rows = []
            texts = [t for _, t, _ in held]
            for t, x, y in zip(texts, *p.encoded(texts), strict=True):
                found = p.aligned(t, x, y)
                rows.append((len(x), len(y), found[3], found[2], [i << 32 | j for i, j in zip(found[0], found[1], strict=True)]) if found else (None, None, None, None, []))
            n_a, n_b, n_groups, groups, links = zip(*rows, strict=True)
            return _batch(SEGMENTS, kind=[0] * len(held), sid=[k for k, _, _ in held], segment=texts, n=[n for _, _, n in held], n_a=n_a, n_b=n_b, n_groups=n_groups, groups=groups, links=links)

        for batch in batches:
            sids = []
            for s, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != at:
                    if at is not None:
                        held.append((sid, at, total))
                    sid, at, total = sid + 1, s, 0
                total += n
                sids.append(sid)
            if sids:
                yield _batch(SEGMENTS, kind=[1] * len(sids), sid=sids, block=batch.column(1), place=batch.column(2))
            if len(held) >= CALL:
                yield told()
                held = []
        if at is not None:
            held.append((sid, at, total))
            yield told()

    return run


def _by_block(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(block, whether `mark` is null, batch) of rows sorted by block, null marks last; no batch over two of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, null = batch.column("block").to_numpy(), np.asarray(batch.column(mark).is_null())
        cut = np.flatnonzero((block[1:] != block[:-1]) | (null[1:] != null[:-1])) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(block)], strict=True):
            yield int(block[s]), bool(null[s]), batch.slice(s, e - s)


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each segment of a block stands in texts that hold a segment marked wrong."""
    at, wrong, seen = None, [], []

    def told() -> pa.RecordBatch:
        ids, n = np.unique(np.concatenate(seen), return_counts=True)
        return _batch([("block", pa.int64()), ("place", pa.int32()), ("lost", pa.int64())], block=[at] * len(ids), place=ids, lost=n)

    for here, is_text, b in _by_block(batches, "place"):
        if here != at:
            if seen:
                yield told()
            at, wrong, seen = here, [], []
        if not is_text:
            wrong += b.column("place").to_pylist()
            continue
        for x in b.column("coded").to_pylist():
            ids = _grown(x)
            if np.isin(ids, wrong).any():
                seen.append(ids)
    if seen:
        yield told()


NUMBERS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task knows of the segments of each block, sorted by block, as compressed rows: far smaller to shuffle."""
    for block, _, b in _by_block(batches, "block"):
        columns = [b.column("place").to_numpy().astype(np.int64)] + [b.column(c).cast(pa.int64()).fill_null(-1).to_numpy() for c in NUMBERS]
        numbers = np.stack(columns).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
        groups = "\n".join([x or "" for x in b.column("groups").to_pylist()]).encode()
        blob = zstandard.ZstdCompressor(3).compress(b"".join([len(b.column("place")).to_bytes(8, "little"), numbers, groups]))
        yield _batch([("block", pa.int64()), ("packed", pa.binary())], block=[block], packed=[blob])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of sorted blocks from the alignments of their segments."""
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kinds = [("key", pa.int64()), *((c, pa.int64()) for c in sums), ("groups_sha256", pa.string())]
    at, parts_, table, told = None, [], np.zeros((0, len(NUMBERS)), np.int64), []
    for here, is_text, b in _by_block(batches, "packed"):
        if here != at:
            at, parts_ = here, []
        if not is_text:
            for x in b.column("packed").to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(x)
                m, wide = int.from_bytes(raw[:8], "little"), 1 + len(NUMBERS)
                numbers = np.frombuffer(raw, np.uint8, m * wide * 8, 8).reshape(wide, 8, m).transpose(0, 2, 1).copy().view("<i8")[:, :, 0]
                parts_.append((numbers, raw[8 + m * wide * 8 :].decode().split("\n")))
            continue
        if parts_:
            size = sum(len(groups) for _, groups in parts_)
            table, told = np.zeros((size, len(NUMBERS)), np.int64), [""] * size
            for numbers, groups in parts_:
                table[numbers[0]] = numbers[1:].T
                for place, g in zip(numbers[0].tolist(), groups, strict=True):
                    told[place] = g
            parts_ = []
        out, shas = [], []
        for x in b.column("coded").to_pylist():
            ids = _grown(x)
            rows = table[ids]
            if not len(ids) or (rows[:, 0] < 0).any():
                out.append([0] * len(sums))
                shas.append("")
            else:
                n_a, n_b, n_groups, n_best, count_sum = rows.sum(axis=0).tolist()
                # a group of i and j tokens has i + j - 1 links, as no two of its tokens end together but the last
                out.append([n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum])
                shas.append(hashlib.sha256(";".join([told[i] for i in ids.tolist()]).encode()).hexdigest())
        yield _batch(kinds, key=b.column("key"), groups_sha256=shas, **dict(zip(sums, zip(*out, strict=True), strict=True)))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, rows, best): links of the corpus that each id pair holds, in how many rows, and whether no pair with its B id has more."""
    found = links.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    top = found.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("n").alias("top"))
    return found.withColumn("b", F.col("pair") % (1 << 32)).join(top, "b").select("pair", "n", "rows", (F.col("n") == F.col("top")).alias("best"))


def aligned(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, id pairs and distinct segments of the alignment of two tokenizers.

    Documents: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row.
    A null or empty text, or one that either tokenizer does not give back byte for byte, has no tokens: zeros and
    an empty groups_sha256, and its links count nowhere. Repeated rows count as often as they are there. Pairs:
    (pair = a << 32 | b, n, rows, best). Segments: (sid, segment, n, n_a, n_b, n_groups, groups, links). Other columns are not read.
    """
    paths, n = (path_a, path_b), parts(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_blocked(paths, BLOCK_CHARS), _ddl(BLOCKS))
    rows = staged(rows, "blocks", ("kind",))
    docs = rows.where("kind = 1").select("block", "key", "coded")
    words = rows.where("kind = 0").select("segment", "block", "place", "n").repartition(n, "segment").sortWithinPartitions("segment", "block")
    known = staged(words.mapInArrow(_tokenised(paths), _ddl(SEGMENTS)), "segments", ("kind",))
    places = known.where("kind = 1").select("sid", "block", "place")
    known = known.where("kind = 0").select("sid", "segment", "n", "n_a", "n_b", "n_groups", "groups", "links")

    wrong = known.where("n_a is null").select("sid")
    if not wrong.isEmpty():  # their texts have no tokens: what else stands in them is taken off the counts
        bad = staged(places.join(wrong, "sid").select("block", "place"), "wrong")
        around = docs.join(bad.select("block").distinct(), "block").select("block", F.lit(None).cast("int").alias("place"), "coded")
        both = bad.select("block", "place", F.lit(None).cast("binary").alias("coded")).unionByName(around)
        less = both.repartition(n, "block").sortWithinPartitions("block", F.col("place").asc_nulls_last()).mapInArrow(_lost, "block long, place int, lost long")
        less = less.join(places, ["block", "place"]).groupBy("sid").agg(F.sum("lost").alias("lost"))
        known = known.join(less, "sid", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("lost")
        known = staged(known, "segments")

    linked = known.where("n > 0").select("sid", "n", F.explode("links").alias("pair"))
    pairs = staged(pair_counts(linked.select("pair", "n")), "pairs")
    total = pairs.agg(F.sum("rows")).collect()[0][0] or 0
    heavy = F.col("rows") * HEAVY > total
    often = F.broadcast(pairs.where(heavy).select("pair", F.col("n").alias("often"), F.col("best").alias("often_best")))
    marked = linked.select("sid", "pair").join(often, "pair", "left")
    rest = marked.where("often is null").select("sid", "pair").join(pairs.where(~heavy).select("pair", "n", "best"), "pair")
    counted = marked.where("often is not null").select("sid", F.col("often").alias("n"), F.col("often_best").alias("best")).unionByName(rest.select("sid", "n", "best"))
    counted = staged(counted.groupBy("sid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")), "counted")

    full = known.select("sid", "n_a", "n_b", "n_groups", "groups").join(counted, "sid", "left")
    back = places.join(full, "sid").select("block", "place", *NUMBERS, "groups").sortWithinPartitions("block").mapInArrow(_packed, "block long, packed binary")
    back = back.select("block", "packed", F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("coded"))
    dealt = back.unionByName(docs.select("block", F.lit(None).cast("binary").alias("packed"), "key", "coded"))
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block", F.col("packed").isNull())
    out = dealt.mapInArrow(_composed, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key), pairs, known


def _ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    told = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{c} {told[t]}" for c, t in schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in two vocabularies, aligned by bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))[0]
