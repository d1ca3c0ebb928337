"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

The merge list fixes how far to the right a merge decision can reach (`Merges.lookahead`). The
transducer keeps that many symbols besides one block, emits the tokens that no later symbol can
change, and forgets them, so its memory is constant however long a stretch without a break is.
Between stretches (pre-tokens) nothing is carried over, and a stretch that ends is flushed.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Symbols beyond the lookahead after which the transducer emits.
BLOCK = 4096
#: Chunks kept in a worker's cache; a full cache takes no more, and is emptied when it has lost touch with the texts.
CACHED = 400_000
#: Longer chunks are not cached.
CACHED_CHARS = 48
#: A text with white space that a cut before each space or line feed would split wrongly is cut at pre-tokens.
TANGLED = re.compile(r" (?:\s|\Z)|\n\s")
#: Characters on which all Unicode versions and libraries agree; pre-tokenization of others is left to the library.
PLAIN = re.compile("[ -~\n\t\rÀ-ÖØ-öø-ĬĲ-ňŊ-ž¿¡«»ºª]*")
#: What may follow or precede a word, as one pre-token.
POINTS = frozenset(",.;:!?")
#: The pattern of byte-level pre-tokens.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The rank of a pair without a rule.
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Merges:
    """Merge rules by id: rank and result of each pair, and the lookahead that suffices."""

    def __init__(self, pairs: Iterable[tuple[int, int, int]]):
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        left: dict[int, int] = {}
        length: dict[int, int] = {}
        reach: dict[int, int] = {}
        self.lookahead = 0
        for rank, (a, b, ab) in enumerate(pairs):
            self.rules.setdefault((a, b), (rank, ab))
            size_a, size_b = length.get(a, 1), length.get(b, 1)
            length.setdefault(ab, size_a + size_b)
            left.setdefault(ab, a)
            # What is not yet known on the right can undo this merge through a chain of earlier ones: each
            # takes a symbol that the next one's right side begins with, and moves the frontier over it.
            x, far = b, 0
            while True:
                far = max(far, reach.get(x, 0))
                if x not in left:
                    break
                x = left[x]
            reach[a] = max(reach.get(a, 0), size_a + far)
            self.lookahead = max(self.lookahead, size_a + far)
        self.length = length
        self._hash(length)

    def _hash(self, length: dict[int, int]) -> None:
        """The rules as an open-addressed table, for lookups of many pairs at once."""
        n = 1 << (len(self.rules) * 4).bit_length()
        self.mask = n - 1
        self.keys, self.ranks, self.made = np.full(n, -1, np.int64), np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        pairs = np.array([(a << 32 | b, r, ab) for (a, b), (r, ab) in self.rules.items()], np.int64).reshape(-1, 3)
        self.probes = 0
        while len(pairs):
            at = self._slot(pairs[:, 0], self.probes)
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.ranks[at[first]], self.made[at[first]] = pairs[first].T
            pairs = np.delete(pairs, first, axis=0)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) + probe) & self.mask

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no rule) and result of each pair."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys, 0)
        rank, made = np.where(self.keys[at] == keys, self.ranks[at], NONE), self.made[at]
        for probe in range(1, self.probes):
            open_ = np.flatnonzero((rank == NONE) & (self.keys[at] >= 0) & (self.keys[at] != keys))
            if not len(open_):
                break
            at[open_] = to = self._slot(keys[open_], probe)
            hit = open_[self.keys[to] == keys[open_]]
            rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
        return rank, made

    def many(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of many short sequences that lie end to end: ids and starts after them.

        Each round merges the leftmost best pair of every sequence that still has one.
        """
        done_ids, done_word, word = [], [], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
        same = np.r_[word[1:] == word[:-1], False]
        rank, made = np.full(len(ids), NONE, np.int32), np.zeros(len(ids), np.int32)
        at = np.flatnonzero(same)
        rank[at], made[at] = self.look(ids[at], ids[at + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(ids)])
            going = np.repeat(best < NONE, size)
            if not going.all():
                done_ids.append(ids[~going])
                done_word.append(word[~going])
                ids, word, rank, made = ids[going], word[going], rank[going], made[going]
                size, best = size[best < NONE], best[best < NONE]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            ids, word, rank, made = ids[keep], word[keep], rank[keep], made[keep]
            for x in (new, new[new > 0] - 1):
                ok = (x + 1 < len(ids)) & (word[np.minimum(x + 1, len(ids) - 1)] == word[x])
                rank[x[~ok]] = NONE
                x = x[ok]
                rank[x], made[x] = self.look(ids[x], ids[x + 1])
        ids, word = np.concatenate([*done_ids, ids]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(starts)))

    def __call__(self, ids: list[int]) -> list[int]:
        """All merges of a finite sequence."""
        get = self.rules.get
        n = len(ids)
        ids, nxt, prev = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = ab, -1, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] >= 0 and (r := get((ids[k], ids[nxt[k]]))):
                    heapq.heappush(heap, (r[0], k, ids[k], ids[nxt[k]], r[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Feeds symbols in, hands tokens out as soon as no later symbol can change them."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, []

    def feed(self, symbols: list[int]) -> Iterator[int]:
        for s in range(0, len(symbols), self.block):
            self.held += symbols[s : s + self.block]
            if len(self.held) >= self.merges.lookahead + self.block:
                safe, at = len(self.held) - self.merges.lookahead, 0
                for token in self.merges(self.held):
                    if (to := at + self.merges.length.get(token, 1)) > safe:
                        break
                    at = to
                    yield token
                del self.held[:at]

    def flush(self) -> Iterator[int]:
        yield from self.merges(self.held)
        self.held = []


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE, with or without word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        shown = byte_symbols()
        self.byte = {c: b for b, c in enumerate(shown)}
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + self.end] for c in shown]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        cut = len(self.end)
        join = lambda a, b: (a[:-cut] if cut and a.endswith(self.end) else a) + b
        self.merges = Merges((vocab[a], vocab[b], vocab[join(a, b)]) for a, b in pairs)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.words = bool(self.end)
        #: The pattern of lower-cased words in the file itself.
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) if self.words else BYTE_LEVEL
        self.symbols = np.array([self.inner, self.last], np.int64)
        self.chunks: dict[str, bytes] = {}
        self.table = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            bare = token[:-cut] if cut and token.endswith(self.end) else token
            self.table[i] = bytes(self.byte[c] for c in bare) + (b" " if cut and bare != token else b"")
        for token, i in self.special.items():
            self.table[i] = token.encode()

    def stretches(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens: short ones merged together, a long one streamed through the transducer."""
        short = [r for r in raws if len(r) <= 64]
        size = np.fromiter(map(len, short), np.int64, len(short))
        flat = np.frombuffer(b"".join(short), np.uint8)
        ids = self.symbols[0][flat]
        ends = np.cumsum(size)
        ids[ends - 1] = self.symbols[1][flat[ends - 1]]
        ids, starts = self.merges.many(ids, ends - size) if len(ids) else (ids, ends)
        packed, at = ids.astype("<u4").tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
        done = iter([packed[a:b] for a, b in zip(at, at[1:], strict=False)])
        return [next(done) if len(r) <= 64 else self._stream(r) for r in raws]

    def _stream(self, raw: bytes) -> bytes:
        symbols = self.symbols[0][np.frombuffer(raw, np.uint8)].tolist()
        symbols[-1] = self.last[raw[-1]]
        t = Transducer(self.merges)
        return b"".join([i.to_bytes(4, "little") for x in (t.feed(symbols), t.flush()) for i in x])

    def pretokens(self, text: str) -> list[bytes]:
        bare = text[1:] if text[:1] == " " and not self.words else text
        if text.isascii() or PLAIN.fullmatch(text):
            if self.words:
                text = text.lower()
            if bare.isalpha():
                return [text.encode()]
            if bare[-1:] in POINTS and bare[:-1].isalpha():
                return [text[:-1].encode(), text[-1:].encode()]
            return [x.encode() for x in self.pattern.findall(text)]
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces, owner = [], []  # a special token in a text parts it into texts of their own
        for i, t in enumerate(texts):
            at = 0
            if self.special and "<|" in t:
                for m in self.marks.finditer(t):
                    pieces += [t[at : m.start()], self.special[m[0]].to_bytes(4, "little")]
                    owner += [i, i]
                    at = m.end()
            pieces.append(t[at:])
            owner.append(i)
        known, rows = self.chunks, []
        for p in pieces:
            if isinstance(p, bytes):
                rows.append(p)
            elif self.words:
                if PLAIN.fullmatch(p):
                    p = p.lower()
                rows.append(p.replace("\n", " ").split(" "))
            elif TANGLED.search(p):
                rows.append((p,))
            else:  # each space goes with what follows; the first chunk has none
                rows.append(p.replace("\n", " \n").split(" "))
        if not self.words:
            rows = [r if isinstance(r, bytes) or r[0][:1] == "\n" else [("", r[0]), *r[1:]] for r in rows]
        missing = set().union(*[r for r in rows if not isinstance(r, bytes)]).difference(known)
        if missing:
            known.update(self._chunks(list(missing)))
        out: list[list[bytes]] = [[] for _ in texts]
        for i, r in zip(owner, rows, strict=True):
            if isinstance(r, bytes):
                out[i].append(r)
            else:
                out[i].extend(map(known.__getitem__, r))
        full = len(known) - len(missing) >= CACHED
        if full and 2 * len(missing) > sum(len(r) for r in rows if not isinstance(r, bytes)):
            known.clear()
        elif missing:
            for c in missing:
                if full or not isinstance(c, str) or len(c) > CACHED_CHARS:
                    del known[c]
        return [b"".join(x) for x in out]

    def _chunks(self, chunks: list) -> dict:
        """Packed ids of chunks; a pair ("", text) is the start of a text, which no space precedes."""
        tokens, sizes = [], []
        for c in chunks:
            if isinstance(c, str) and c.isascii() and c.isalpha():  # most words: one pre-token
                tokens.append((c.lower() if self.words else " " + c).encode())
                sizes.append(1)
                continue
            if self.words:
                t = self.pretokens(c)
            elif isinstance(c, tuple):
                t = self.pretokens(c[1])
            else:
                t = self.pretokens(c if c[:1] == "\n" else " " + c)
            tokens += t
            sizes.append(len(t))
        one = dict.fromkeys(tokens)
        one = dict(zip(one, self.stretches(list(one)), strict=True))
        out, at = {}, 0
        for c, n in zip(chunks, sizes, strict=True):
            out[c] = one[tokens[at]] if n == 1 else b"".join([one[x] for x in tokens[at : at + n]])
            at += n
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


class Decoder:
    """Incremental byte-to-text machine: whole characters leave it at once, an open one waits for its bytes."""

    def __init__(self, codec: Codec):
        import codecs

        self.table, self.state = codec.table, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def flush(self) -> str:
        return self.state.decode(b"", final=True)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker; its caches live as long as the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _added(df: DataFrame, name: str, kind: T.DataType, of: str, make) -> DataFrame:
    """df with one more column (replacing one of that name), made of another in Arrow batches."""
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])
    arrow = pa.large_binary() if isinstance(kind, T.BinaryType) else pa.large_string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):  # ids and texts of few rows at a time are held
                b = batch.slice(s, 256)
                got = pa.array(make(b.column(of).to_pylist()), arrow)
                got = got.cast(pa.binary() if arrow == pa.large_binary() else pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), got], names=[*kept, name])

    return df.select(*kept, *([of] if of not in kept else [])).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the packed ids (little-endian unsigned 32-bit) of its texts; a null text is an empty one.

    One pass without a shuffle: texts are independent, and a row's ids need only the row. Other columns
    pass through; a column named like ids is replaced. Special tokens in a text get their own ids.
    """
    return _added(df, ids, T.BinaryType(), text, lambda xs: codec(path).encode_batch([x or "" for x in xs]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", block: int = 65536) -> DataFrame:
    """df with the text of packed ids; null ids give an empty text, bytes that are no UTF-8 the mark U+FFFD."""

    def one(raw: bytes | None) -> str:
        d, n = Decoder(codec(path)), len(raw or b"") // 4
        view = memoryview(raw or b"").cast("I")
        return "".join([d.feed(view[s : s + block]) for s in range(0, n, block)] + [d.flush()])

    return _added(df, text, T.StringType(), ids, lambda xs: [one(x) for x in xs])


def default_path(name: str) -> str:
    """A public vocabulary file, by the name its package lists."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, by the encoder and decoder above."""
    from pyspark.sql import functions as F

    path = default_path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path).select("doc_id", "ids")
    hashed = coded.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    back = decode(hashed, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    return back
