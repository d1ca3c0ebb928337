"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram model scores a segmentation by the sum of its pieces' log probabilities. Distinct pre-tokens are
inserted in a trie; a node's forward score (that of the best segmentation of the text from the root to it) is
computed when the node is made, so once for all pre-tokens that share the prefix, and a terminal node
stores how many pieces its best segmentation has.

The vocabulary file holds merge ranks, not probabilities. Tokenizers are never trained here, so a piece of
merge rank r gets the Zipf-Mandelbrot probability 1 / (H (r + 2.7)), a stated rule: a late piece still
costs less than the early ones that it is made of.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path
from .common import plain

#: Fixed value: the mark that stands for the space before a word.
MARK = "▁"
#: The offset of Mandelbrot's form of Zipf's law.
OFFSET = 2.7
#: Nodes of a worker's trie and terminal counts that it keeps; a full store is emptied and begun anew.
NODES, KEPT = 1_500_000, 500_000
#: Words beyond so many characters are segmented by themselves, with the scores of `longest` characters held.
LONG = 64


class Unigram:
    """Pieces and log probabilities of a sentencepiece file; characters that no piece covers become UTF-8 byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        found = {p.id_to_piece(i): float(p.get_score(i)) for i in ordinary if p.id_to_piece(i).strip(MARK) or p.id_to_piece(i) == MARK}
        if all(s == int(s) for s in found.values()):  # merge ranks
            total = sum(1 / (OFFSET - s) for s in found.values())
            found = {k: -math.log(OFFSET - s) - math.log(total) for k, s in found.items()}
        self.scores = found
        self.longest = max(map(len, found), default=1)
        #: A byte piece is worse than any piece.
        self.byte = min(found.values(), default=0.0) - 1.0
        self.clear()

    def clear(self) -> None:
        #: The trie: child by node and character, forward score and pieces by node.
        self.child: dict[int, int] = {}
        self.best, self.fewest = [0.0], [0]
        #: Terminal counts by word.
        self.ends: dict[bytes, int] = {}

    def insert(self, text: str) -> int:
        """Pieces of the best segmentation (of equal scores that with fewest pieces) at the terminal node of text."""
        child, best, fewest, scores, longest = self.child, self.best, self.fewest, self.scores, self.longest
        path, node = [0], 0
        for e, c in enumerate(text, 1):
            at = node * 0x110000 + ord(c)
            node = child.get(at, 0)
            if not node:
                n = len(c.encode("utf-8", "surrogatepass"))
                top, few = best[path[-1]] + self.byte * n, fewest[path[-1]] + n
                for s in range(max(0, e - longest), e):
                    score = scores.get(text[s:e])
                    if score is not None:
                        v, k = best[path[s]] + score, fewest[path[s]] + 1
                        if v > top or (v == top and k < few):
                            top, few = v, k
                node = child[at] = len(best)
                best.append(top)
                fewest.append(few)
            path.append(node)
        return fewest[node]

    def alone(self, text: str) -> int:
        """The same for a long text without nodes: only the last scores are held."""
        scores, longest = self.scores, self.longest
        held = [(0.0, 0)]  # of the last positions up to e - 1
        for e in range(1, len(text) + 1):
            n = len(text[e - 1].encode("utf-8", "surrogatepass"))
            top, few = held[-1][0] + self.byte * n, held[-1][1] + n
            low = e - len(held)
            for s in range(low, e):
                score = scores.get(text[s:e])
                if score is not None:
                    v, k = held[s - low][0] + score, held[s - low][1] + 1
                    if v > top or (v == top and k < few):
                        top, few = v, k
            held.append((top, few))
            if len(held) > longest:
                del held[0]
        return held[-1][1]

    def pieces(self, word: bytes) -> int:
        text = MARK + word.decode("utf-8", "surrogatepass")
        return self.insert(text) if len(text) <= LONG else self.alone(text)

    def batch(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        rows = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        missing = {w for r in rows for w in r if w not in self.ends}
        if len(self.ends) + len(missing) > KEPT or len(self.best) > NODES:
            self.clear()
            missing = {w for r in rows for w in r}
        ends = self.ends
        new = {w: self.pieces(w) for w in missing}
        ends.update((w, n) for w, n in new.items() if len(w) <= LONG)
        return [(len(r), sum([ends[w] if w in ends else new[w] for w in r])) for r in rows]


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without its text, plus n_words and n_tokens; words are [^\\x20\\x09-\\x0D]+, a null or empty text has none.

    One pass without a shuffle. Columns n_words and n_tokens are replaced, others may have any name; repeated
    rows are counted alike, and an empty table gives no rows. Very long texts are split as a whole, and words
    of over LONG characters keep no nodes.
    """
    kept, cols = plain(df, text, "n_words", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                got = model(path).batch(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1))], names=[*(f"c{i}" for i in range(len(kept))), "n_words", "n_tokens"]
                )

    schema = df.select(*cols).schema.add("n_words", "long").add("n_tokens", "long")
    return df.select(F.col(text).alias("t"), *cols).mapInArrow(run, schema).toDF(*kept, "n_words", "n_tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document under unigram scores of a public vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, default_path("piece_bpe_32k.model"))
