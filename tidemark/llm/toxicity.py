"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins learned vectors of the word and of its character n-grams (hashed) with their log
odds among the training texts. Windows of words overlap by half; each is read in both directions, its
states are pooled by attention, and a text's score is that of its most toxic window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

#: Words in a window and between starts of windows; hash buckets of words and of character n-grams.
WINDOW, STRIDE, WORDS, GRAMS = 32, 16, 1 << 15, 1 << 15
#: Sizes of learned vectors (each) and of the state in one direction.
EMBED, HIDDEN = 6, 6
#: Labelled rows that training takes at most of each label, smallest hash first, and their words at most.
#: A documented bound: the model's size doesn't follow the corpus, and neither does its training set.
SAMPLE, SAMPLE_WORDS = 1200, 1 << 19
#: Characters of a clean and of a toxic training text beyond which a stretch of PART takes part.
PART, WHOLE = 12_000, 200_000
#: Rounds over the training windows; few texts get more, up to MOST_EPOCHS.
EPOCHS, MOST_EPOCHS = 6, 20
#: Characters of a word at most, and those that consecutive pieces of a longer one share.
PIECE, SHARED = 40, 10
#: Distinct words whose inputs a worker keeps.
KEPT = 250_000
STRIP = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))))


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams: prefixes of 3 to 6 characters and all inner trigrams."""
    w = f"^{word}$"
    out = [zlib.crc32(w[:n].encode()) % GRAMS for n in range(4, min(7, len(w)) + 1)]
    return out + [zlib.crc32(w[i : i + 3].encode()) % GRAMS for i in range(len(w) - 2)]


def split(text: str | None) -> list[str]:
    """Words without the signs around them; longer ones, as of texts without spaces, in overlapping pieces."""
    words = [x for w in (text or "").lower().split() if (x := w.strip(STRIP))]
    return [x[i : i + PIECE] for x in words for i in range(0, max(1, len(x) - SHARED), PIECE - SHARED)]


def word_bucket(word: str) -> int:
    return zlib.crc32(b"w" + word.encode()) % WORDS


class Network:
    """Parameters, the pass over windows, and its gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = 2 * EMBED + 4, HIDDEN
        f = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.word_odds, self.gram_odds = np.zeros(WORDS, np.float32), np.zeros(GRAMS, np.float32)
        self.p = {
            "ew": (0.1 * r.normal(size=(WORDS, EMBED))).astype(np.float32), "eg": (0.1 * r.normal(size=(GRAMS, EMBED))).astype(np.float32),
            "wf": f(d, 3 * h), "uf": f(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "wb": f(d, 3 * h), "ub": f(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
            "a": f(2 * h, 2 * h), "av": f(2 * h, 1)[:, 0], "o": f(2 * h, 1)[:, 0], "ob": np.full(1, -1.0, np.float32),
        }

    def fit_odds(self, docs: list[list[str]], y: np.ndarray) -> None:
        """Log odds of words and n-grams: in how many texts of each label they are, smoothed."""
        for size, of, table in ((WORDS, lambda w: [word_bucket(w)], "word_odds"), (GRAMS, grams, "gram_odds")):
            seen = {}
            n = np.zeros((2, size))
            for d, label in zip(docs, y, strict=True):
                b = set()
                for w in set(d):
                    if w not in seen:
                        seen[w] = of(w)
                    b.update(seen[w])
                n[int(label), list(b)] += 1
            total = np.maximum(1, np.bincount(y.astype(int), minlength=2))
            odds = np.log((n[1] + 0.3) / (total[1] + 0.6)) - np.log((n[0] + 0.3) / (total[0] + 0.6))
            odds *= (n[0] + n[1]) / (n[0] + n[1] + 4)  # few texts say little
            setattr(self, table, np.clip(odds / 3, -1, 2).astype(np.float32))

    def inputs(self, word: str) -> tuple[int, list[int]]:
        return word_bucket(word), grams(word)

    def vectors(self, words: list[tuple[int, list[int]]]) -> np.ndarray:
        """Inputs of distinct words: learned vectors, then word odds, mean, largest and prefix n-gram odds."""
        wb = np.array([w for w, _ in words], np.int64)
        sizes = np.array([len(g) for _, g in words], np.int64)
        flat = np.concatenate([np.array(g, np.int64) for _, g in words])
        at = np.cumsum(sizes) - sizes
        odds = self.gram_odds[flat]
        return np.concatenate(
            [self.p["ew"][wb], np.add.reduceat(self.p["eg"][flat], at) / sizes[:, None], self.word_odds[wb][:, None], (np.add.reduceat(odds, at) / sizes)[:, None], np.maximum.reduceat(odds, at)[:, None], odds[at][:, None]], axis=1
        ).astype(np.float32)

    def run(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: gates' inputs (time, window, 3h) of both directions, mask (time, window)."""
        t_, n = mask.shape
        h_ = HIDDEN
        states, saved = [], []
        for g, u, back in ((gf, self.p["uf"], False), (gb, self.p["ub"], True)):
            h = np.zeros((n, h_), np.float32)
            out = np.empty((t_, n, h_), np.float32)
            cache = [None] * t_
            for t in range(t_ - 1, -1, -1) if back else range(t_):
                zr = g[t, :, : 2 * h_] + h @ u[:, : 2 * h_]
                zr = 0.5 + 0.5 * np.tanh(0.5 * zr)
                z, r = zr[:, :h_], zr[:, h_:]
                c = np.tanh(g[t, :, 2 * h_ :] + (r * h) @ u[:, 2 * h_ :])
                m = mask[t][:, None]
                new = h + m * z * (c - h)
                if keep:
                    cache[t] = (h, z, r, c, m)
                h = new
                out[t] = h
            states.append(out)
            saved.append(cache)
        s = np.concatenate(states, axis=2)
        q = np.tanh(s @ self.p["a"])
        e = q @ self.p["av"]
        e = np.where(mask > 0, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = (w[:, :, None] * s).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, (s, q, w, pooled, saved)) if keep else logit

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients for windows x (time, window, d) with labels y."""
        p, h_ = self.p, HIDDEN
        t_, n = mask.shape
        logit, (s, q, w, pooled, saved) = self.run(x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"], mask, keep=True)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
        d = ((prob - y) / n).astype(np.float32)
        g = {"o": pooled.T @ d, "ob": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["o"]
        dw = (s * dp).sum(axis=2)
        ds = w[:, :, None] * dp
        de = w * (dw - (w * dw).sum(axis=0))
        g["av"] = np.einsum("tn,tnk->k", de, q)
        dq = de[:, :, None] * p["av"] * (1 - q * q)
        g["a"] = np.einsum("tni,tnk->ik", s, dq)
        ds = ds + dq @ p["a"].T
        dx = np.zeros_like(x)
        for k, (wn, un, bn) in enumerate((("wf", "uf", "bf"), ("wb", "ub", "bb"))):
            u, part = p[un], ds[:, :, k * h_ : (k + 1) * h_]
            dh = np.zeros((n, h_), np.float32)
            dg = np.zeros((t_, n, 3 * h_), np.float32)
            du = np.zeros_like(u)
            for t in range(t_) if k else range(t_ - 1, -1, -1):
                h, z, r, c, m = saved[k][t]
                dh = dh + part[t]
                dz, dc = dh * m * (c - h) * z * (1 - z), dh * m * z * (1 - c * c)
                drh = dc @ u[:, 2 * h_ :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, : 2 * h_] += h.T @ dzr
                du[:, 2 * h_ :] += (r * h).T @ dc
                dg[t] = np.concatenate([dzr, dc], axis=1)
                dh = dh * (1 - m * z) + drh * r + dzr @ u[:, : 2 * h_].T
            g[un], g[bn] = du, dg.sum(axis=(0, 1))
            g[wn] = np.einsum("tni,tnk->ik", x, dg)
            dx += dg @ p[wn].T
        return loss, g, dx


def windows(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the overlapping windows over n words; the last is shifted back to the end."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


class Scorer:
    """Scores texts by a network; the gates' inputs of a distinct word are computed once."""

    def __init__(self, net: Network):
        self.net = net
        p = net.p
        self.w, self.b = np.concatenate([p["wf"], p["wb"]], axis=1), np.concatenate([p["bf"], p["bb"]])
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, 6 * HIDDEN), np.float32)

    def ids(self, docs: list[list[str]]) -> list[np.ndarray]:
        missing = list({w for d in docs for w in d if w not in self.known})
        if len(self.known) + len(missing) > KEPT and self.known:
            self.known.clear()
            missing = list({w for d in docs for w in d})
        if missing:
            at = len(self.known)
            rows = self.net.vectors([self.net.inputs(w) for w in missing]) @ self.w + self.b
            if at + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows[:at], np.zeros((2 * (at + len(missing)) - at, 6 * HIDDEN), np.float32)])
            self.rows[at : at + len(missing)] = rows
            self.known.update(zip(missing, range(at, at + len(missing)), strict=True))
        get = self.known.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]

    def logits(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Logits of all windows of all docs, the doc of each, and its start and end."""
        ids = self.ids(docs)
        of, cut = [], []
        for i, x in enumerate(ids):
            ws = windows(len(x))
            of += [i] * len(ws)
            cut += ws
        out = np.zeros(len(of), np.float32)
        starts = np.array([c[0] for c in cut]) + np.cumsum([0] + [len(x) for x in ids])[of]
        sizes = np.array([c[1] - c[0] for c in cut])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        for s in range(0, len(of), 4096):
            at = starts[s : s + 4096, None] + np.arange(WINDOW)
            mask = (np.arange(WINDOW)[:, None] < sizes[s : s + 4096]).astype(np.float32)
            gates = self.rows[flat[np.minimum(at, len(flat) - 1)].T]
            out[s : s + 4096] = self.net.run(gates[:, :, : 3 * HIDDEN], gates[:, :, 3 * HIDDEN :], mask)
        return out, np.array(of), cut

    def __call__(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        i = 0
        while i < len(texts):  # some 200,000 words at a time; a longer text is taken whole
            docs, n = [], 0
            while i < len(texts) and n < 200_000:
                docs.append(split(texts[i]))
                n += len(docs[-1])
                i += 1
            logit, of, _ = self.logits(docs)
            top = np.full(len(docs), -np.inf, np.float32)
            np.maximum.at(top, of, logit)
            out += (1 / (1 + np.exp(-top.astype(float)))).tolist()
        return out


def train(texts: list[str | None], labels: list[int], rate: float | None = None, seed: int = 7) -> Network:
    """A network fitted to labelled texts: in each round every text's most toxic window counts for it, and a
    second, random one counts as clean for clean texts. rate: the share of toxic labels beyond the sample, by
    which the bias is corrected."""
    r = np.random.default_rng(seed)
    net = Network(seed)
    docs, y = [split(t) for t in texts], np.array(labels, np.float32)
    if not len(docs):
        return net
    net.fit_odds(docs, y)
    net.p["wf"][-4:, :] *= 2
    net.p["wb"][-4:, :] *= 2
    moments: dict[str, list] = {}
    step = 0
    for epoch in range(min(MOST_EPOCHS, max(EPOCHS, EPOCHS * SAMPLE // len(docs)))):
        if epoch:
            logit, of, cut = Scorer(net).logits(docs)
        else:  # before the first round: by the odds of the words
            of_, cut, logit_ = [], [], []
            odds = {w: net.word_odds[b] + net.gram_odds[g].max() for w in {w for d in docs for w in d} for b, g in [net.inputs(w)]}
            for i, d in enumerate(docs):
                v = np.array([odds[w] for w in d] + [0.0])
                for s, e in windows(len(d)):
                    of_.append(i)
                    cut.append((s, e))
                    logit_.append(float(v[s:e].max()) if e > s else 0.0)
            logit, of = np.array(logit_), np.array(of_)
        order = np.lexsort((-logit, of))
        first = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        clean = np.flatnonzero(y[of] == 0)
        chosen = np.concatenate([first, r.choice(clean, min(len(clean), len(first)), replace=False)])
        r.shuffle(chosen)
        for s in range(0, len(chosen), 64):
            part = chosen[s : s + 64]
            rows = [docs[of[k]][cut[k][0] : cut[k][1]] for k in part]
            size = max(1, max(map(len, rows)))
            words = list({w for d in rows for w in d}) or ["-"]
            number = {w: i for i, w in enumerate(words)}
            info = [net.inputs(w) for w in words]
            vec = net.vectors(info)
            at = np.zeros((size, len(rows)), np.int64)
            mask = np.zeros((size, len(rows)), np.float32)
            for j, d in enumerate(rows):
                at[: len(d), j] = [number[w] for w in d]
                mask[: len(d), j] = 1
            _, g, dx = net.gradients(vec[at], mask, y[of[part]])
            dv = np.zeros_like(vec)
            np.add.at(dv, at.ravel(), (dx * mask[:, :, None]).reshape(-1, vec.shape[1]))
            step += 1
            for k, v in g.items():
                m = moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.01 * (v * v - m[1])
                net.p[k] -= (0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            wb = np.array([w for w, _ in info])
            np.add.at(net.p["ew"], wb, -0.1 * dv[:, :EMBED])
            sizes = np.array([len(x) for _, x in info])
            np.add.at(net.p["eg"], np.concatenate([np.array(x) for _, x in info]), np.repeat(-0.1 * dv[:, EMBED : 2 * EMBED] / sizes[:, None], sizes, axis=0))
    if rate is not None and 0 < y.mean() < 1:
        odds = lambda v: np.log(v / (1 - v))
        net.p["ob"] += np.float32(odds(min(max(rate, 1e-3), 0.999)) - odds(float(y.mean())))
    return net


def sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list, list, float | None]:
    """Texts, labels and the rate of label 1 to train on: rows outside the held-out fold, at most SAMPLE of each label and SAMPLE_WORDS words.

    Of a clean text of over PART characters a stretch of that length takes part, from a place that the id's hash
    gives; a toxic text takes part whole, as any of its windows may be what makes it toxic, and as such a stretch
    only beyond WHOLE characters. Rows without an id or a label of 0 or 1 take no part; of repeated labels the larger counts.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y in (0, 1)")
    rows = rows.where(F.crc32(F.col("k").cast("string").cast("binary")) % 5 != 0).groupBy("k").agg(F.max("y").alias("y"))
    rate = rows.agg(F.avg("y")).collect()[0][0]
    rows = [rows.where(F.col("y") == v).orderBy(F.xxhash64("k"), "k").limit(SAMPLE) for v in (0, 1)]
    rows = rows[0].union(rows[1])
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(rows), "k")  # 2 * SAMPLE ids
    whole = F.length("t") <= F.when(F.col("y") == 1, WHOLE).otherwise(PART)
    start = F.pmod(F.xxhash64("k", F.lit(3)), F.greatest(F.length("t") - PART, F.lit(1))) + 1
    got = got.withColumn("t", F.when(whole, F.col("t")).otherwise(F.substring("t", start.cast("int"), F.lit(PART))))
    # by another hash than that of the choice, which comes early for the more frequent label: the bound on words cuts both alike
    got = got.orderBy(F.xxhash64("k", F.lit(9)), "k", "t").limit(4 * SAMPLE).collect()
    texts, ys, n = [], [], 0
    for r in got:
        n += r.t.count(" ") + 1
        if n > SAMPLE_WORDS:
            break
        texts.append(r.t)
        ys.append(int(r.y))
    return texts, ys, rate


def score(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """df without its text, plus score (0 to 1); null and empty texts are scored as one empty window.

    The network goes to the executors as a broadcast of fixed size (3 MB); no shuffle. A column score is
    replaced, others may have any name; repeated rows get equal scores, an empty table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast((net.p, net.word_odds, net.gram_odds))
    kept, cols = plain(df, text, "score")
    state: dict[str, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            n = Network()
            n.p, n.word_odds, n.gram_odds = sent.value
            state["s"] = Scorer(n)
        for b in batches:
            got = pa.array(state["s"](b.column(0).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], got], names=[*(f"c{i}" for i in range(len(kept))), "score"])

    schema = df.select(*cols).schema.add("score", "double")
    return df.select(F.col(text).alias("t"), *cols).mapInArrow(run, schema).toDF(*kept, "score")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a network trained on the other folds' labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(*sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, net)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
