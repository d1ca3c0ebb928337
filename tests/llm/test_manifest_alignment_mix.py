"""The Merkle manifest, the alignment of tokenizers and the curriculum against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tidemark.llm.merkle")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import alignment, bpe, common, merkle, mixing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def told(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


@pytest.mark.parametrize("ranges", [1, 5, 23])
def test_manifest_equals_brute_force(spark, tmp_path, ranges):
    """Groups of 1 to 700 leaves, over 256 sources, ranges that cut runs anywhere."""
    sizes = [1, 2, 15, 16, 17, 256, 257, 700] + [1] * 260
    rows = [(100_000 * g + 7 * i, f"Tx{i} É {g}", None if i % 3 else "EN", f"s{g}" if g else None, i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(5).shuffle(rows)
    spark.createDataFrame(rows, DOCS).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r.doc_id: tuple(r)[1:] for r in merkle.op11_merkle(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in sorted(rows, key=lambda r: r[0]):
        groups[source].append((doc_id, source, lang, n, text))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([sha(told(r)) for r in groups[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    assert len(top) > 2 and len(got) == len(rows)
    for at, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
            node, beside = sha(told((*r[:4], text))), ""
            for tree, k in ((trees[s], i), (top, at)):
                for nodes in tree[:-1]:
                    run, j = nodes[k // 16 * 16 : k // 16 * 16 + 16], k % 16
                    beside += "".join(run[:j] + run[j + 1 :])
                    node, k = sha("".join([*run[:j], node, *run[j + 1 :]])), k // 16
            root = top[-1][0]
            assert got[r[0]] == (trees[s][0][i], trees[s][-1][0], root, sha(beside), node, node == root)


def test_manifest_of_repeated_and_null_rows_and_clashing_names(spark):
    rows = [(None, "a", "x"), (None, "a", "x"), (3, None, "x"), (1, "b", None), (1, "a", None)]
    df = spark.createDataFrame(rows, "k long, t string, src string").select("*", merkle.digest("k", "src", "t").alias("leaf"), *(F.lit("own").alias(c) for c in ("g", "run", "nodes", "_row", "path", "c0")))
    got = merkle.manifest(df, "src", ["k"]).orderBy("src", "at").collect()
    assert [(r.src, r.k, r.at, r.of) for r in got] == [(None, 1, 0, 2), (None, 1, 1, 2), ("x", None, 0, 3), ("x", None, 1, 3), ("x", 3, 2, 3)]
    assert got[0].leaf < got[1].leaf and all(r.g == r.run == r.nodes == r._row == r.c0 == "own" for r in got)
    assert len({r.root for r in got}) == 1 and merkle.manifest(df.limit(0), "src", ["k"]).count() == 0
    one = merkle.manifest(df.limit(1), "src", ["k"]).collect()[0]
    assert one.root == one.group_root == one.leaf and one.path == []


# alignment


def both():
    return alignment.pair(bpe.default_path("byte_bpe_50k.json"), bpe.default_path("piece_bpe_32k.model"))


def whole(text):
    """Ids of the whole text by both libraries, None where their bytes are not the text's."""
    p = both()
    a, b = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
    raw = (" " + text).encode()
    same = b"".join(p.bytes_a[i] for i in a) == raw == b"".join(p.bytes_b[i] for i in b)
    return (a, b) if same else None


def test_segments_are_tokenised_as_in_the_whole_text():
    p, r = both(), random.Random(3)
    assert p.breaks == " \n\t"  # carriage returns stand inside pieces
    signs = "ab \n\t\r.,;)'sé1İ ́Σ日\x1c\x85\xa0 ​　\x00<|endoftext|>😀▁"
    odd = [" ", "  ", "foo ", "foo\n", "\nfoo", "a;\r\nb", "x▁y", "<s> </s> <0x41>", "<|endoftext|> a<|endoftext|>", "z" * 3000, "\x00"]
    for t in odd + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(4000)]:
        cut = p.segments(t)
        assert "".join(cut) == " " + t
        a, b = p.encoded(cut)
        if whole(t):
            assert (sum(a, []), sum(b, [])) == whole(t), repr(t)
        else:
            assert None in [p.aligned(*x) for x in zip(cut, a, b, strict=True)]


def test_alignment_equals_brute_force(spark, monkeypatch):
    """Small blocks, so that segments meet again over blocks; texts without tokens count nowhere."""
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 400)
    r = random.Random(9)
    words = "the of and antidisestablishment naïve 日本語 \n\n 12345 don't  two\tx".split(" ")
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "the ▁ of the"), (203, "the of and"), (204, "the ▁ naïve"), (204, "the ▁ naïve"), (205, "q" * 2000 + " the"), (None, "of the"), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("segment", F.lit(1)).withColumn("block", F.lit("x"))
    got, pairs, known = alignment.aligned(df, bpe.default_path("byte_bpe_50k.json"), bpe.default_path("piece_bpe_32k.model"))
    p, links, out, count = both(), [], [], Counter()
    for d, t in docs:
        ids = whole(t) if t else None
        a, b = ids or ([], [])
        spans = []
        for side, sizes in ((a, p.bytes_a), (b, p.bytes_b)):
            at, mine = 0, []
            for i in side:
                mine.append((at, at + len(sizes[i]), i))
                at += len(sizes[i])
            spans.append(mine)
        link = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])]
        groups = []
        for end in sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}):
            start = groups[-1][0] if groups else 0
            groups.append((end, "|".join(",".join(str(i) for s, e, i in mine if start <= s and e <= end) for mine in spans)))
        links.append(link)
        count.update(link)
        out.append((d, len(a), len(b), len(groups), len(link), hashlib.sha256(";".join(g for _, g in groups).encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    want = Counter((*o[:5], sum(count[x] == top[x[1]] for x in link), sum(count[x] for x in link), o[5]) for o, link in zip(out, links, strict=True))
    assert Counter(tuple(x) for x in got.collect()) == want
    assert {(x.pair >> 32, x.pair & 0xFFFFFFFF): x.n for x in pairs.collect()} == dict(count)
    assert known.count() == known.select("segment").distinct().count()


# mixing


def shared(totals, weights, most=3):
    """Targets by the rule itself: share, cap, share what is left again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        rest = sum(totals.values()) - sum(most * totals[s] for s in full)
        level = sum(w for s, w in weight.items() if s not in full)
        target = {s: most * totals[s] if s in full else rest * weight[s] / level for s in totals}
        over = {s for s in totals if s not in full and target[s] > most * totals[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_reaches_targets_and_follows_the_schedules(spark, seed):
    r = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "zz"]
    docs = [(i, "w " * min(3000, int(r.paretovariate(0.8) * 5)), "en", s, 0) for i, s in enumerate(r.choices(names, [1, 2, 300, 3, 8, 60, 9], k=900))]
    docs += [(5000, None, None, "a", None), (5001, " \n", None, "empty", None), (None, "x y z", None, "a", None), (None, "x y z", None, "a", None)]
    df = spark.createDataFrame(docs, DOCS).withColumn("size", F.lit("x")).withColumn("position", F.lit(1))
    copies = mixing.mix(df.repartition(4), seed=seed).collect()
    totals = Counter()
    for d in docs:
        totals[d[3]] += len((d[1] or "").split())
    totals["empty"] += 0
    want, took, rows = shared(totals, mixing.WEIGHTS), Counter(), defaultdict(list)
    for x in copies:
        took[x.source] += x.words
        rows[x.row].append(x)
        assert x.target == pytest.approx(want[x.source]) and x.source_size == totals[x.source]
    assert len(rows) == len(docs) and any(v == 3 * totals[s] for s, v in want.items() if totals[s])
    for s in totals:
        assert took[s] == int(want[s] + 1e-9)
    for mine in rows.values():
        assert sum(x.words for x in mine) <= 3 * mine[0].size and all(0 < x.words <= x.size for x in mine if x.copy is not None)
        assert len(mine) > 1 or mine[0].copy in (None, 0)
    # the order of positions, and each source's demand at any time
    at = [x.position for x in copies if x.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    for s in totals:
        schedule = mixing.SCHEDULES[order.index(s) % 3]
        whole_ = area(schedule, 1.0)
        given, largest = 0, max([x.size for x in copies if x.source == s])
        for x in sorted((x for x in copies if x.source == s and x.position is not None), key=lambda x: (x.position, x.copy)):
            assert abs(given - int(want[s] + 1e-9) * area(schedule, x.position) / whole_) < 1e-6 * (1 + want[s]), (s, largest)
            given += x.words
    again = mixing.mix(df.repartition(7), seed=seed).collect()
    key = lambda x: (x.doc_id or -1, x.copy or 0, x.words, x.position or -1)
    assert sorted(map(key, again)) == sorted(map(key, copies))


def area(schedule, t):
    out = 0.0
    for (t0, f0), (t1, f1) in zip(schedule, schedule[1:], strict=False):
        e = min(t, t1)
        if e > t0:
            out += (e - t0) * (f0 + f0 + (f1 - f0) * (e - t0) / (t1 - t0)) / 2
    return out


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    only = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], DOCS)).collect()
    assert [(x.words, x.target, x.position) for x in only] == [(0, 0.0, None)] * 2


def test_ranges_of_a_group(spark):
    rows, ranges = common.ranked(spark.createDataFrame([("a", i) for i in range(900)] + [("b", 1)], "g string, v long").repartition(5), ["v"], ("v",))
    placed = rows.join(ranges, ["g", "_part"]).selectExpr("g", "v", "before_n + _row - _first as at", "all_v").collect()
    assert all(x.at == x.v or x.g == "b" and x.at == 0 for x in placed) and {x.all_v for x in placed} == {sum(range(900)), 1}
