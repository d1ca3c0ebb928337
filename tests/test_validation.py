"""Letting in, text functions, and whole rules, at their edges."""

import html
import re

from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import corpus_audit, intervals, series, signals, transcript, validation, wiki


def test_recognised_speech(spark):
    nan = float("nan")
    seg = [(1, 0, 0.0, 2.0, " a b ", 1.0, -0.5), (1, 1, 2.0, 3.0, " ", 9.0, -9.0), (1, 2, None, 3.0, "x", None, -9.0), (1, 3, 3.0, nan, "y", None, None), (2, 0, 0.0, 1.0, "la " * 12, None, None), (2, 1, 0.0, 1.0, "z", 2.5, None), (3, 0, 0.0, 1.0, "q", 2.4, -1.0), (3, 1, 1.0, 2.0, "r", None, -1.1), (4, 5, 0.0, 1.0, "s", None, None), (5, 0, 0.0, 1.0, None, None, None)]
    w = [(1, 0, 0, 0.0, 1.0, 0.5), (1, 0, 1, 1.0, 1.7504, None), (1, 0, 2, 1.8, None, 0.9), (4, 5, 0, 0.0, 0.5, 0.0999)]
    a = spark.createDataFrame(seg, "ws long, id long, start double, end double, text string, compression double, logprob double")
    b = spark.createDataFrame(w, "ws long, id long, n long, start double, end double, p double")
    checked = validation.recognised(a, b)
    got = {(x.ws, x.id): (x.end, x.conf, x.code) for x in checked.collect()}
    assert got == {(1, 0): (1.75, 0.5, None), (1, 2): (3.0, None, "unplaced"), (1, 3): (None, None, "unplaced"), (2, 0): (1.0, None, "repeated"), (2, 1): (1.0, None, "repeated"), (3, 0): (1.0, None, None), (3, 1): (2.0, None, "logprob"), (4, 5): (0.5, 0.1, "words")}
    assert {(x.ws, x.code, x.id) for x in validation.results(checked).collect()} == {(1, None, None), (2, "repeated", 0), (3, "logprob", 1), (4, "words", 5)}


def test_observations_bindings_and_spans(spark):
    rows = [("person_presence", " p ", "present", 1.0), (None, "p", "present", 1.0), ("person_presence", "\u2003", "present", 1.0), ("person_presence", "p", "gone", 1.0), ("person_presence", "p", "absent", float("inf")), ("person_presence", "p", "absent", 2.0), ("person_presence", None, None, None)]
    df = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "k string, s string, st string, t double, a double, b double")
    assert [x.c for x in df.select(validation.presence_code("k", "s", "st", "t", "a", "b").alias("c")).collect()] == [None, "kind", "subject", "state", "timestamp", "outside", "subject"]
    rec = spark.createDataFrame([(1, "a", "b"), (1, "a", None), (1, "a", "c"), (2, None, None), (3, "a", "b")], "ws long, x string, y string")
    man = spark.createDataFrame([(1, "a", "b"), (3, None, "b")], "ws long, x string, y string")
    assert sorted((x.ws, x.y or "", x.code or "") for x in validation.bound_records(rec, man, ["x", "y"]).collect()) == [(1, "", "missing"), (1, "b", ""), (1, "c", "mismatch"), (2, "", ""), (3, "b", "")]
    sp = spark.createDataFrame([(0.0, 10.0), (0.0, 10.4), (0.0, 10.6), (10.2, 10.4), (None, None)], "start double, end double").withColumn("duration", F.lit(10.0))
    assert [(x.end, x.clamped, x.refused) for x in validation.backfilled(sp, 0.1, 0.05).collect()] == [(10.0, False, None), (10.0, True, None), (10.6, False, "beyond"), (10.4, False, "start"), (None, False, None)]


def test_texts(spark):
    texts = ["", "short", "word " * 20, "x" * 50, "한국어 제목 " * 9, "a/b:c*? [d] .", "😀" * 70, "😀 " * 39 + "end of it all", "`a``b", "no tick", 'm <"&\'\\[x]|`\r\ny\rz', None, "tail, of the words, cut, her (e and on", " .. ", "w" * 41 + " " + "v" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    got = {x.i: x for x in df.select("i", fn.tag(t).alias("tag"), fn.ellipsized(t).alias("cut"), fn.doc_stem(t).alias("stem"), fn.code_span(t).alias("code"), fn.diagram_label(t).alias("label"), fn.url_folder(t).alias("url")).collect()}

    def stem(s):
        s = re.sub(r"\s+", " ", re.sub(fn.UNSAFE_STEM, " ", s or "")).strip(" .")
        if len(s) <= 80 and len(s.encode()) <= 245:
            return s
        c = s[:80]
        while len(c.encode()) > 245:
            c = c[:-1]
        at = c.rfind(" ")
        return (c[:at] if at >= 0 and at >= len(c) // 2 else c).strip()

    for i, s in enumerate(texts):
        assert got[i].stem == stem(s)
        if s is None:
            assert got[i].tag is None and got[i].cut is None and got[i].code is None and got[i].label is None and got[i].url is None
            continue
        assert got[i].tag == re.sub(r"\s+", "-", s.strip())
        c = s[:40]
        want = s if len(s) <= 40 else (c[: c.rfind(" ")] if c.rfind(" ") > 20 else c).rstrip(" ,·—-(") + "…"
        assert got[i].cut == want
        run = "`" * (max([len(r) for r in re.findall("`+", s)], default=0) + 1)
        pad = " " if s.startswith("`") or s.endswith("`") else ""
        assert got[i].code == run + pad + s + pad + run
        label = html.escape(s.replace("\r\n", "\n").replace("\r", "\n"))
        for a, b in (("\\", "&#92;"), ("[", "&#91;"), ("]", "&#93;"), ("|", "&#124;"), ("`", "&#96;"), ("\n", "&#10;")):
            label = label.replace(a, b)
        assert got[i].label == label


def test_whole_rules_at_their_edges(spark):
    seg = spark.createDataFrame([(1, 0, 0, 9000, "own", 0.5), (1, 1, 9000, 9500, "one", None), (1, 2, 20_000, 26_000, "x y", 0.7), (2, 0, 0, 100, "none", 0.1)], "ws long, id long, start_ms long, end_ms long, text string, conf double")
    w = spark.createDataFrame([(1, 1, 0, 500, " a", 0.5), (1, 2, 2000, 2500, " b", None), (1, 3, 9005, 9100, " c", 0.9), (1, 4, 20_000, 20_400, " d", None), (1, 5, 22_000, 22_400, " e", 0.3)], "ws long, n long, start_ms long, end_ms long, word string, p double")
    got = [tuple(x) for x in transcript.split_segments(seg, w).orderBy("ws", "id").collect()]
    # a pause of exactly 1.5 s splits nothing; the word at 9005 ms belongs to both of its neighbours
    assert got == [(1, 0, 0, 2500, "a b", 0.25), (1, 1, 9005, 9100, "c", 0.9), (1, 2, 9000, 9500, "one", None), (1, 3, 20_000, 20_400, "d", 0.7), (1, 4, 22_000, 22_400, "e", 0.3), (2, 0, 0, 100, "none", 0.1)]
    frames = spark.createDataFrame([(1, 0, 5, 40), (1, 1, 45, 40), (2, 0, 0, 40), (2, 1, 41, 40)], "ws long, idx long, pts long, duration long")
    heads = spark.createDataFrame([(1, 5, 2, 80), (2, 0, None, None), (3, 0, 0, 0)], "ws long, start_pts long, nb_frames long, duration_ts long")
    assert {x.ws: (x.first_ok, x.count_ok, x.length_ok, x.lattice_ok, x.proven) for x in signals.cadence(frames, heads, 40, 1).collect()} == {1: (True,) * 5, 2: (True, True, True, False, False), 3: (False,) * 5}
    spans = spark.createDataFrame([(1, -5, 3), (1, 3, 4), (1, 9, 30), (1, 12, 15), (1, -9, -1)], "ws long, s long, e long")
    assert {tuple(x) for x in intervals.union_within(spans, ["ws"], "s", "e", F.lit(10)).collect()} == {(1, 0, 4, 2), (1, 9, 10, 1)}
    media = spark.createDataFrame([(1, 10_000), (2, 150), (3, 0), (4, 1200)], "ws long, duration_ms long")
    at = {}
    for x in series.tail_samples(media).collect():
        at.setdefault(x.ws, []).append(x.t_ms)
    assert {k: sorted(v) for k, v in at.items()} == {1: [7300, 7925, 8550, 9175, 9800], 2: [0], 4: [0, 250, 500, 750, 1000]}
    one = spark.createDataFrame([("a", 1, 0, 4900.2)], "ws string, i long, t_ms long, value double")
    assert signals.scenes_by_rate(one, 4900.2).count() == 1 and signals.scenes_by_rate(one.withColumn("value", F.lit(490.0)), 4900.2).count() == 0
    ca = spark.createDataFrame([(1, "x"), (2, "x"), (4, "x")], "ws long, image string")
    docs = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "ws long, declared long")
    got = {x.ws: (x.doc_present, x.catalog, x.indexed, x.stale) for x in wiki.published(ca, ca, docs).collect()}
    assert got == {1: (True, 1, 1, False), 2: (True, 1, 1, True), 3: (True, 0, 0, False), 4: (False, 1, 0, True)}
    shown = corpus_audit.shown(ca, ["ws", "image"], 2).collect()
    assert [(x.ws, x.place, x.total) for x in shown] == [(1, 1, 3), (2, 2, 3)] and corpus_audit.shown(ca.limit(0), ["ws"]).count() == 0
