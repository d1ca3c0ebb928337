"""Operators on hand-made frames and against short plain-Python versions."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import folds, intervals, ledger
from tidemark.sources import ledger_files


def spans(spark, rows):
    return spark.createDataFrame(rows, "ws long, start_us long, end_us long")


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_union_and_difference_random(spark):
    r = random.Random(5)
    left = [(w, s, s + r.randint(1, 9)) for w in range(12) for s in [r.randint(0, 60) for _ in range(8)]]
    right = [(w, s, s + r.randint(1, 9)) for w in range(10) for s in [r.randint(0, 60) for _ in range(6)]]
    got = {(x.ws, x.start_us, x.end_us) for x in intervals.union(spans(spark, left), ["ws"], "start_us", "end_us").collect()}
    assert got == {(w, s, e) for w in range(12) for s, e in merged([(a, b) for v, a, b in left if v == w])}
    diff = intervals.difference(spans(spark, left), spans(spark, right), ["ws"], "start_us", "end_us").collect()
    points = lambda rows, w: {p for v, a, b in rows if v == w for p in range(a, b)}
    for w in range(12):
        assert {p for x in diff if x.ws == w for p in range(x.start_us, x.end_us)} == points(left, w) - points(right, w)


def test_touching_spans_merge_and_empty(spark):
    assert [(x.start_us, x.end_us, x.n) for x in intervals.union(spans(spark, [(1, 0, 5), (1, 5, 7)]), ["ws"], "start_us", "end_us").collect()] == [(0, 7, 2)]
    assert intervals.union(spans(spark, []), ["ws"], "start_us", "end_us").count() == 0


def test_gaps_count_only_above_least(spark):
    g = intervals.gaps(spans(spark, [(1, 3, 10), (1, 14, 20)]), ["ws"], "start_us", "end_us", F.lit(30).cast("long"), F.lit(3)).collect()
    assert sorted((x.gap_start, x.gap_end) for x in g) == [(10, 14), (20, 30)]


def test_overlap_join_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (1, 50, 60)], "ws long, start long, end long")
    b = spark.createDataFrame([(1, 10, 55), (1, 60, 70), (2, 0, 9)], "ws long, rstart long, rend long")
    got = sorted((x.start, x.rstart) for x in intervals.overlap_join(a, b, ["ws"], 7).collect())
    assert got == [(0, 10), (0, 60), (50, 10)]


def test_asof_both_directions(spark):
    p = spark.createDataFrame([(1, 5), (1, 10), (1, 0)], "ws long, t long")
    e = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "ws long, at long, v string")
    assert {x.t: x.v for x in intervals.asof(p, e, ["ws"], "t", "at", "v").collect()} == {0: None, 5: "a", 10: "b"}
    assert {x.t: x.v for x in intervals.asof(p, e, ["ws"], "t", "at", "v", backward=False).collect()} == {0: "a", 5: "a", 10: None}


def test_guard_equals_a_sequential_replay(spark):
    r = random.Random(2)
    rows = [(1, str(r.randint(0, 9)), i, r.choice(["hypothesized", "verified", "corrected", "bad"]), 0, 5, r.choice([None, 0.5, 1.5])) for i in range(300)]
    log = spark.createDataFrame(rows, "ws long, id string, line_no long, status string, start_us long, end_us long, confidence double")
    last, state = {}, {}
    for _, i, n, s, _, _, c in rows:
        if s == "bad" or (c is not None and c > 1) or (s == "hypothesized" and state.get(i) in ("verified", "corrected")):
            continue
        state[i], last[i] = s, n
    assert {x.id: x.line_no for x in ledger.latest(log, 10).collect()} == last


def test_validation_codes(spark):
    rows = [(1, " ", 1, "verified", 0, 1, None), (1, "a", 2, "verified", 5, 5, None), (1, "a", 3, "verified", 0, 11, None), (1, "a", 4, None, 0, 1, None), (1, "a", 5, "verified", 0, 1, float("nan"))]
    log = spark.createDataFrame(rows, "ws long, id string, line_no long, status string, start_us long, end_us long, confidence double")
    assert [x.code for x in ledger.validated(log, 10).orderBy("line_no").collect()] == ["id", "span", "duration", "status", "confidence"]


def test_scene_gap_anchor_moves(spark):
    hits = spark.createDataFrame([("a", 0, 0.5), ("a", 900, 0.9), ("a", 1800, 0.6), ("a", 2000, 0.4)], "ws string, t_ms long, score double")
    assert [(x.t_ms, x.score) for x in folds.scene_gap(hits).collect()] == [(900, 0.9), (2000, 0.4)]


def test_lanes_do_not_overlap(spark):
    r = random.Random(1)
    rows = [(1, str(i), s, s + r.randint(1, 20)) for i in range(60) for s in [r.randint(0, 100)]]
    got = {x.id: x.lane for x in folds.lanes(spark.createDataFrame(rows, "ws long, id string, start_us long, end_us long")).collect()}
    for _, i, s, e in rows:
        for _, j, s2, e2 in rows:
            assert i == j or got[i] != got[j] or e <= s2 or e2 <= s


def test_jsonl_rejects_and_bool_is_no_number(spark, tmp_path):
    lines = ['{"id": "a", "t": 1.5}', "{broken", '{"id": "b", "t": true}', "", '{"id": "c"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.DoubleType())])
    ok, bad = ledger_files.jsonl(spark, str(tmp_path), schema)
    assert sorted((x.line_no, x.id, x.t) for x in ok.collect()) == [(1, "a", 1.5), (5, "c", None)]
    assert sorted(x.line_no for x in bad.collect()) == [2, 3]
    assert json.loads(lines[0])["id"] == "a"


def test_subtitles(spark, tmp_path):
    (tmp_path / "x.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n<i>Hello</i>\nthere\n\n2\n01:00:00,000 --> 01:00:01,000\nend\n")
    got = sorted((x.start_ms, x.end_ms, x.text) for x in ledger_files.subtitles(spark, str(tmp_path)).collect())
    assert got == [(1500, 2000, "Hello there"), (3600000, 3601000, "end")]
