"""Scalar functions, hand-off formats and evidence checks against plain Python and by hand."""

import json
import random
import unicodedata
from fractions import Fraction

from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import evidence, exports


def values(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()


def test_times(spark):
    r = random.Random(3)
    ms = [0, 17, 500, 999, 3_599_999, 3_600_000, 22_941_000, *(r.randrange(10**8) for _ in range(200))]
    got = values(spark, [(m,) for m in ms], "ms long", ms=F.col("ms"), f=fn.frames(F.col("ms"), 30000, 1001), g=fn.frames(F.col("ms"), 25, 2), label=fn.clock_label(F.col("ms")), back=fn.parse_clock(fn.clock(F.col("ms"))))
    for x in got:
        assert x.f == round(Fraction(x.ms * 30000, 1001 * 1000)) and x.g == round(Fraction(x.ms * 25, 2000)) and x.back == x.ms
    assert [x.label for x in got[:1] + got[5:7]] == ["00:00", "1:00:00", "6:22:21"]
    parsed = values(spark, [(t,) for t in ("12.5", "1:23.5", " 01:02:03.25 ", "", "1:2:3:4", "-1", "x", "1:-2", None)], "t string", v=fn.parse_clock(F.col("t")))
    assert [x.v for x in parsed] == [12500, 83500, 3723250] + [None] * 6


def test_rates(spark):
    rows = [("30000/1001", 1.0), ("50/2", 1.0), ("0/0", 29.97), (None, 23.976), ("", 24.6), ("a/b", 0.2)]
    got = values(spark, rows, "e string, fps double", r=fn.frame_rate(F.col("e"), F.col("fps")))
    assert [tuple(x.r) for x in got] == [(30000, 1001), (25, 1), (30000, 1001), (24000, 1001), (25, 1), (1, 1)]


def test_text(spark):
    sizes = [0, 1023, 1024, 1280, 1331, 1048575, 1048576, 5 * 1024**4, 3000 * 1024**4]

    def human(n):
        size = float(n)
        for u in "BKMGT":
            if size < 1024 or u == "T":
                return f"{int(size)}B" if u == "B" else f"{size:.1f}{u}"
            size /= 1024

    assert [x.s for x in values(spark, [(n,) for n in sizes], "n long", s=fn.human_size(F.col("n")))] == [human(n) for n in sizes]
    labels = ["a/b", "a|b", "a%2Fb", " ", "x" * 90, "y" * 80, "ok", "가#나"]
    got = [x.s for x in values(spark, [(t,) for t in labels], "t string", s=fn.slug(F.col("t")))]
    assert len(set(got)) == len(labels) and got[:4] == ["a%2Fb", "a%7Cb", "a%252Fb", "_"] and len(got[4]) == 80 and got[5:] == ["y" * 80, "ok", "가%23나"]
    got = values(spark, [("나는 서울에서 갔다", "나는 부산에서 돈까스를 먹었어 12 BGM·고함"), ("a", "(주석) 환각"), ("", ""), (None, "집")], "a string, c string", t=fn.new_terms(F.col("a"), F.col("c")))
    assert [x.t for x in got] == [["부산", "돈까스", "12"], [], [], None]
    text = ["Straßé", "é", "", None]
    got = values(spark, [(t,) for t in text], "t string", n=fn.nfc(F.col("t")), f=fn.folded(F.col("t")))
    assert [(x.n, x.f) for x in got] == [(t and unicodedata.normalize("NFC", t), t and unicodedata.normalize("NFC", t).casefold()) if t is not None else (None, None) for t in text]
    got = values(spark, [('{"b": 1, "a": [true, "é"]}',), ("{",), (None,)], "t string", j=fn.canonical_json(F.col("t")))
    assert [x.j for x in got] == ['{"a":[true,"é"],"b":1}', None, None]
    lines = values(spark, [("a\r\nb\u0001* COMMENT: c\n",), ("",), ("x\ny",)], "t string", s=fn.single_line(F.col("t")))
    assert [x.s for x in lines] == ["a b�COMMENT: c", "", "x y"]


def test_small_predicates(spark):
    got = values(spark, [([[0.0, 0.0, 0.3, 0.2], [0.0, 0.0, 0.1, 0.1]],), ([[0.0, 0.0, 0.1, 0.1]],), ([[0.0, 0.0, 0.01, 0.1]],), ([],), (None,)], "b array<array<double>>", s=fn.shot_scale(F.col("b")))
    assert [x.s for x in got] == ["close", "medium", "long", None, None]
    got = values(spark, [("1, 2,3,4",), ("1,2,0,4",), ("1,2,3",), ("a,2,3,4",), (None,)], "t string", r=fn.roi(F.col("t")))
    assert [x.r and tuple(x.r) for x in got] == [(1, 2, 3, 4), None, None, None, None]
    got = values(spark, [(0.5, 0.0, 0.0), (0.9, -2.0, 1.0), (None, -1.5, None), (None, None, 0.6), (None, None, None)], "c double, l double, n double", u=fn.uncertain(F.col("c"), F.col("l"), F.col("n")))
    assert [x.u for x in got] == [True, False, True, True, False]


def test_segment_keys(spark):
    d = spark.createDataFrame([(x,) for x in ("3", "3.0", '"3"', '" 3 "', "3.5", "-1", "true", "null", '""', "{}")], "t string").select(evidence.segment_key(F.parse_json("t")).alias("k"))
    assert [x.k for x in d.collect()] == ["n:3", "n:3", "s:3", "s:3", "n:3.5"] + [None] * 5


def test_support(spark):
    ck = spark.createDataFrame([(1, "a", 0, 10, ["x", "y"]), (1, "b", 0, 10, ["x", "z"]), (1, "c", 0, 10, []), (1, "d", 0, 10, None), (1, "e", 10, 20, ["x"]), (1, "f", 4, 6, ["x", None])], "ws long, id string, start_ms long, end_ms long, refs array<string>")
    seg = spark.createDataFrame([(1, "x", 0, 10), (1, "y", 20, 30), (1, "y", 9, 12), (1, "z", 5, 5), (2, "z", 0, 9)], "ws long, ref string, start_ms long, end_ms long")
    got = {x.id: x.supported for x in evidence.segment_support(ck, seg).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}
    assert evidence.segment_support(ck.limit(0), seg).count() == 0


def test_edl_and_documents(spark):
    cuts = spark.createDataFrame([(1, k, k * 1000, 500, f"n{k}") for k in range(1000)] + [(2, k, 0, 1001, "n") for k in range(999)], "seq long, ord long, start_ms long, length_ms long, note string")
    blocks = exports.edl(cuts, "c.mp4", 30000, 1001)
    assert {x.seq for x in blocks.select("seq").distinct().collect()} == {2}
    assert [(x.seq, x.events) for x in exports.edl_refused(cuts).collect()] == [(1, 1000)]
    text = exports.document(blocks, "seq", "ord", "H\n").collect()[0].text
    assert text.startswith("H\n001  AX       V     C        00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00\n* FROM CLIP NAME: c.mp4\n* COMMENT: n\n\n002 ")
    note = values(spark, [("one\ntwo", ["c\n1"], None), ("one", None, ["s"]), ("one", None, None)], "n string, i array<string>, s array<string>", t=exports.note(F.col("n"), F.col("i"), F.col("s")))
    assert [x.t for x in note] == ["one | grounding: checkpoint:c 1", "one | grounding: signal:s", "one"]
    c = spark.createDataFrame([(1, 1, 0, 500, 'a"<', "cut", "n&")], "seq long, ord long, start_ms long, length_ms long, name string, status string, note string")
    assert 'name="a&quot;&lt;"' in exports.fcpxml(c, 25, 1).collect()[0].block
    assert json.loads(exports.otio(c, 25, 1).collect()[0].block)["source_range"]["duration"]["value"] == 12.0
