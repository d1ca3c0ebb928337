"""Snapping, pools, links, aliases, qualifiers and time bases against plain sequential versions."""

import math
import random
from fractions import Fraction

import pytest

from tidemark.operators import beats, markdown, naming, pool, qualifiers, timebase


def test_cuts_snap_one_after_the_other(spark):
    r = random.Random(4)
    grids = {"a": sorted(r.sample(range(60_000), 90)), "b": [500, 1500], "none": []}
    rows = [(s, o, b, b + r.randint(1, 9000), 12_000, r.choice("ab") if s % 7 else "none") for s in range(40) for o in range(1, r.randint(2, 9)) for b in [r.randint(0, 9000)]]
    grid_of = {}
    rows = [(*x[:5], grid_of.setdefault(x[0], x[5])) for x in rows]
    df = spark.createDataFrame(rows, "seq long, ord long, start_ms long, end_ms long, duration_ms long, grid string")
    grid = spark.createDataFrame([(g, b) for g, own in grids.items() for b in own], "grid string, beat_ms long")
    got = {(x.seq, x.ord): (x.end_ms, x.delta_ms, x.snapped, x.reason) for x in beats.snapped(df, grid).collect()}
    assert len(got) == len(rows)
    for s in grid_of:
        cuts, elapsed, own = sorted(x for x in rows if x[0] == s), 0, grids[grid_of[s]]
        for i, (_, o, b, e, most, _) in enumerate(cuts):
            at = elapsed + e - b
            move = min(own, key=lambda t: (abs(t - at), t)) - at if own else 0
            reason = "tail-cut" if i == len(cuts) - 1 else "no-beats" if not own else "span-bounds" if e + move - b < 50 or e + move > most else None
            move = 0 if reason else move
            assert got[s, o] == (e + move, move, reason is None, reason)
            elapsed = at + move


def test_pool_equals_the_sequential_replay(spark):
    r = random.Random(5)
    rows = [(w, n, r.randint(0, 400) * 100, r.random(), r.choice("xyz")) for w in (1, 2) for n in range(200)]
    rows += [(3, 0, 900, 0.1, "x"), (3, 1, 1400, 0.9, "y"), (3, 2, 1900, 0.2, "z"), (3, 3, 1401, 0.3, "x"), (3, 4, None, 1.0, "x")]
    df = spark.createDataFrame(rows, "ws long, n long, t_ms long, weight double, source string")
    got = {(x.ws, x.t_ms): (x.weight, x.source, x.n) for x in pool.candidates(df, 500, 39_000).collect()}
    want = {}
    for w in (1, 2, 3):
        kept = []
        for _, _, t, weight, source in sorted((x for x in rows if x[0] == w and x[2] is not None and 500 <= x[2] <= 39_000), key=lambda x: x[1]):
            own = next((k for k in kept if abs(k[0] - t) <= 500), None)
            if own:
                own[1], own[3] = max(own[1], weight), own[3] + 1
                own[2] += [source] if source not in own[2] else []
            else:
                kept.append([t, weight, [source], 1])
        want |= {(w, t): (a, "+".join(s), n) for t, a, s, n in kept}
    assert got == want and got[3, 900] == (0.9, "x+y", 2) and got[3, 1900] == (0.3, "z+x", 2)


def test_destinations_of_pages():
    told = "[a](b.md) [c](d(e(f)).md) [g](<h i.md>) [j](k l.md) [m](n%20o.md#p) [q](http://r.md) [s](t.png) [u]() [v](../w.md) [x](open(y.md"
    assert markdown.destinations(told) == ["b.md", "d(e(f)).md", "<h i.md>", "k l.md", "n%20o.md#p", "http://r.md", "t.png", "", "../w.md"]
    own = [markdown.target("z/p.md", raw) for raw in markdown.destinations(told)]
    assert [t and t[1] for t in own] == ["z/b.md", "z/d(e(f)).md", "z/h i.md", None, "z/n o.md", None, None, None, "w.md"] and own[3] == ("k l.md", None)
    assert markdown.destinations("](a)](b)") == ["a", "b"] and markdown.destinations("](((" * 3) == [] and markdown.target("p.md", "<") is None


def test_integrity_of_pages(spark):
    pages = [("i.md", "[a](a.md) [b](c/b.md) [x](x.md) [y](a b.md)"), ("a.md", None), ("c/b.md", "[i](../i.md) [d](d.md)"), ("c/d.md", ""), ("o.md", "[o](o.md)")]
    got = markdown.integrity(spark.createDataFrame(pages, "path string, text string"), spark.createDataFrame([("i.md",)], "node string"))
    assert {tuple(x) for x in got.collect()} == {("i.md", 4, 2, True), ("a.md", 0, 0, True), ("c/b.md", 2, 0, True), ("c/d.md", 0, 0, True), ("o.md", 1, 0, False)}


def greedy(labels):
    def tokens(label):
        out, depth = "", 0
        import re

        out = re.sub(r"\([^)]*\)", " ", label)
        return frozenset(out.split()) or frozenset([label])

    taken, groups = set(), []
    order = sorted(labels, key=lambda x: x.encode())
    for i, a in enumerate(order):
        if a in taken:
            continue
        group = [b for b in order[i + 1 :] if b not in taken and 2 * len(tokens(a) & tokens(b)) >= len(tokens(a) | tokens(b))]
        taken |= set(group)
        groups += [(a, b) for b in [a, *group]] if group else []
    return set(groups)


@pytest.mark.parametrize("seed", range(2))
def test_alias_groups_equal_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    labels = {" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) + r.choice(["", " (x)", " (y z)"]) for _ in range(150)} | {"(only)", "(only) (that)", "배지 2배", "2배 이벤트 배지", ""}
    got = naming.alias_groups(spark.createDataFrame([(x,) for x in labels], "label string"))
    assert {tuple(x) for x in got.collect()} == greedy(labels)
    assert naming.alias_groups(spark.createDataFrame([("a",), ("b",)], "label string")).count() == 0


def test_qualifiers_that_a_narrative_drops(spark):
    ledger = [("w", "요격 후보, 추진 후보. 발사 확정"), ("w", "a (코인노래방 (심야) 추정) 방문"), ("w", None), ("v", "발사 추정")]
    told = [("w", "# 요격\n- 전개: 요격은 성공\n요격(후보) 확인, **추진** 완료\n(코인노래방)\n재발사 발사\n장면 「코인노래방에서」 심야 방문"), ("v", "발사")]
    s = lambda rows: spark.createDataFrame(rows, "ws string, text string")
    assert {tuple(x) for x in qualifiers.qualified_only(s(ledger)).collect()} == {("w", "요격"), ("w", "추진"), ("w", "코인노래방"), ("v", "발사")}
    got = {(x.ws, x.line_no, x.token) for x in qualifiers.dropped_qualifiers(s(ledger), s(told)).collect()}
    assert got == {("w", 2, "요격"), ("w", 3, "추진"), ("w", 6, "코인노래방"), ("v", 1, "발사")}


def test_spans_on_a_time_base(spark):
    r = random.Random(6)
    rows = [(i, round(r.uniform(0, 99), r.randint(0, 9)), 0.0, 100.0, r.randint(0, 9), *r.choice([(1001, 30000), (1, 25), (1, 90000), (1001, 24000)])) for i in range(300)]
    rows = [(i, a, a + r.choice([0.04, 1 / 3, 1e-9, 0.5]), *x) for i, a, _, *x in rows]
    odd = [(900, 1.0, None, 100.0, 0, 1, 25), (901, float("nan"), 2.0, 100.0, 0, 1, 25), (902, 0.0, 1.0, 100.0, 0, 0, 25), (903, 2.0, 2.0, 100.0, 0, 1, 25), (904, 99.0, 100.5, 100.0, 0, 1, 25), (905, 0.0, 1.0, 0.0, 0, 1, 25), (906, 0.0, float("inf"), 9.0, 0, 1, 25), (907, 1e300, 2e300, 3e300, 0, 1, 25), (908, 1.0, 2.0, 3.0, 0, 1, 2**40)]
    df = spark.createDataFrame(rows + odd, "id long, start double, end double, duration double, origin long, num long, den long")
    got = {x.id: x for x in timebase.canonical(df).collect()}
    assert {i: got[i].code for i in range(900, 909)} == {900: "number", 901: "number", 902: "base", 903: "order", 904: "bounds", 905: "duration", 906: "number", 907: "number", 908: "base"}
    for i, a, b, duration, origin, num, den in rows:
        tick = Fraction(num, den)
        first, last = math.floor(Fraction(str(a)) / tick), math.ceil(Fraction(str(b)) / tick)
        assert got[i].code is None and (got[i].start_pts, got[i].end_pts) == (origin + first, origin + last), (a, b, num, den)
        assert got[i].start_s == pytest.approx(float(first * tick)) and got[i].end_s == pytest.approx(min(duration, float(last * tick)))
