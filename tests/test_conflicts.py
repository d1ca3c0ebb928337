"""Names of kept files against a walk from slot to slot, and authored blocks."""

import random

from pyspark.sql import functions as F

from tidemark.operators import conflicts


def called(name, slot):
    at = name.rfind(".")
    at = at if 0 < at < len(name) - 1 else len(name)
    return name if slot == 1 else f"{name[:at]}--{slot}{name[at:]}"


def walked(sources, existing):
    held = {(w, n): d for w, n, d in existing}
    out = {}
    for w, name, n, d in sorted(sources, key=lambda x: (str(x[0]), x[1], x[2])):
        slot = 1
        while (w, called(name, slot)) in held and held[w, called(name, slot)] != d:
            slot += 1
        target = called(name, slot)
        out[w, name, n] = (target, (w, target) not in held)
        held[w, target] = d
    return out


def test_names_equal_the_walk(spark):
    r = random.Random(7)
    for seed in range(3):
        existing = [(w, called(n, s), r.choice("abcdefghij")) for w in (1, 2, None) for n in ("x.md", "y.tar.gz", ".z", "q.") for s in r.sample(range(1, 25), 11 + seed)]
        existing += [(1, "x--02.md", "a"), (1, "x--1.md", "b"), (1, "--2.md", "c"), (1, "other.md", "d"), (1, "a--7.b--2", "e")]
        sources = [(w, n, i, r.choice("abcdefghijklmnopqrstuvwxyz")) for w in (1, 2, None, 4) for n in ("x.md", "y.tar.gz", ".z", "q.", "new") for i in range(25)]
        a = spark.createDataFrame(sources, "ws long, name string, n long, digest string")
        b = spark.createDataFrame(existing, "ws long, name string, digest string")
        got = {(x.ws, x.name, x.n): (x.target, x.moved) for x in conflicts.kept_names(a, b).collect()}
        assert got == walked(sources, existing)
    assert conflicts.kept_names(a.limit(0), b).count() == 0 and conflicts.kept_names(a, b.limit(0)).where("moved").count() > 0


def test_authored_blocks(spark):
    t = "\n## What\n(to be written)\n"
    rows = ["a <s>\n ## What\n(to be written) \n<e>", "a <s>told<e> <s>(x)<e>", "<e> <s> x", "<s><e>", "", None, "<s>## What\n\n(x)\n  told \n## More\nnot<e>", f"<s>{t}<e>"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    b = conflicts.block("text", "<s>", "<e>", t)
    got = {x.i: (x.a, x.h) for x in df.select("i", conflicts.authored("text", "<s>", "<e>", t).alias("a"), conflicts.head(b, "What").alias("h")).collect()}
    assert [got[i][0] for i in range(8)] == [False, True, False, True, False, None, True, False]
    assert [got[i][1] for i in range(8)] == [None] * 6 + ["told", None]
    assert df.where(F.col("i") == 1).select(b.alias("b")).first().b == "told"
