"""File sources by byte range, the tailing source, keyed state and the phrase index, against whole files and plain folds."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import folds, ledger, search, signals
from tidemark.sources import ledger_files, line_source
from tidemark.streaming import keyed
from tidemark.streaming.tail_source import TailReader, TailSource

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_splits_have_the_numbers_of_the_whole_file(spark, tmp_path, small_splits):
    r = random.Random(1)
    want = {}
    for name in ("a", "b", "sub/c"):
        rows = [b"" if r.random() < 0.1 else ("é" * r.randint(0, 300) + str(i)).encode() for i in range(200)]
        end = [b"\n", b"\r\n"][r.random() < 0.5]
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(end.join(rows) + (end if name == "a" else b""))
        want |= {(path.name, i): x.decode() for i, x in enumerate(path.read_bytes().splitlines(), 1)}
    (tmp_path / "empty.jsonl").write_bytes(b"")
    got = line_source.numbered(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 20
    assert {(os.path.basename(x.file), x.line_no): x.raw for x in got.collect()} == want and got.count() == len(want)


def test_records_and_rejects(spark, tmp_path, small_splits):
    rows = [b'{"k": 1, "t": "a", "x": [1]}', b"", b'{"k": true}', b"[1]", b'{"k": 2', b'{"k": "3"}', b'{"t": "\xff"}', b'{"t": "z"}', b"  "]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(rows * 50))
    good, bad = ledger_files.jsonl(spark, str(tmp_path), ROW)
    want = {(9 * i + j) for i in range(50) for j in (1, 8)}
    assert {x.line_no for x in good.collect()} == want and bad.count() == 250
    (tmp_path / "b.jsonl").write_bytes(b"[1]\n{")
    with pytest.raises(ValueError, match="b.jsonl"):
        ledger_files.jsonl(spark, str(tmp_path), ROW, strict=True)


def test_transcripts(spark, tmp_path):
    items = [{"start": 0, "end": 1.5, "text": "a", "extra": [1]}, {"start": 1, "end": 1, "text": "b"}, {"start": True, "end": 2, "text": "c"}, {"start": -1, "end": 2, "text": "d"}, {"start": 0, "end": 2, "text": 5}, "e", None, {"end": 3, "text": "f"}, {"start": 2, "end": 1e400, "text": "g"}, {"start": 3, "end": 4, "text": ""}]
    text = json.dumps(items).replace("Infinity", "1e400")
    for name, told in (("good", text), ("object", "{}"), ("broken", "["), ("none", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "transcript.json").write_text(told)
    got = line_source.transcripts(spark, str(tmp_path)).collect()
    assert [(x.at, x.start, x.end, x.text) for x in sorted(got)] == [(0, 0.0, 1.5, "a"), (9, 3.0, 4.0, "")]
    assert json.loads(min(got).item)["extra"] == [1]
    assert line_source.transcripts(spark, str(tmp_path / "none"), strict=True).count() == 0
    assert line_source.transcripts(spark, str(tmp_path / "good"), strict=True).count() == 2
    for name in ("object", "broken"):
        with pytest.raises(ValueError, match=name):
            line_source.transcripts(spark, str(tmp_path / name), strict=True)
    (tmp_path / "none" / "transcript.json").write_text('[{"start": 1}]')
    with pytest.raises(ValueError, match="no valid segments"):
        line_source.transcripts(spark, str(tmp_path / "none"), strict=True)


# the tailing source


def drained(reader, start):
    end = json.loads(json.dumps(reader.latestOffset()))
    return [(os.path.basename(f), line) for p in reader.partitions(start, end) for f, _, _, line in reader.read(p)], end


@pytest.mark.parametrize("split", [1, 7, 1 << 20])
def test_tail_reads_each_line_once(tmp_path, split):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    reader = TailReader(str(tmp_path), ".txt", split)
    assert drained(reader, {}) == ([], {})
    a.write_bytes(b"one\ntwo\r\nthr")
    got, at = drained(reader, {})
    assert got == [("a.txt", "one"), ("a.txt", "two")]
    a.write_bytes(a.read_bytes() + b"ee\n\nfour\n")
    b.write_bytes(b"x" * 10_000 + b"\nlast")
    got, at = drained(TailReader(str(tmp_path), ".txt", split), at)  # a restart knows the offset alone
    assert got == [("a.txt", "three"), ("a.txt", ""), ("a.txt", "four"), ("b.txt", "x" * 10_000)]
    assert drained(reader, at)[0] == []
    a.write_bytes(b"one\ntwo\n")  # cut
    got, at = drained(reader, at)
    assert got == [("a.txt", "one"), ("a.txt", "two")]
    a.write_bytes(b"ONE\ntwo\nmore\n")  # replaced by a longer one
    got, at = drained(reader, at)
    assert got == [("a.txt", "ONE"), ("a.txt", "two"), ("a.txt", "more")]
    a.write_bytes(b"ONE\nTWO\nmore\nnew\n")  # the same first line, other bytes before the offset
    got, at = drained(reader, at)
    assert [x for _, x in got] == ["ONE", "TWO", "more", "new"]
    a.unlink()
    assert drained(reader, at)[0] == []


def test_tail_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(TailSource)
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "log.jsonl"
    for text in ("1\n2\n3", "1\n2\n34\n5\n", "1\n2\n34\n5\n6\n"):
        path.write_text(text)
        stream = spark.readStream.format("tail").option("path", str(tmp_path / "in")).option("split", 2).load()
        keyed.changes(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert [x.line for x in got] == ["1", "2", "34", "5", "6"] and [x.pos for x in got] == [0, 2, 4, 7, 9]


# keyed state


def batches(df, order, path, turned, parts=4):
    """Runs a stream over parts in order, each shuffled, started anew after every one."""
    spark, rows = df.sparkSession, df.collect()
    rows.sort(key=lambda r: tuple(r[c] for c in order))
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, df.schema).repartition(3).write.mode("append").parquet(f"{path}/in")
        keyed.changes(turned(spark.readStream.schema(df.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/checkpoint")
    return f"{path}/out"


def same(a, b):
    a, b = ([tuple(r[c] for c in sorted(x.columns)) for x in (d,) for r in x.collect()] for d in (a, b))
    assert sorted(a, key=str) == sorted(b, key=str) and a


def test_streamed_merging_equals_the_fold(spark, tmp_path):
    r = random.Random(2)
    hits = spark.createDataFrame([(w, t * 500, r.choice("ab")) for w in "xyz" for t in sorted(r.sample(range(900), 150))], "ws string, t_ms long, label string")
    out = batches(hits, ["t_ms", "label"], tmp_path, keyed.merged)
    same(keyed.current(spark, out, ["ws", "event"], "n"), signals.merged(hits))


def test_streamed_ledger_and_alignment_equal_the_folds(spark, tmp_path):
    r = random.Random(3)
    rows, line = [], {}
    for t in range(400):
        k = (r.randint(0, 1), f"i{r.randint(0, 25)}")
        line[k] = line.get(k, 0) + 1
        rows.append((*k, line[k], r.choice(["hypothesized"] * 3 + ["verified", "corrected"]), 10 * t, 10 * t + 5, r.choice([None, 0.1, 0.5, 0.9])))
    log = spark.createDataFrame(rows, "ws long, id string, line_no long, status string, start_us long, end_us long, confidence double")
    out = batches(log, ["start_us"], tmp_path / "latest", keyed.latest)
    same(keyed.current(spark, out, ["ws", "id"], "line_no"), ledger.latest(log, 1_000_000))
    accepted = ledger.guarded(log).where("accepted").drop("accepted")
    out = batches(accepted, ["start_us"], tmp_path / "aligned", keyed.aligned)
    same(keyed.current(spark, out, ["ws"], "rows").drop("rows"), folds.trigger_alignment(accepted))


# phrases


def test_terms_of_several_words_are_phrases(spark, tmp_path):
    texts = ["new york city", "york new city", "New-York Cities and new yorkers", "new, york; new york cit", "newyork city", "Ñew Yörk  cîty"]
    empty = spark.createDataFrame([], "ws long, start long, end long, text string")
    screen = spark.createDataFrame([(1, i, i + 1, t) for i, t in enumerate(texts)], "ws long, start long, end long, text string")
    docs = search.collected(empty, empty.withColumn("id", F.lit(1)), screen)
    search.sync(docs, f"{tmp_path}/index")
    index = search.Index(spark, f"{tmp_path}/index")
    found = lambda *terms: {x.start: x.f0 for x in index.by_words(list(terms), 10, True).collect()}
    assert found("new-york-cit") == {0: 1, 2: 1, 3: 1, 5: 1}
    assert found("new-york") == {0: 1, 2: 2, 3: 2, 5: 1}
    assert found("york") == {0: 1, 1: 1, 2: 2, 3: 2, 5: 1} and found("york-new-york") == {3: 1}
    assert found("new-york", "and") == {2: 2} and found("new-boston") == {}
