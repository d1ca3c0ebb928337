"""Queries on keys, lines and corpora larger than the driver's tables have them."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import qualifiers, search
from tidemark.plans import registry


def test_sizes_of_keys_whose_product_exceeds_a_long(spark, tmp_path):
    keys = [(3, 7), (149_999, 14_999), (9_000_000, 900_000), (8_999_999, 899_999), (2**62 + 1, 2**62 + 3), (0, 5), (None, 1), (1, None)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {x.o_orderkey: x.size for x in entry.queries()["human_sizes"](spark, str(tmp_path)).collect()}
    n = {k: k * k * c % 5_000_000_000_000 if k is not None and c is not None else None for k, c in keys}
    duckdb.sql("CREATE OR REPLACE TEMP TABLE b AS SELECT unnest($1) AS o_orderkey, unnest($2) AS n", params=[list(n), list(n.values())])
    sql = registry.SQL["human_sizes"].split(" SELECT o_orderkey, CASE", 1)[1]
    assert got == dict(duckdb.sql(f"SELECT o_orderkey, CASE{sql}").fetchall())


def test_words_of_a_long_line_do_not_carry_it(spark):
    ledger = [("w", "alpha tion. beta"), ("w", "alphabet tion"), ("v", "추진 후보tion")]
    told = [("w", " ".join(f"alphabet{i} alp" for i in range(2000))), ("w", "beta\n**alphabets** tion, (alphas)"), ("w", "beta\n**alphabets** tion, (alphas)"), ("v", "추진은 alpha")]
    s = lambda rows: spark.createDataFrame(rows, "ws string, text string")
    df = qualifiers.dropped_qualifiers(s(ledger), s(told), ("tion",))
    got = sorted(tuple(x) for x in df.collect())
    head = told[0][1][:120]
    assert got == sorted([("w", 1, "alpha", head), ("w", 1, "alphabet", head), ("w", 2, "alpha", "**alphabets** tion, (alphas)"), ("v", 1, "추진", "추진은 alpha")])
    exchanged = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression [ws" in x and "key" in x]
    met = df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1]
    assert exchanged and "line#" not in met.splitlines()[2]  # what is dealt by words has no line


def test_postings_are_a_row_a_block_and_count_as_texts_do(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abÄé가z😀") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 60))) for _ in range(400)] + ["ab", "aaaa aaa", "a"]
    empty = spark.createDataFrame([], "ws long, start long, end long, text string")
    screen = spark.createDataFrame([(i % 7, i, i + 1, t) for i, t in enumerate(texts)], "ws long, start long, end long, text string")
    search.sync(search.collected(empty, empty.withColumn("id", F.lit(1)), screen), f"{tmp_path}/index")
    index = search.Index(spark, f"{tmp_path}/index")
    for term in ("aba", "Äéa", "zaba", "aaa", "😀가z", "b a"):
        want = {i: n for i, t in enumerate(texts) if (n := sum(t.lower().startswith(term.lower(), j) for j in range(len(t))))}
        assert {x.start: x.f0 for x in index.by_grams([term], len(texts), True).collect()} == want
    for term in ("ab", "가", "zé"):
        want = {i: n for i, t in enumerate(texts) if (n := sum(w.startswith(search.fold(term)) for w in search.words_of(t)))}
        assert {x.start: x.f0 for x in index.by_words([term], len(texts), True).collect()} == want
    blocks = spark.read.parquet(f"{tmp_path}/index/{index.gens[0]}/grams")
    assert blocks.groupBy("block", "key").count().where("count > 1").count() == 0  # before, a row for each document and trigram
    monkeypatch.setattr(search, "BLOCK", 50)
    rows = pa.RecordBatch.from_pylist([dict(doc=i, ws=0, source="s", family="f", start=i, end=i, is_window=False, text=t) for i, t in enumerate(texts)])
    monkeypatch.setattr(search.TaskContext, "get", classmethod(lambda _: type("T", (), {"partitionId": lambda self: 3})()))
    got = [x for b in search._posted("grams")(iter([rows])) for x in b.to_pylist()]
    assert sum(len(x["places"]) for x in got if not x["key"]) == len(texts) and len({x["block"] for x in got}) > 50
    assert sum(len(search.unpacked(x["data"])) for x in got if x["key"]) == sum(max(len(t) - 2, 0) for t in texts)


@pytest.mark.parametrize("places", [[0], [127, 128, 129, 16384, 2**21, 2**35], list(range(0, 10**6, 997))])
def test_places_are_packed_and_come_back(places):
    at = np.array(places * 2, np.uint64)
    data, begin = search.packed(np.array([0, len(places)]), at)
    assert [search.unpacked(data[begin[i] : begin[i + 1]].tobytes()).tolist() for i in (0, 1)] == [places, places]
