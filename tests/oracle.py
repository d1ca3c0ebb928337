"""Runs queries beside their SQL on DuckDB and says where they differ."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return f"rows {len(a)} / {len(b)}; first {bad[:1]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con, sql = connection(sf), entry.oracle_sql()
    for name, q in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] or len(sys.argv) == 2 and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            got = q(spark, sf).toPandas()
            took = time.time() - t
            d = differences(got, con.execute(sql[name]).df()) if name in sql else "no SQL"
            print(f"{name} {len(got)} rows {took:.1f}s {d or 'ok'}"[:700], flush=True)
        except Exception as e:
            print(f"{name} FAIL {str(e).split('JVM stacktrace')[0][:900]}", flush=True)
