"""Registered queries of file sources and streams, over files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ledger
from ..shared import folder
from ..sources import fixtures as fx
from ..sources import ledger_files, line_source
from ..streaming import keyed
from ..streaming.tail_source import TailSource
from .registry import DURATION, LOG, SERIES, SQL, TURNS, hits, query

ROW = T.StructType([T.StructField("event", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


def place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_lines(spark, d) -> DataFrame:
    """(ws, ts, event_id, line): JSON lines of events; errors are cut off in the middle, the value of a purchase is a
    truth value, and signups over 400 are blank lines."""
    e = fx.table(spark, d, "events").select((F.col("user_id") % 20).alias("ws"), "ts", "event_id", "event_type", "value")
    plain = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), "value"))
    wrong = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.lit(True).alias("value")))
    line = F.when(F.col("event_type") == "error", F.left(plain, F.length(plain) - 3)).when(F.col("event_type") == "purchase", wrong)
    line = line.when((F.col("event_type") == "signup") & (F.col("value") > 400), F.lit("")).otherwise(plain)
    return e.select("ws", "ts", "event_id", line.alias("value"))


@query("ledger_lines", """WITH n AS (SELECT user_id % 20 AS ws, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS line_no, event_id, event_type, value FROM events)
SELECT ws, line_no, event_type NOT IN ('error', 'purchase') AS valid, CASE WHEN event_type NOT IN ('error', 'purchase') THEN event_id END AS event, CASE WHEN event_type NOT IN ('error', 'purchase') THEN value END AS value
FROM n WHERE NOT (event_type = 'signup' AND value > 400)""")
def ledger_lines(spark, d):
    """One file a workspace, read in byte ranges; rows and rejects with the numbers of their lines."""
    at = place(spark, "lines")
    event_lines(spark, d).repartition("ws").sortWithinPartitions("ws", "ts", "event_id").select("ws", "value").write.partitionBy("ws").text(at)
    rows, rejects = ledger_files.jsonl(spark, at, ROW)
    ws = F.regexp_extract("file", "ws=([0-9]+)", 1).cast("long").alias("ws")
    none = lambda t: F.lit(None).cast(t)
    good = rows.select(ws, "line_no", F.lit(True).alias("valid"), "event", "value")
    return good.unionByName(rejects.select(ws, "line_no", F.lit(False).alias("valid"), none("long").alias("event"), none("double").alias("value")))


@query("transcript_files", f"""WITH {TURNS}, n AS (SELECT ws, count(*) AS n FROM seg GROUP BY ws), r AS (SELECT seg.*, row_number() OVER (PARTITION BY ws ORDER BY id) - 1 AS "at" FROM seg)
SELECT r.ws, r."at", start_ms / 1000.0 AS "start", end_ms / 1000.0 AS "end", text, speaker FROM r JOIN n USING (ws) WHERE n > 1 AND speaker <> 'system' AND start_ms < end_ms""")
def transcript_files(spark, d):
    """A JSON array for each conversation; system turns tell their time as text, and a single turn is no array."""
    at = place(spark, "transcripts")
    t = fx.turns(spark, d).select("ws", "id", "speaker", "text", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))
    item = F.struct("speaker", "text", "start", "end")
    told = F.when(F.col("speaker") == "system", F.to_json(F.struct("speaker", "text", F.col("start").cast("string").alias("start"), "end"))).otherwise(F.to_json(item))
    one = t.groupBy("ws").agg(F.array_sort(F.collect_list(F.struct("id", told.alias("j")))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: x["j"]), ",")
    one = one.select("ws", F.when(F.size("a") > 1, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text).alias("value"))
    one.write.option("maxRecordsPerFile", 1).partitionBy("ws").text(at)
    got = line_source.transcripts(spark, at)
    return got.select(F.regexp_extract("file", "ws=([0-9]+)", 1).cast("long").alias("ws"), "at", "start", "end", "text", F.get_json_object("item", "$.speaker").alias("speaker"))


def arriving(rows: DataFrame, by: str, times: int = 3):
    """The rows in so many parts, those with the least `by` first."""
    cuts = rows.approxQuantile(by, [k / times for k in range(1, times)], 0.01) if not rows.isEmpty() else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col(by) > low)
        yield part if high is None else part.where(F.col(by) <= high)


def fed(rows: DataFrame, by: str, turned) -> str:
    """Rows arrive in parts, and after each the stream is started again from its checkpoint; the folder of its changes."""
    spark = rows.sparkSession
    at = place(spark, "arriving")
    for part in arriving(rows, by):
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        keyed.changes(turned(stream), f"{at}/out", f"{at}/checkpoint")
    return f"{at}/out"


@query("hits_stream", SQL["hit_merge"])
def hits_stream(spark, d):
    """The last event of each workspace is the state."""
    at = fed(hits(spark, d).drop("value"), "t_ms", keyed.merged)
    return keyed.current(spark, at, ["ws", "event"], "n")


def valid(spark, d) -> DataFrame:
    return ledger.validated(fx.ledger(spark, d), DURATION).where("code is null").drop("code")


@query("ledger_stream", SQL["ledger_latest"])
def ledger_stream(spark, d):
    """The order of lines counts; what came to its end takes no hypothesis any more."""
    at = fed(valid(spark, d), "start_us", keyed.latest)
    return keyed.current(spark, at, ["ws", "id"], "line_no")


ALIGNED = f"""WITH {LOG}, r AS (SELECT ws, id, status, coalesce(confidence, 0) AS doubt, start_us, row_number() OVER (PARTITION BY ws ORDER BY start_us, id, line_no) AS n FROM acc),
v AS (SELECT *, lead(n) OVER w AS until, lead(status) OVER w AS next FROM r WINDOW w AS (PARTITION BY ws, id ORDER BY n)),
h AS (SELECT * FROM v WHERE status = 'hypothesized'), t AS (SELECT ws, id, doubt, start_us, until AS n FROM h WHERE next <> 'hypothesized'),
q AS (SELECT t.ws, t.n, count(*) FILTER ((h.doubt, h.start_us, h.id) < (t.doubt, t.start_us, t.id)) AS before FROM t JOIN h ON h.ws = t.ws AND h.n < t.n AND (h.until IS NULL OR h.until >= t.n) GROUP BY t.ws, t.n)
SELECT r.ws, count(q.n) AS transitions, count(*) FILTER (q.before < 3) AS aligned FROM r LEFT JOIN q ON q.ws = r.ws AND q.n = r.n GROUP BY r.ws"""
SQL["trigger_alignment"] = ALIGNED


@query("alignment_stream", ALIGNED)
def alignment_stream(spark, d):
    """Open hypotheses are the state."""
    at = fed(ledger.guarded(valid(spark, d)).where("accepted").drop("accepted"), "start_us", keyed.aligned)
    return keyed.current(spark, at, ["ws"], "rows").drop("rows")


@query("tail_lines", """SELECT user_id % 20 AS ws, count(*) AS lines, CAST(sum(length(event_id::VARCHAR)) AS BIGINT) AS digits FROM events GROUP BY 1""")
def tail_lines(spark, d):
    """Files that arrive between two runs of a stream; each line once."""
    spark.dataSource.register(TailSource)
    at = place(spark, "tail")
    rows = fx.table(spark, d, "events").select((F.col("user_id") % 20).alias("ws"), fx.micros("ts", "1970-01-01").alias("t"), F.col("event_id").cast("string").alias("value"))
    for part in arriving(rows, "t"):
        part.select("ws", "value").write.mode("append").partitionBy("ws").text(f"{at}/in")
        stream = spark.readStream.format("tail").option("path", f"{at}/in").option("suffix", ".txt").load()
        keyed.changes(stream, f"{at}/out", f"{at}/checkpoint")
    got = spark.read.parquet(f"{at}/out")
    return got.groupBy(F.regexp_extract("file", "ws=([0-9]+)", 1).cast("long").alias("ws")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("digits"))
