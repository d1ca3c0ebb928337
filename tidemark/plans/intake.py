"""Registered queries of validation and of names and labels made from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import transcript, validation
from ..sources import fixtures as fx
from .registry import TURNS, WORD_SQL, query

SPEECH = f"""{TURNS}{WORD_SQL}, sp AS (SELECT ws, id, CASE WHEN speaker <> 'system' THEN start_ms / 1000 END AS a, end_ms / 1000 AS b, trim(text, ' ') AS text, len(text) / 100 AS compression, -len(text) / 200 AS logprob FROM seg WHERE trim(text, ' ') <> ''),
tk AS (SELECT ws, id, w, count(*) AS c FROM (SELECT ws, id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM sp) x WHERE w <> '' GROUP BY ALL), rt AS (SELECT ws, id, CASE WHEN sum(c) >= 12 THEN round(max(c) / sum(c), 6) ELSE 0 END AS ratio FROM tk GROUP BY ALL),
wd AS (SELECT ws, id, arg_max((start_ms + 10 * len(word)) / 1000, pos) AS last, sum(CAST(round(CASE WHEN len(word) > 1 THEN 1 / len(word) END * 1000000) AS BIGINT)) / 1000000.0 / count(CASE WHEN len(word) > 1 THEN 1 END) AS mean FROM word GROUP BY ALL),
ck AS (SELECT sp.ws, sp.id, round(a, 3) AS start, round(coalesce(last, b), 3) AS "end", text, round(mean, 3) AS conf, CASE WHEN compression > 2.4 OR coalesce(ratio, 0) >= 0.6 THEN 'repeated' WHEN a IS NULL THEN 'unplaced' WHEN logprob < -1 THEN 'logprob' WHEN mean < 0.1 THEN 'words' END AS code
  FROM sp LEFT JOIN rt ON rt.ws = sp.ws AND rt.id = sp.id LEFT JOIN wd ON wd.ws = sp.ws AND wd.id = sp.id)"""


def checked(spark, d):
    t = fx.turns(spark, d)
    n = F.length("text")
    seg = t.select("ws", "id", F.when(F.col("speaker") != "system", F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", (n / 100).alias("compression"), (-n / 200).alias("logprob"))
    size = F.length("word")
    w = transcript.words(t).select("ws", "id", F.col("pos").alias("n"), (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + 10 * size) / 1000).alias("end"), F.when(size > 1, 1 / size).alias("p"))
    return validation.recognised(seg, w)


@query("recognised_speech", f"WITH {SPEECH} SELECT * FROM ck")
def recognised_speech(spark, d):
    """Turns as recognised segments, their quality by their length."""
    return checked(spark, d)


@query("recognised_results", f"WITH {SPEECH} SELECT ws, arg_min(code, id) FILTER (code <> 'unplaced') AS code, min(id) FILTER (code <> 'unplaced') AS id FROM ck GROUP BY ws")
def recognised_results(spark, d):
    """Which conversations stand."""
    return validation.results(checked(spark, d))


@query("presence_codes", """WITH o AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'place' ELSE 'person_presence' END AS kind, CASE WHEN value < 400 THEN event_type ELSE ' ' END AS subject,
  CASE event_type WHEN 'view' THEN 'present' WHEN 'click' THEN 'absent' WHEN 'purchase' THEN 'uncertain' ELSE 'gone' END AS state, value AS t, user_id * 2.0 AS a, user_id * 6.0 AS b FROM events)
SELECT event_id, CASE WHEN kind <> 'person_presence' THEN 'kind' WHEN trim(subject) = '' THEN 'subject' WHEN state = 'gone' THEN 'state' WHEN NOT (a <= t AND t < b) THEN 'outside' END AS code FROM o""")
def presence_codes(spark, d):
    """Events as observations, in a span by their user."""
    e = fx.table(spark, d, "events")
    kind = F.col("event_type")
    state = F.when(kind == "view", "present").when(kind == "click", "absent").when(kind == "purchase", "uncertain").otherwise("gone")
    o = e.select("event_id", F.when(kind == "error", "place").otherwise("person_presence").alias("kind"), F.when(F.col("value") < 400, kind).otherwise(" ").alias("subject"), state.alias("state"), "value", (F.col("user_id") * 2.0).alias("a"), (F.col("user_id") * 6.0).alias("b"))
    return o.select("event_id", validation.presence_code("kind", "subject", "state", "value", "a", "b").alias("code"))


@query("bound_records", """WITH r AS (SELECT l_suppkey AS ws, l_returnflag AS flag, CASE WHEN l_discount > 0.01 THEN l_linestatus END AS status FROM lineitem), m AS (SELECT s_suppkey AS ws, CASE WHEN s_acctbal > 0 THEN 'N' END AS flag, 'O' AS status FROM supplier WHERE s_nationkey < 20)
SELECT r.ws, CASE WHEN m.flag IS NULL THEN NULL WHEN r.flag IS NULL OR r.status IS NULL THEN 'missing' WHEN r.flag <> m.flag OR r.status <> m.status THEN 'mismatch' END AS code, count(*) AS n FROM r LEFT JOIN m USING (ws) GROUP BY 1, 2""")
def bound_records(spark, d):
    """Items as records of their supplier's workspace."""
    r = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ws"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_discount") > 0.01, F.col("l_linestatus")).alias("status"))
    m = fx.table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("ws"), F.when(F.col("s_acctbal") > 0, "N").alias("flag"), F.lit("O").alias("status"))
    return validation.bound_records(r, m, ["flag", "status"]).groupBy("ws", "code").agg(F.count("*").alias("n"))


@query("backfilled_spans", """WITH s AS (SELECT event_id, value AS a, value + user_id / 10 AS b, 300.0 AS dur FROM events), r AS (SELECT *, CASE WHEN b - dur > 0 AND b - dur > greatest(5, dur * 0.01) THEN 'beyond' WHEN b - dur > 0 AND a >= dur THEN 'start' END AS refused FROM s)
SELECT event_id, a AS start, CASE WHEN b > dur AND refused IS NULL THEN dur ELSE b END AS "end", refused, b > dur AND refused IS NULL AS clamped FROM r""")
def backfilled_spans(spark, d):
    """Spans of events beside a medium of 300 s."""
    e = fx.table(spark, d, "events").select("event_id", F.col("value").alias("start"), (F.col("value") + F.col("user_id") / 10).alias("end"), F.lit(300.0).alias("duration"))
    return validation.backfilled(e).drop("duration")


@query("text_names", r"""WITH x AS (SELECT page_id, html AS t FROM pages WHERE html IS NOT NULL), u AS (SELECT *, trim(regexp_replace(regexp_replace(t, '[/\\:*?"<>|\[\]#^\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g'), ' .') AS s FROM x),
c AS (SELECT *, s[:80] AS c8, t[:40] AS c4 FROM u), p AS (SELECT *, CASE WHEN contains(c8, ' ') THEN len(c8) - strpos(reverse(c8), ' ') ELSE -1 END AS h8, CASE WHEN contains(c4, ' ') THEN len(c4) - strpos(reverse(c4), ' ') ELSE -1 END AS h4 FROM c)
SELECT page_id, CASE WHEN len(s) <= 80 AND strlen(s) <= 245 THEN s WHEN strlen(c8) > 245 THEN NULL ELSE trim(CASE WHEN h8 >= 0 AND h8 >= len(c8) // 2 THEN c8[:h8] ELSE c8 END, ' ') END AS stem,
  CASE WHEN len(t) <= 40 THEN t ELSE rtrim(CASE WHEN h4 > 20 THEN c4[:h4] ELSE c4 END, ' ,·—-(') || '…' END AS short, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\', '&#92;'), '[', '&#91;'), ']', '&#93;'), '|', '&#124;'), '`', '&#96;'), chr(10), '&#10;') AS label FROM p""")
def text_names(spark, d):
    """Pages as titles and labels."""
    t = F.col("html")
    return fx.table(spark, d, "pages").where("html is not null").select("page_id", fn.doc_stem(t).alias("stem"), fn.ellipsized(t).alias("short"), fn.diagram_label(t).alias("label"))


@query("url_folders", "SELECT page_id, 'url-' || md5(url)[:8] AS folder, repeat('`', 1 + coalesce(list_max(list_transform(regexp_extract_all(html, '`+'), lambda r: len(r))), 0)::INTEGER) || CASE WHEN starts_with(html, '`') OR ends_with(html, '`') THEN ' ' ELSE '' END AS opening FROM pages WHERE html IS NOT NULL")
def url_folders(spark, d):
    """Addresses as folders, and how a page opens as a code span."""
    p = fx.table(spark, d, "pages").where("html is not null")
    span = fn.code_span(F.col("html"))
    return p.select("page_id", fn.url_folder(F.col("url")).alias("folder"), F.regexp_extract(span, "^(`+ ?)", 1).alias("opening"))
