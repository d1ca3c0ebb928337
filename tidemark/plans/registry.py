"""Registered queries: each applies operators to adapted driver tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, folds, intervals, ledger, retrieval, signals, transcript
from ..sources import fixtures as fx
from ..streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Fixed values of the queries.
DURATION = fx.DURATION_US
TERMS = ["the", "on"]
WORDS = ["tion", "ing"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


LOG = f"""
raw AS (SELECT user_id % 20 AS ws, regexp_extract(props, '"k": *([0-9]+)', 1) AS id, ts, event_id, value,
  CASE WHEN event_type IN ('view','click') THEN 'hypothesized' WHEN event_type = 'purchase' THEN 'verified' WHEN event_type = 'signup' THEN 'corrected' ELSE 'invalid' END AS status,
  epoch_us(ts) - 1704067200000000 AS start_us FROM events),
log AS (SELECT ws, id, CAST(row_number() OVER (PARTITION BY ws, id ORDER BY ts, event_id) AS BIGINT) AS line_no, status, start_us,
  least({DURATION}, start_us + CAST(floor(value * 36000000.0) AS BIGINT)) AS end_us, CASE WHEN value <= 100 THEN value / 100 END AS confidence FROM raw),
coded AS (SELECT *, CASE WHEN trim(coalesce(id, '')) = '' THEN 'id' WHEN status NOT IN ('hypothesized','verified','corrected') THEN 'status'
  WHEN start_us < 0 OR start_us >= end_us THEN 'span' WHEN end_us > {DURATION} THEN 'duration' WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END AS code FROM log),
ok AS (SELECT *, coalesce(sum(CASE WHEN status <> 'hypothesized' THEN 1 ELSE 0 END) OVER (PARTITION BY ws, id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM coded WHERE code IS NULL),
acc AS (SELECT * FROM ok WHERE NOT (status = 'hypothesized' AND before > 0)),
latest AS (SELECT ws, id, line_no, status, start_us, end_us, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ws, id ORDER BY line_no DESC) AS rn FROM acc) x WHERE rn = 1)"""


def islands_sql(name: str, source: str, by: str, s: str, e: str) -> str:
    return f"""{name}_o AS (SELECT {by}, {s}, {e}, CASE WHEN {s} > max({e}) OVER w THEN 1 WHEN max({e}) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_i AS (SELECT *, sum(o) OVER (PARTITION BY {by} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM {name}_o),
{name} AS (SELECT {by}, min({s}) AS {s}, max({e}) AS {e}, count(*) AS n FROM {name}_i GROUP BY {by}, i)"""


GAPS = f"""cur AS (SELECT ws, start_us, coalesce(max(end_us) OVER (PARTITION BY ws ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM latest),
holes AS (SELECT ws, c AS gap_start, start_us AS gap_end FROM cur WHERE start_us - c > 3000000
  UNION ALL SELECT ws, max(end_us), {DURATION} FROM latest GROUP BY ws HAVING {DURATION} - max(end_us) > 3000000)"""


def state(spark, d):
    return ledger.latest(fx.ledger(spark, d), DURATION)


@query("ledger_latest", f"WITH {LOG} SELECT * FROM latest")
def ledger_latest(spark, d):
    return state(spark, d)


@query("status_rejects", f"WITH {LOG} SELECT ws, coalesce(code, 'transition') AS code, count(*) AS n FROM (SELECT ws, code FROM coded WHERE code IS NOT NULL UNION ALL SELECT ws, NULL FROM ok WHERE status = 'hypothesized' AND before > 0) x GROUP BY ALL")
def status_rejects(spark, d):
    coded = ledger.validated(fx.ledger(spark, d), DURATION)
    bad = coded.where("code is not null").select("ws", "code")
    back = ledger.guarded(coded.where("code is null")).where("not accepted").select("ws", F.lit("transition").alias("code"))
    return bad.unionByName(back).groupBy("ws", "code").agg(F.count("*").alias("n"))


@query("coverage_union", f"WITH {LOG}, {islands_sql('u', 'latest', 'ws', 'start_us', 'end_us')} SELECT ws, start_us, end_us, n FROM u")
def coverage_union(spark, d):
    return ledger.coverage(state(spark, d))


@query("coverage_gaps", f"WITH {LOG}, {GAPS} SELECT * FROM holes")
def coverage_gaps(spark, d):
    return intervals.gaps(state(spark, d), ["ws"], "start_us", "end_us", F.lit(DURATION).cast("long"), F.lit(ledger.GAP_US))


@query("readiness", f"""WITH {LOG}, {GAPS}, {islands_sql('u', 'latest', 'ws', 'start_us', 'end_us')}, term AS (SELECT * FROM latest WHERE status <> 'hypothesized'), {islands_sql('t', 'term', 'ws', 'start_us', 'end_us')},
cnt AS (SELECT ws, count(*) FILTER (status = 'hypothesized') AS n_hypothesized, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'corrected') AS n_corrected,
  sum(CAST(round(confidence * 1000000) AS BIGINT)) / 1000000.0 / count(confidence) AS mc FROM latest GROUP BY ws),
cov AS (SELECT ws, CAST(sum(end_us - start_us) AS BIGINT) / {float(DURATION)} AS c FROM u GROUP BY ws), ver AS (SELECT ws, CAST(sum(end_us - start_us) AS BIGINT) / {float(DURATION)} AS v FROM t GROUP BY ws),
g AS (SELECT ws, count(*) AS n FROM holes GROUP BY ws)
SELECT cnt.ws, n_hypothesized, n_verified, n_corrected, round(c, 4) AS covered_ratio, round(coalesce(v, 0), 4) AS verified_ratio, coalesce(g.n, 0) AS n_gaps, round(coalesce(mc, 0), 3) AS mean_confidence,
  round(0.4::DOUBLE * c + 0.4::DOUBLE * coalesce(v, 0) + 0.2::DOUBLE * least(coalesce(mc, 0), 1.0), 3) AS score,
  CASE WHEN coalesce(g.n, 0) > 0 OR c < 0.999 THEN 'cover_gaps' WHEN coalesce(v, 0) < 0.6 THEN 'verify_more' ELSE 'converged' END AS readiness
FROM cnt JOIN cov ON cnt.ws = cov.ws LEFT JOIN ver ON cnt.ws = ver.ws LEFT JOIN g ON cnt.ws = g.ws""")
def readiness(spark, d):
    return ledger.readiness(state(spark, d), DURATION)


@query("interval_difference", f"""WITH {LOG}, lh AS (SELECT * FROM latest WHERE status = 'hypothesized'), rh AS (SELECT * FROM latest WHERE status <> 'hypothesized'),
{islands_sql('a', 'lh', 'ws', 'start_us', 'end_us')}, {islands_sql('b', 'rh', 'ws', 'start_us', 'end_us')},
cutp AS (SELECT a.ws, a.start_us AS a0, a.end_us AS a1, greatest(a.start_us, b.start_us) AS s, least(a.end_us, b.end_us) AS e FROM a JOIN b ON a.ws = b.ws AND b.start_us < a.end_us AND a.start_us < b.end_us),
lead_ AS (SELECT ws, a0, a1, s, e, coalesce(lag(e) OVER (PARTITION BY ws, a0 ORDER BY s), a0) AS p FROM cutp),
outp AS (SELECT ws, p AS start_us, s AS end_us FROM lead_ WHERE p < s UNION ALL SELECT ws, max(e), a1 FROM cutp GROUP BY ws, a0, a1 HAVING max(e) < a1
  UNION ALL SELECT ws, start_us, end_us FROM a WHERE NOT EXISTS (SELECT 1 FROM cutp c WHERE c.ws = a.ws AND c.a0 = a.start_us))
SELECT * FROM outp""")
def interval_difference(spark, d):
    s = state(spark, d)
    return intervals.difference(s.where("status = 'hypothesized'"), s.where("status <> 'hypothesized'"), ["ws"], "start_us", "end_us")


TURNS = """
c AS (SELECT conv_id AS ws, turn AS id, role AS speaker, text, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS BIGINT) AS n_words FROM conversations WHERE text IS NOT NULL),
seg AS (SELECT *, b AS start_ms, b + n_words * 400 AS end_ms FROM (SELECT *, CAST(coalesce(sum(n_words * 400 + (id % 3) * 3000) OVER (PARTITION BY ws ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM c) x)"""
WORD_SQL = """, word AS (SELECT ws, id, CAST(p AS BIGINT) AS pos, w AS word, start_ms + p * 400 AS start_ms, start_ms + p * 400 + 400 AS end_ms FROM
(SELECT ws, id, start_ms, unnest(regexp_split_to_array(trim(text), '\\s+')) AS w, unnest(range(n_words)) AS p FROM seg) x)"""


@query("transcript_windows", f"""WITH {TURNS}, l AS (SELECT ws, id, start_ms, end_ms, text, lead(start_ms) OVER w AS s1, lead(end_ms) OVER w AS e1, lead(text) OVER w AS t1, lead(start_ms, 2) OVER w AS s2, lead(end_ms, 2) OVER w AS e2, lead(text, 2) OVER w AS t2 FROM seg WINDOW w AS (PARTITION BY ws ORDER BY start_ms, id))
SELECT ws, id AS first_id, CASE WHEN s2 - e1 <= 5000 THEN 3 ELSE 2 END AS members, start_ms, CASE WHEN s2 - e1 <= 5000 THEN e2 ELSE e1 END AS end_ms, CASE WHEN s2 - e1 <= 5000 THEN concat_ws(' ', text, t1, t2) ELSE concat_ws(' ', text, t1) END AS text FROM l WHERE s1 - end_ms <= 5000""")
def transcript_windows(spark, d):
    return transcript.windows(fx.turns(spark, d))


@query("resegment", f"""WITH {TURNS}{WORD_SQL}, o AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY ws ORDER BY start_ms, id, pos) > 1500 THEN 1 ELSE 0 END AS o FROM word),
s AS (SELECT *, CAST(sum(o) OVER (PARTITION BY ws ORDER BY start_ms, id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg FROM o) SELECT ws, seg, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM s GROUP BY ws, seg""")
def resegment(spark, d):
    return transcript.resegmented(transcript.words(fx.turns(spark, d)))


def shifted(spark, d):
    return fx.turns(spark, d).withColumns({"start_ms": F.col("start_ms") + 700, "end_ms": F.col("end_ms") + 700})


@query("speaker_overlap", f"""WITH {TURNS}, t AS (SELECT ws, speaker, start_ms + 700 AS r0, end_ms + 700 AS r1 FROM seg), j AS (SELECT seg.ws, seg.id, t.speaker, least(end_ms, r1) - greatest(start_ms, r0) AS o, r0 FROM seg JOIN t ON seg.ws = t.ws AND start_ms < r1 AND r0 < end_ms AND start_ms < end_ms),
k AS (SELECT *, row_number() OVER (PARTITION BY ws, id ORDER BY o DESC, r0, speaker DESC) AS rn FROM j) SELECT seg.ws, seg.id, k.speaker, k.o AS overlap_ms FROM seg LEFT JOIN k ON seg.ws = k.ws AND seg.id = k.id AND rn = 1""")
def speaker_overlap(spark, d):
    return transcript.speakers(fx.turns(spark, d), shifted(spark, d))


@query("word_alignment_asof", f"""WITH {TURNS}{WORD_SQL}, p AS (SELECT ws, id, end_ms + 100 AS t_ms FROM seg), e AS (SELECT ws, end_ms, max(id * 100000 + pos) AS v FROM word GROUP BY ws, end_ms)
SELECT ws, id, t_ms, v AS last_word FROM (SELECT p.ws, p.id, p.t_ms, e.v, row_number() OVER (PARTITION BY p.ws, p.id ORDER BY e.end_ms DESC) AS rn FROM p LEFT JOIN e ON p.ws = e.ws AND e.end_ms <= p.t_ms AND e.end_ms > p.t_ms - 1000000) x WHERE rn = 1""")
def word_alignment_asof(spark, d):
    """The last word that ends at or before each cut instant."""
    t = fx.turns(spark, d)
    points = t.select("ws", "id", (F.col("end_ms") + 100).alias("t_ms"))
    ends = transcript.words(t).groupBy("ws", "end_ms").agg(F.max(F.col("id") * 100_000 + F.col("pos")).alias("last_word"))
    return intervals.asof(points, ends, ["ws"], "t_ms", "end_ms", "last_word")


@query("contamination", f"""WITH {TURNS}, a AS (SELECT ws, count(*) AS n, count(*) FILTER (contains(text, 'Th') OR contains(text, 'ation') OR contains(text, 'que')) AS hits, count(DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS texts, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms FROM seg GROUP BY ws)
SELECT *, n >= 5 AND hits / n >= 0.5 AND texts / n <= 0.3 AS contaminated FROM a""")
def contamination(spark, d):
    return transcript.contamination(fx.turns(spark, d), "Th ation que")


@query("longest_silence", f"""WITH {TURNS}, g AS (SELECT ws, start_ms - coalesce(max(end_ms) OVER (PARTITION BY ws ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM seg) SELECT ws, greatest(max(gap), 0) AS longest_ms FROM g GROUP BY ws""")
def longest_silence(spark, d):
    return transcript.silence(fx.turns(spark, d))


SERIES = """sig AS (SELECT event_type AS ws, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS i, value FROM events), ser AS (SELECT ws, i, i * 40 AS t_ms, value FROM sig)"""


@query("scene_adaptive", f"""WITH {SERIES}, s AS (SELECT ws, i, t_ms, round(value / 4900.2, 6) AS score FROM ser), m AS (SELECT *, avg(CAST(trunc(score * 1000000) AS BIGINT)) OVER (PARTITION BY ws ORDER BY i ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) / 1000000.0 AS mean FROM s)
SELECT ws, i, t_ms, score FROM m WHERE score >= 0.3 OR (score >= 0.04 AND score >= 3.0 * mean)""")
def scene_adaptive(spark, d):
    return signals.scenes(fx.signals(spark, d), 50, 4900.2)


@query("highlight_islands", f"""WITH {SERIES}, l0 AS (SELECT ws, quantile_cont(value, 0.5) AS median, count(*) AS n, min(t_ms) AS lo, max(t_ms) AS hi FROM ser GROUP BY ws HAVING count(*) >= 4), rk AS (SELECT ws, value AS p75, row_number() OVER (PARTITION BY ws ORDER BY value) AS r FROM ser), lv AS (SELECT l0.*, p75 FROM l0 JOIN rk ON rk.ws = l0.ws AND r = CAST(floor(0.75 * (n - 1)) AS BIGINT) + 1), ov AS (SELECT ser.*, median, lo, hi FROM ser JOIN lv ON ser.ws = lv.ws WHERE value >= greatest(p75, median + 3)),
o AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY ws ORDER BY i) <= 2 THEN 0 ELSE 1 END AS o FROM ov), k AS (SELECT *, sum(o) OVER (PARTITION BY ws ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o),
g AS (SELECT ws, k, min(greatest(t_ms - 40, lo)) AS start_ms, max(least(t_ms + 40, hi)) + 40 AS end_ms, CAST(sum(CAST(round((value - median) * 100) AS BIGINT)) AS BIGINT) AS excess FROM k GROUP BY ws, k)
SELECT ws, start_ms, end_ms, excess, rank FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY excess DESC, start_ms) AS rank FROM g) x WHERE rank <= 5""")
def highlight_islands(spark, d):
    return signals.bursts(fx.signals(spark, d))


def hits(spark, d):
    s = fx.signals(spark, d)
    return s.select("ws", (F.col("t_ms") * 10).alias("t_ms"), F.when(F.col("value") > 60, "loud").otherwise("soft").alias("label"), "value").where("value > 20")


@query("hit_merge", f"""WITH {SERIES}, h AS (SELECT ws, t_ms * 10 AS t_ms, CASE WHEN value > 60 THEN 'loud' ELSE 'soft' END AS label FROM ser WHERE value > 20),
o AS (SELECT *, CASE WHEN lag(label) OVER w = label AND t_ms - (lag(t_ms) OVER w + 1500) <= 2000 THEN 0 ELSE 1 END AS o FROM h WINDOW w AS (PARTITION BY ws ORDER BY t_ms, label)),
k AS (SELECT *, CAST(sum(o) OVER (PARTITION BY ws ORDER BY t_ms, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event FROM o) SELECT ws, event, min(label) AS label, min(t_ms) AS start_ms, max(t_ms) + 1500 AS end_ms, count(*) AS n FROM k GROUP BY ws, event""")
def hit_merge(spark, d):
    return signals.merged(hits(spark, d).drop("value"))


CUTS = """cut AS (SELECT l_orderkey AS seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS ord, l_partkey % 1000 AS start_s, CAST(l_quantity AS BIGINT) AS length_s FROM lineitem),
off AS (SELECT seq, ord, start_s, length_s, CAST(sum(length_s) OVER w - length_s AS BIGINT) AS record_in, CAST(sum(length_s) OVER w AS BIGINT) AS record_out, lead(ord) OVER (PARTITION BY seq ORDER BY ord) IS NOT NULL AS joins FROM cut WINDOW w AS (PARTITION BY seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("edl_running_offsets", f"WITH {CUTS} SELECT * FROM off")
def edl_running_offsets(spark, d):
    return signals.cut_offsets(fx.cuts(spark, d))


@query("beat_p90", f"""WITH {CUTS}, b AS (SELECT seq, least((record_out * 1000) % 700, 700 - (record_out * 1000) % 700) AS dist FROM off WHERE joins) SELECT seq, max(dist) AS max_ms, quantile_disc(dist, 0.9) AS p90_ms, count(*) AS n FROM b GROUP BY seq""")
def beat_p90(spark, d):
    return signals.beat_offsets(signals.cut_offsets(fx.cuts(spark, d)), 700)


@query("cfr_lattice", f"""WITH {SERIES}, f AS (SELECT ws, i - 1 AS idx, CASE WHEN ws < 'm' THEN (i - 1) * 40 ELSE (i - 1) * 40 + CASE WHEN i % 97 = 0 THEN 1 ELSE 0 END END AS pts FROM ser), g AS (SELECT *, idx - lag(idx) OVER (PARTITION BY ws ORDER BY idx) AS st FROM f),
a AS (SELECT ws, count(*) AS n, min(pts - idx * 40) AS low, max(pts - idx * 40) AS high, max(coalesce(st, 1)) AS step FROM g GROUP BY ws) SELECT *, high - low < 1 AND step = 1 AS constant FROM a""")
def cfr_lattice(spark, d):
    s = fx.signals(spark, d)
    idx = F.col("i") - 1
    frames = s.select("ws", idx.alias("idx"), (idx * 40 + F.when((F.col("ws") >= "m") & (F.col("i") % 97 == 0), 1).otherwise(0)).alias("pts"))
    return signals.lattice(frames, 40, 1)


DOCS = """doc AS (SELECT item_id AS doc, item_id % 50 AS ws, 'understanding' AS family, text FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT doc_id, doc_id % 50, 'screen', text FROM documents WHERE text IS NOT NULL UNION ALL SELECT conv_id * 1000 + turn, (conv_id * 1000 + turn) % 50, 'transcript', text FROM conversations WHERE text IS NOT NULL)"""


def _occ(t: str, c: str = "text") -> str:
    return f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS BIGINT)"


@query("search_substring", f"""WITH {DOCS}, h AS (SELECT family, ws, doc, {' + '.join(_occ(t) for t in TERMS)} AS score FROM doc WHERE {' AND '.join(f"contains(text, '{t}')" for t in TERMS)})
SELECT family, ws, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, ws, doc) AS rank FROM h) x WHERE rank <= 20""")
def search_substring(spark, d):
    return retrieval.substring(fx.docs(spark, d), TERMS, 20)


COV = ["enti", "athawh", "thhe", "zzz"]


@query("search_coverage", f"""WITH {DOCS}, l AS (SELECT family, ws, doc, lower(text) AS t FROM doc), h AS (SELECT family, ws, doc, {' + '.join(f"CAST(contains(t, '{t}') AS BIGINT)" for t in COV)} AS matched, {' + '.join(_occ(t, 't') for t in COV)} AS occurrences FROM l)
SELECT * FROM h WHERE matched >= 3 ORDER BY matched DESC, occurrences DESC, family, ws, doc LIMIT 20""")
def search_coverage(spark, d):
    return retrieval.coverage(fx.docs(spark, d), COV, 20)


BM = f"""{DOCS}, tk AS (SELECT family, ws, doc, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM doc),
fr AS (SELECT family, ws, doc, len(t) AS size, len(list_filter(t, lambda x: starts_with(x, '{WORDS[0]}'))) AS f0, len(list_filter(t, lambda x: starts_with(x, '{WORDS[1]}'))) AS f1 FROM tk),
st AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM fr),
bm AS (SELECT family, ws, doc, round(greatest(1e-6, ln((n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE))) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) + greatest(1e-6, ln((n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE))) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)), 6) AS score FROM fr, st WHERE f0 > 0 AND f1 > 0)"""


@query("search_word_bm25", f"WITH {BM} SELECT family, ws, doc, round(score, 4) AS score FROM bm")
def search_word_bm25(spark, d):
    return retrieval.bm25(fx.docs(spark, d), WORDS).withColumn("score", F.round("score", 4))


@query("search_rrf", f"""WITH {BM}, sb AS (SELECT family, ws, doc, {_occ('tion')} + {_occ('ing')} AS score FROM doc WHERE contains(text, 'tion') AND contains(text, 'ing')),
r AS (SELECT family, ws, doc, row_number() OVER (PARTITION BY family ORDER BY score DESC, ws, doc) AS rank FROM bm UNION ALL SELECT family, ws, doc, row_number() OVER (PARTITION BY family ORDER BY score DESC, ws, doc) FROM sb),
f AS (SELECT family, ws, doc, round(sum(CAST(round(1e12 / (60 + rank)) AS BIGINT)) / 1e12, 4) AS score FROM r WHERE rank <= 80 GROUP BY family, ws, doc)
SELECT * FROM f ORDER BY score DESC, CASE family WHEN 'understanding' THEN 0 WHEN 'screen' THEN 1 ELSE 2 END, ws, doc LIMIT 20""")
def search_rrf(spark, d):
    docs = fx.docs(spark, d)
    return retrieval.fused([retrieval.ranked(retrieval.bm25(docs, WORDS), 80), retrieval.substring(docs, WORDS, 80)], 20)


@query("hellinger_lag", """WITH a AS (SELECT label AS "by", vec_id AS k, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), p AS (SELECT "by", k, list_transform(v, lambda x: x / list_sum(v)) AS p FROM a),
h AS (SELECT "by", k, p, lag(p) OVER (PARTITION BY "by" ORDER BY k) AS q FROM p) SELECT "by", k, round(sqrt(greatest(0.0, 1 - list_sum(list_transform(list_zip(p, q), lambda z: sqrt(z[1] * z[2]))))), 6) AS distance FROM h WHERE q IS NOT NULL""")
def hellinger_lag(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col("label").alias("by"), F.col("vec_id").alias("k"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    e = e.withColumn("_s", F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).select("by", "k", F.transform("v", lambda x: x / F.col("_s")).alias("p"))
    return signals.hellinger(e)


@query("md_links", """SELECT path, target, count(*) AS n FROM (SELECT url AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) x GROUP BY ALL""")
def md_links(spark, d):
    return corpus.links(fx.table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")))


@query("glossary_terms", """WITH p AS (SELECT a.conv_id AS ws, a.text AS asr, b.text AS corrected FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
w AS (SELECT ws, unnest(list_distinct(list_filter(regexp_split_to_array(lower(corrected), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2))) AS term, list_filter(regexp_split_to_array(lower(asr), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2) AS old FROM p)
SELECT term, count(*) AS n, count(DISTINCT ws) AS sources FROM w WHERE NOT list_contains(old, term) GROUP BY term""")
def glossary_terms(spark, d):
    c = fx.table(spark, d, "conversations")
    a = c.where("role = 'user'").select(F.col("conv_id").alias("ws"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("asr"))
    b = c.where("role = 'assistant'").select(F.col("conv_id").alias("ws"), "turn", F.col("text").alias("corrected"))
    return corpus.terms(a.join(b, ["ws", "turn"]))


IMAGES = """img AS (SELECT user_id % 200 AS image_id, concat_ws(':', user_id, event_type) AS edge_id, CASE WHEN event_type = 'view' THEN 'inventory' ELSE 'canonical' END AS source, epoch_us(ts) AS t_us, CASE WHEN value > 100 THEN value END AS score, event_id AS seq FROM events),
rec AS (SELECT image_id, count(DISTINCT edge_id) AS causes, bool_or(source <> 'inventory') AS tracked, min(t_us) AS first_us, max(t_us) AS last_us FROM img GROUP BY image_id),
sc AS (SELECT image_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY t_us DESC, seq DESC) AS rn FROM img WHERE score IS NOT NULL) x WHERE rn = 1),
im AS (SELECT rec.image_id, causes, tracked, score, first_us, last_us FROM rec LEFT JOIN sc ON rec.image_id = sc.image_id)"""


@query("image_merge", f"WITH {IMAGES} SELECT * FROM im")
def image_merge(spark, d):
    return corpus.merged_images(fx.images(spark, d))


@query("image_counts", f"""WITH {IMAGES}, {LOG}, r AS (SELECT image_id, 'frames/' || image_id AS path, score IS NOT NULL AS ex, tracked, CASE WHEN tracked THEN causes ELSE 0 END AS causes FROM im),
lk AS (SELECT DISTINCT CASE WHEN status = 'verified' THEN 'frames/' || id ELSE id END AS image FROM acc)
SELECT count(*) AS images, count(*) FILTER (ex) AS available_images, count(*) FILTER (tracked) AS tracked_images, count(*) FILTER (NOT tracked) AS legacy_untracked_images,
  count(*) FILTER (path IN (SELECT image FROM lk) OR image_id::VARCHAR IN (SELECT image FROM lk)) AS checkpoint_linked_images, coalesce(sum(causes), 0)::BIGINT AS causal_edges, count(*) FILTER (causes = 0) AS unknown_inventory_links FROM r""")
def image_counts(spark, d):
    """A scored image is there; verified checkpoints link by path, the others by id."""
    im = corpus.merged_images(fx.images(spark, d))
    records = im.select("image_id", F.concat(F.lit("frames/"), F.col("image_id").cast("string")).alias("path"), F.col("score").isNotNull().alias("exists"), "tracked", F.when(F.col("tracked"), F.col("causes")).otherwise(0).alias("causes"))
    log = ledger.guarded(ledger.validated(fx.ledger(spark, d), DURATION).where("code is null")).where("accepted")
    links = log.select(F.when(F.col("status") == "verified", F.concat(F.lit("frames/"), "id")).otherwise(F.col("id")).alias("image"))
    return corpus.image_counts(records, links)


def access_log(spark, d):
    e = fx.table(spark, d, "events").select("ts", F.col("event_type").alias("command"), (F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long") % 10).alias("hits"))
    return e


@query("access_summary", """SELECT event_type AS command, count(*) AS calls, count(*) FILTER (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 10 = 0) AS empty, max(ts) AS last FROM events GROUP BY 1""")
def access_summary(spark, d):
    return corpus.access(access_log(spark, d))


STEPS = """lab AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
steps AS (SELECT d.doc_id AS step, source AS ws, lang AS task, 'tool-' || (d.doc_id % 3) AS tool, CASE WHEN quality IS NULL THEN 'unsupported' WHEN quality = 1 AND toxic = 0 THEN 'cross_modal' WHEN quality = 1 THEN 'visual_only' ELSE 'transcript_only' END AS level FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id)"""


@query("evidence_distribution", f"WITH {STEPS} SELECT task, count(*) AS steps, {', '.join(f'''count(*) FILTER (level = '{x}') AS n_{x}''' for x in corpus.LEVELS)} FROM steps GROUP BY ROLLUP (task)")
def evidence_distribution(spark, d):
    return corpus.evidence(fx.procedures(spark, d))


@query("durable_entities", "WITH a AS (SELECT c.c_name AS entity, o_orderstatus AS ws FROM orders JOIN customer c ON o_custkey = c_custkey) SELECT entity, count(*) AS appearances, count(DISTINCT ws) AS workspaces, count(*) >= 2 AS durable FROM a GROUP BY entity")
def durable_entities(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("ws"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("entity"))
    return corpus.durable(o.join(c, "o_custkey").select("entity", "ws"))


@query("relation_edges", "SELECT DISTINCT n_name AS s, 'in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY s, p, o LIMIT 60")
def relation_edges(spark, d):
    n, r = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    return corpus.relations(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o")))


@query("storage_rollup", "SELECT l_suppkey AS ws, p_type AS category, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS bytes, count(*) AS files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (l_suppkey, p_type)")
def storage_rollup(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("ws"), (F.col("l_quantity").cast("long") * 1000).alias("size"))
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    return corpus.storage(li.join(p, "l_partkey"))


@query("scene_min_gap")
def scene_min_gap(spark, d):
    return folds.scene_gap(signals.scenes(fx.signals(spark, d), 50, 4900.2))


@query("lanes")
def lanes(spark, d):
    return folds.lanes(state(spark, d))


@query("keyframe_greedy")
def keyframe_greedy(spark, d):
    return folds.keyframes(signals.scenes(fx.signals(spark, d), 50, 4900.2), 12, 20_000, 1_000)


@query("rolling_captions")
def rolling_captions(spark, d):
    return folds.rolling(fx.turns(spark, d))


@query("trigger_alignment")
def trigger_alignment(spark, d):
    log = fx.ledger(spark, d)
    return folds.trigger_alignment(ledger.guarded(ledger.validated(log, DURATION).where("code is null")).where("accepted"))


@query("access_stream", """SELECT event_type AS command, count(*) AS calls, count(*) FILTER (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 10 = 0) AS empty FROM events GROUP BY 1""")
def access_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    e = e.select("ts", F.col("event_type").alias("command"), (F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long") % 10).alias("hits"))
    import uuid

    return tail.drained(tail.access_counts(e), f"access_{uuid.uuid4().hex[:8]}", "complete")
