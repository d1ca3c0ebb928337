"""Registered queries of tempo, energy, kept names, and of rules as whole as the evidence model has them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import conflicts, intervals, series, signals, tempo, transcript, wiki
from ..sources import fixtures as fx
from .registry import SERIES, TURNS, WORD_SQL, islands_sql, query

#: 64 samples a second, frames of 16 every 8: lags of 2 to 8 frames.
SHAPE = tempo.Shape(64, 16, 8)

SAMPLES = f"{SERIES}, sm AS (SELECT ws AS media, i - 1 AS i, value / 250 - 1 AS y FROM ser)"


def samples(spark, d):
    """Events of a type as one media's samples."""
    return fx.signals(spark, d).select(F.col("ws").alias("media"), (F.col("i") - 1).alias("i"), (F.col("value") / 250 - 1).alias("y"))


@query("beat_grid", f"""WITH RECURSIVE {SAMPLES}, le AS (SELECT media, count(*) AS samples FROM sm GROUP BY media),
fr AS (SELECT media, f, i - 8 * f AS p, y * (0.5 - 0.5 * cos(2 * pi() * (i - 8 * f) / 15)) AS w FROM (SELECT sm.*, unnest([i // 8 - 1, i // 8]) AS f, samples FROM sm JOIN le USING (media)) x WHERE f >= 0 AND f <= (samples - 16) // 8),
mg AS (SELECT media, f, b, sqrt(pow(sum(w * cos(2 * pi() * b * p / 16)), 2) + pow(sum(w * sin(2 * pi() * b * p / 16)), 2)) AS m FROM fr CROSS JOIN (SELECT unnest(range(9)) AS b) q GROUP BY ALL),
up AS (SELECT media, f, coalesce(greatest(0, m - lag(m) OVER (PARTITION BY media, b ORDER BY f)), 0) AS u FROM mg),
fl AS MATERIALIZED (SELECT media, f, sum(u) AS x FROM up GROUP BY ALL),
me AS MATERIALIZED (SELECT le.media, count(f) AS n, max(x) AS peak, avg(x) AS mean, CASE WHEN any_value(samples) < 128 OR count(f) <= 8 THEN 'short' WHEN NOT max(x) > 0 THEN 'silent' END AS reason FROM le LEFT JOIN fl USING (media) GROUP BY le.media),
ce AS (SELECT media, f, (x - mean) / peak AS c FROM fl JOIN me USING (media) WHERE reason IS NULL),
ac AS MATERIALIZED (SELECT a.media, g, sum(a.c * b.c) AS v FROM ce a CROSS JOIN (SELECT unnest(range(10)) AS g) q JOIN ce b ON b.media = a.media AND b.f = a.f + g GROUP BY ALL),
oc AS (SELECT media, arg_max(g, v)::DOUBLE AS lag FROM ac WHERE g BETWEEN 2 AND 8 GROUP BY media
  UNION ALL SELECT oc.media, lag / 2 FROM oc JOIN ac z ON z.media = oc.media AND z.g = round_even(lag, 0) JOIN ac a ON a.media = oc.media AND a.g = floor(lag / 2) JOIN ac b ON b.media = oc.media AND b.g = floor(lag / 2) + 1
  WHERE lag / 2 >= 2 AND (greatest(a.v, b.v) >= 0.7 * z.v OR (least(a.v, b.v) >= 0.2 * z.v AND a.v + b.v >= 0.7 * z.v))),
lg AS (SELECT media, min(lag) AS lag FROM oc GROUP BY media),
gr AS (SELECT media, lag, n, phase, k, phase + k * lag AS pos FROM (SELECT media, lag, n, unnest(range(floor(lag)::BIGINT)) AS phase FROM lg JOIN me USING (media)) x CROSS JOIN (SELECT unnest(range((SELECT max(n) FROM me))) AS k) q WHERE phase + k * lag < n),
ph AS (SELECT media, arg_max(phase, s) AS phase FROM (SELECT gr.media, phase, sum(x) AS s FROM gr JOIN fl ON fl.media = gr.media AND fl.f = floor(pos) GROUP BY ALL) x GROUP BY media)
SELECT gr.media, round(480 / any_value(lag), 2) AS bpm, NULL AS reason, k AS beat, round(arg_max(f, x) / 8, 4) AS beat_s FROM gr JOIN ph USING (media, phase) JOIN fl ON fl.media = gr.media AND fl.f BETWEEN round_even(pos, 0) - 1 AND round_even(pos, 0) + 1 GROUP BY gr.media, k
UNION ALL SELECT media, NULL, reason, NULL, NULL FROM me WHERE reason IS NOT NULL""")
def beat_grid(spark, d):
    """Tempo and beats of the events of a type."""
    return tempo.beat_grid(samples(spark, d), SHAPE, 512)


@query("energy_seconds", f"""WITH {SAMPLES}, le AS (SELECT media, max(i) AS last FROM sm GROUP BY media)
SELECT media, i // 64 AS second, round(sqrt(avg(y * y)), 5) AS rms FROM sm JOIN le USING (media) WHERE (i // 64 + 1) * 64 <= last GROUP BY media, i // 64""")
def energy_seconds(spark, d):
    """Energy of whole seconds."""
    return tempo.energy(samples(spark, d), 64)


@query("loudness_levels", f"WITH {SAMPLES} SELECT media, i // 32 AS w, CASE WHEN sqrt(avg(y * y)) > 0 THEN 20 * log10(sqrt(avg(y * y))) END AS rms_db FROM sm GROUP BY ALL")
def loudness_levels(spark, d):
    """Levels of windows of half a second."""
    return tempo.loudness(samples(spark, d), 32)


@query("kept_names", """WITH RECURSIVE s AS (SELECT source AS ws, lang || '.md' AS name, doc_id AS n, md5(coalesce(text, '')) AS d, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents WHERE lang IS NOT NULL),
h AS (SELECT source AS ws, lang || '.md' AS name, 1 + n_chars % 1000 AS slot, arg_min(md5(coalesce(text, '')), doc_id) AS d FROM documents WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL),
o AS (SELECT k.ws, k.name, coalesce(list({'slot': slot, 'd': d}) FILTER (slot IS NOT NULL), []) AS held FROM (SELECT DISTINCT ws, name FROM s) k LEFT JOIN h ON h.ws IS NOT DISTINCT FROM k.ws AND h.name = k.name GROUP BY ALL),
r AS (SELECT ws, name, 0::BIGINT AS pos, NULL::BIGINT AS n, held, NULL::BIGINT AS slot, false AS moved FROM o
  UNION ALL SELECT ws, name, pos, n, CASE WHEN own IS NULL THEN list_append(held, {'slot': gap, 'd': d}) ELSE held END, coalesce(own, gap), own IS NULL
  FROM (SELECT *, list_min(list_transform(list_filter(held, lambda e: e.d = d AND e.slot < gap), lambda e: e.slot)) AS own
    FROM (SELECT s.*, r.held, list_min(list_filter(range(1, len(r.held) + 2), lambda k: NOT list_contains(list_transform(r.held, lambda x: x.slot), k))) AS gap FROM r JOIN s ON s.ws IS NOT DISTINCT FROM r.ws AND s.name = r.name AND s.pos = r.pos + 1) x) y)
SELECT ws, name, n, CASE WHEN slot = 1 THEN name ELSE name[:-4] || '--' || slot || '.md' END AS target, moved FROM r WHERE pos > 0""")
def kept_names(spark, d):
    """Documents as files named by their language, where labelled ones lie in slots by their length already."""
    x = fx.table(spark, d, "documents").where("lang is not null")
    x = x.select(F.col("source").alias("ws"), F.concat("lang", F.lit(".md")).alias("name"), F.col("doc_id").alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), (1 + F.col("n_chars") % 1000).alias("slot"))
    known = x.join(fx.table(spark, d, "labels").select(F.col("doc_id").alias("n")), "n", "left_semi").groupBy("ws", "name", "slot").agg(F.min_by("digest", "n").alias("digest"))
    return conflicts.kept_names(x, known.select("ws", conflicts.numbered(F.col("name"), F.col("slot")).alias("name"), "digest"))


@query("split_segments", f"""WITH {TURNS}{WORD_SQL}, sg AS (SELECT ws, id // 4 AS id, min(start_ms) AS a, max(end_ms) AS b, arg_min(text, id) AS text, count(*) / 8 AS conf FROM seg GROUP BY 1, 2),
wd AS (SELECT ws, id * 100000 + pos AS n, start_ms, end_ms, ' ' || word AS word, CASE WHEN len(word) > 2 THEN len(word) / 40 END AS p FROM word),
j AS (SELECT sg.ws, sg.id, conf, n, start_ms, end_ms, word, p FROM sg JOIN wd ON wd.ws = sg.ws AND start_ms >= a - 10 AND start_ms < b + 10),
o AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY ws, id ORDER BY n) > 1500 THEN 1 ELSE 0 END AS o FROM j),
k AS (SELECT *, sum(o) OVER (PARTITION BY ws, id ORDER BY n ROWS UNBOUNDED PRECEDING) AS part FROM o),
pt AS (SELECT ws, id, part, arg_min(start_ms, n) AS start_ms, arg_max(end_ms, n) AS end_ms, trim(string_agg(word, '' ORDER BY n)) AS text, CASE WHEN bool_or(p IS NOT NULL AND n = f) THEN round(sum(CAST(round(coalesce(p, 0) * 1000000) AS BIGINT)) / 1000000.0 / count(*), 3) ELSE any_value(conf) END AS conf, max(part) AS m
  FROM (SELECT *, min(n) OVER (PARTITION BY ws, id, part) AS f FROM k) x GROUP BY ws, id, part),
sp AS (SELECT DISTINCT ws, id FROM pt WHERE part > 0),
al AS (SELECT ws, id, part, start_ms, end_ms, text, conf FROM pt WHERE (ws, id) IN (SELECT (ws, id) FROM sp) UNION ALL SELECT ws, id, 0, a, b, text, conf FROM sg WHERE (ws, id) NOT IN (SELECT (ws, id) FROM sp))
SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY id, part) - 1 AS id, start_ms, end_ms, text, conf FROM al""")
def split_segments(spark, d):
    """F16: four turns at a time as a segment, words with a confidence by their length."""
    t = fx.turns(spark, d)
    seg = t.groupBy("ws", F.floor(F.col("id") / 4).alias("id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("text", "id").alias("text"), (F.count("*") / 8).alias("conf"))
    w = transcript.words(t).select("ws", (F.col("id") * 100_000 + F.col("pos")).alias("n"), "start_ms", "end_ms", F.concat(F.lit(" "), "word").alias("word"), F.when(F.length("word") > 2, F.length("word") / 40).alias("p"))
    return transcript.split_segments(seg, w)


@query("scene_rates", f"""WITH {SERIES}, s AS (SELECT ws, i, i * 10 * len(ws) AS t_ms, round(value / 4900.2, 6) AS score FROM ser),
m AS (SELECT a.ws, a.i, avg(CAST(trunc(b.score * 1000000) AS BIGINT)) / 1000000.0 AS mean FROM s a JOIN s b ON b.ws = a.ws AND b.i BETWEEN a.i - greatest(1, round_even(200 / len(a.ws), 0)) AND a.i - 1 GROUP BY ALL)
SELECT ws, i, t_ms, score FROM s LEFT JOIN m USING (ws, i) WHERE score >= 0.3 OR (score >= 0.04 AND score >= 3.0 * mean)""")
def scene_rates(spark, d):
    """series of different frame rates."""
    return signals.scenes_by_rate(fx.signals(spark, d).withColumn("t_ms", F.col("i") * 10 * F.length("ws")), 4900.2)


@query("cadence_proofs", f"""WITH {SERIES}, f AS (SELECT ws, i - 1 AS idx, (i - 1) * 40 + CASE WHEN value > 480 AND ws < 'm' THEN 1 ELSE 0 END AS pts, value FROM ser),
a AS (SELECT ws, arg_min(pts, idx) AS p0, arg_max(pts, idx) + 40 AS p1, count(*) AS n, CAST(floor(max(value)) AS BIGINT) AS v, max(pts - idx * 40) - min(pts - idx * 40) < 1 AS even FROM f GROUP BY ws),
h AS (SELECT *, v % 2 AS start_pts, CASE WHEN v % 3 > 0 THEN n END AS nb, n * 40 + v % 5 // 4 AS dur FROM a)
SELECT ws, p0 = start_pts AS first_ok, nb IS NULL OR nb = n AS count_ok, p1 - p0 = dur AS length_ok, even AS lattice_ok, p0 = start_pts AND (nb IS NULL OR nb = n) AND p1 - p0 = dur AND even AS proven FROM h""")
def cadence_proofs(spark, d):
    """Frames of five media, some late, beside headers by their largest value."""
    s = fx.signals(spark, d)
    idx = F.col("i") - 1
    frames = s.select("ws", idx.alias("idx"), (idx * 40 + F.when((F.col("value") > 480) & (F.col("ws") < "m"), 1).otherwise(0)).alias("pts"), F.lit(40).alias("duration"))
    v = F.floor(F.max("value"))
    head = s.groupBy("ws").agg((v % 2).alias("start_pts"), F.when(v % 3 > 0, F.count("*")).alias("nb_frames"), (F.count("*") * 40 + F.floor(v % 5 / 4)).alias("duration_ts"))
    return signals.cadence(frames, head, 40, 1)


@query("bounded_union", f"""WITH s AS (SELECT event_type AS ws, greatest(0, CAST(floor(value * 1000) AS BIGINT) - 20000) AS a, least(400000, CAST(floor(value * 1000) AS BIGINT) + user_id) AS b FROM events),
u AS (SELECT ws, a, b FROM s WHERE a <= b), {islands_sql('n', 'u', 'ws', 'a', 'b')} SELECT ws, a AS start_ms, b AS end_ms, n FROM n""")
def bounded_union(spark, d):
    """Spans before and behind a value, within 400 s."""
    e, at = fx.table(spark, d, "events"), F.floor(F.col("value") * 1000)
    spans = e.select(F.col("event_type").alias("ws"), (at - 20_000).alias("start_ms"), (at + F.col("user_id")).alias("end_ms"))
    return intervals.union_within(spans, ["ws"], "start_ms", "end_ms", F.lit(400_000).cast("long"))


@query("published_index", """WITH ca AS (SELECT DISTINCT l_suppkey AS ws, l_partkey AS image FROM lineitem WHERE l_returnflag = 'R'), ix AS (SELECT DISTINCT l_suppkey AS ws, l_partkey AS image FROM lineitem WHERE l_linestatus = 'F' OR l_shipdate IS NULL),
dc AS (SELECT s_suppkey AS ws, CASE WHEN s_acctbal > 0 THEN (SELECT count(*) FROM ca WHERE ca.ws = s_suppkey) + CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END END AS declared FROM supplier WHERE s_nationkey > 4),
j AS (SELECT coalesce(ca.ws, ix.ws) AS ws, ca.ws IS NOT NULL AS c, ix.ws IS NOT NULL AS i FROM ca FULL JOIN (SELECT * FROM ix WHERE ws IN (SELECT ws FROM dc)) ix ON ix.ws = ca.ws AND ix.image = ca.image),
g AS (SELECT ws, count(*) FILTER (c) AS catalog, count(*) FILTER (i) AS indexed, count(*) FILTER (NOT i) AS missing, count(*) FILTER (NOT c) AS orphaned FROM j GROUP BY ws)
SELECT coalesce(g.ws, dc.ws) AS ws, dc.ws IS NOT NULL AS doc_present, coalesce(catalog, 0) AS catalog, coalesce(indexed, 0) AS indexed, declared, coalesce(missing, 0) AS missing, coalesce(orphaned, 0) AS orphaned,
  CASE WHEN dc.ws IS NULL THEN coalesce(catalog, 0) > 0 ELSE coalesce(missing, 0) > 0 OR coalesce(orphaned, 0) > 0 OR declared IS NULL OR declared <> coalesce(catalog, 0) END AS stale FROM g FULL JOIN dc ON dc.ws = g.ws""")
def published_index(spark, d):
    """Returned parts as the catalogue, finished ones as the index, suppliers as documents that declare by their balance."""
    li = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ws"), F.col("l_partkey").alias("image"), "l_returnflag", "l_linestatus", "l_shipdate")
    ca, ix = li.where("l_returnflag = 'R'").select("ws", "image"), li.where("l_linestatus = 'F' or l_shipdate is null").select("ws", "image")
    n = ca.distinct().groupBy("ws").agg(F.count("*").alias("n"))
    s = fx.table(spark, d, "supplier").where("s_nationkey > 4").select(F.col("s_suppkey").alias("ws"), "s_acctbal").join(n, "ws", "left")
    declared = F.when(F.col("s_acctbal") > 0, F.coalesce("n", F.lit(0)) + F.when(F.col("s_acctbal") > 5000, 1).otherwise(0))
    return wiki.published(ca, ix, s.select("ws", declared.alias("declared")))


@query("tail_cards", """WITH f AS (SELECT user_id AS ws, 40 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value % 40 AS luma, round(value % 1, 4) AS look FROM events),
m AS (SELECT ws, max(t) + 40 AS dur FROM f GROUP BY ws), c AS (SELECT ws, greatest(dur - 200, 0) AS l FROM m),
t AS (SELECT DISTINCT ws, CAST(least(round(greatest(l - 2500, 0) + (l - greatest(l - 2500, 0)) * k / 4), l) AS BIGINT) AS t FROM c CROSS JOIN (SELECT unnest(range(5)) AS k) q),
s AS (SELECT t.ws, t.t, f.luma, f.look FROM t ASOF JOIN f ON f.ws = t.ws AND t.t >= f.t WHERE f.luma >= 16),
n AS (SELECT *, round(1 - abs(look - lag(look) OVER w), 4) AS a, round(1 - abs(look - lead(look) OVER w), 4) AS b FROM s WINDOW w AS (PARTITION BY ws ORDER BY t))
SELECT ws, t AS t_ms, alike FROM (SELECT *, greatest(a, b) AS alike, row_number() OVER (PARTITION BY ws ORDER BY coalesce(greatest(a, b), -1) DESC, t DESC) AS rn FROM n) x WHERE rn = 1""")
def tail_cards(spark, d):
    """a user's events as frames."""
    e = fx.table(spark, d, "events")
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") * 40
    f = e.select(F.col("user_id").alias("ws"), at.alias("t_ms"), (F.col("value") % 40).alias("luma"), F.round(F.col("value") % 1, 4).alias("look"))
    return series.tail_card(f.groupBy("ws").agg((F.max("t_ms") + 40).alias("duration_ms")), f)
