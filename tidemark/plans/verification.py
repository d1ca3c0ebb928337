"""Registered queries of verification, grounding, series and boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import audit, ledger, series
from ..operators import transcript as tr
from ..sources import fixtures as fx
from .registry import DURATION, LOG, TURNS, WORD_SQL, islands_sql, query, state

DAY = 86_400_000_000

# -- verification: a terminal checkpoint's artifact is an image by its line, its segment the invalid rows of its id

GRADED = f"""{LOG}, raw_img AS (SELECT user_id % 200 AS image_id, bool_or(event_type <> 'view') AS tracked, min(epoch_us(ts)) - 1704067200000000 AS t FROM events GROUP BY 1),
vis AS (SELECT l.ws, l.id, 'frames/' || ((l.line_no * 7 + CAST(l.id AS BIGINT)) % 200) || '.jpg' AS artifact, CASE WHEN r.tracked IS NULL THEN 'artifact_unavailable' WHEN NOT r.tracked THEN 'provenance_missing' WHEN r.t < l.start_us - {DAY} OR r.t >= l.end_us + {DAY} THEN 'timestamp_outside_span' END AS code
  FROM latest l LEFT JOIN raw_img r ON r.image_id = (l.line_no * 7 + CAST(l.id AS BIGINT)) % 200 WHERE l.status <> 'hypothesized' AND l.line_no % 2 = 0),
sg AS (SELECT ws, id, min(start_us) AS s, max(end_us) AS e FROM log WHERE status = 'invalid' GROUP BY ws, id),
ref AS (SELECT l.ws, l.id, coalesce(greatest(l.start_us, sg.s) < least(l.end_us, sg.e), false) AS ok FROM latest l LEFT JOIN sg ON sg.ws = l.ws AND sg.id = l.id WHERE l.status <> 'hypothesized' AND l.line_no % 3 = 0),
v1 AS (SELECT ws, id, bool_or(code IS NULL) AS v FROM vis GROUP BY ws, id), t1 AS (SELECT ws, id, bool_and(ok) AS t FROM ref GROUP BY ws, id),
gr AS (SELECT l.*, v1.v IS NOT NULL AS dv, t1.t IS NOT NULL AS dt, coalesce(v, false) AS gv, coalesce(t, false) AS gt, l.line_no % 5 = 0 AS legacy, l.line_no % 7 > 0 AS noted FROM latest l LEFT JOIN v1 ON v1.ws = l.ws AND v1.id = l.id LEFT JOIN t1 ON t1.ws = l.ws AND t1.id = l.id WHERE l.status <> 'hypothesized'),
iss AS (SELECT ws, id, 'missing_support' AS code, NULL AS artifact FROM gr WHERE NOT (gv OR gt) UNION ALL SELECT ws, id, 'legacy_unstructured', NULL FROM gr WHERE NOT (gv OR gt) AND legacy
  UNION ALL SELECT ws, id, 'correction_note_missing', NULL FROM gr WHERE status = 'corrected' AND NOT noted UNION ALL SELECT ws, id, code, artifact FROM vis WHERE code IS NOT NULL)"""


def _level(v: str, t: str) -> str:
    return f"CASE WHEN {v} AND {t} THEN 'cross_modal' WHEN {v} THEN 'visual_only' WHEN {t} THEN 'transcript_only' ELSE 'unsupported' END"


def evidence(spark, d) -> tuple[DataFrame, DataFrame]:
    """Graded terminal checkpoints, and their visual references."""
    done = state(spark, d).where("status <> 'hypothesized'")
    e = fx.table(spark, d, "events").select((F.col("user_id") % 200).alias("image_id"), "event_type", fx.micros("ts", "2024-01-01").alias("t"))
    images = e.groupBy("image_id").agg(F.bool_or(F.col("event_type") != "view").alias("tracked"), F.min("t").alias("t"))
    wants = done.where("line_no % 2 = 0").withColumn("image_id", (F.col("line_no") * 7 + F.col("id").cast("long")) % 200)
    j = wants.join(images, "image_id", "left")
    code = F.when(F.col("tracked").isNull(), "artifact_unavailable").when(~F.col("tracked"), "provenance_missing")
    code = code.when((F.col("t") < F.col("start_us") - DAY) | (F.col("t") >= F.col("end_us") + DAY), "timestamp_outside_span")
    visual = j.select("ws", "id", F.concat(F.lit("frames/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("artifact"), code.alias("code"))
    there = fx.ledger(spark, d).where("status = 'invalid'").groupBy("ws", "id").agg(F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    refs = done.where("line_no % 3 = 0").join(there, ["ws", "id"], "left")
    segments = refs.select("ws", "id", F.coalesce(F.greatest("start_us", "s") < F.least("end_us", "e"), F.lit(False)).alias("ok"))
    graded = audit.levels(done.withColumns({"legacy": F.col("line_no") % 5 == 0, "noted": F.col("line_no") % 7 > 0}), visual, segments)
    return graded, visual


@query("evidence_levels", f"WITH {GRADED} SELECT ws, id, {_level('dv', 'dt')} AS declared, {_level('gv', 'gt')} AS grounded, gv OR gt AS supported FROM gr")
def evidence_levels(spark, d):
    """E05, D01, D02, D18."""
    return evidence(spark, d)[0].select("ws", "id", "declared", "grounded", "supported")


@query("verification_issues", f"WITH {GRADED} SELECT * FROM iss")
def verification_issues(spark, d):
    """Rows."""
    return audit.issues(*evidence(spark, d))


@query("verification_audit", f"""WITH {GRADED}, ok_ AS (SELECT ws, greatest(start_us, 0) AS start_us, least(end_us, {DURATION}) AS end_us FROM gr WHERE gv OR gt), {islands_sql('u', 'ok_', 'ws', 'start_us', 'end_us')}
SELECT c.ws, terminal_count, supported_count, coalesce(share, 0) AS supported_ratio, coalesce(issues, 0) AS issues FROM (SELECT ws, count(*) AS terminal_count, count(*) FILTER (gv OR gt) AS supported_count FROM gr GROUP BY ws) c
LEFT JOIN (SELECT ws, round(CAST(sum(end_us - start_us) AS BIGINT) / {float(DURATION)}, 4) AS share FROM u GROUP BY ws) s ON s.ws = c.ws LEFT JOIN (SELECT ws, count(*) AS issues FROM iss GROUP BY ws) i ON i.ws = c.ws""")
def verification_audit(spark, d):
    """Roll-up."""
    graded, visual = evidence(spark, d)
    return audit.audit(graded, audit.issues(graded, visual), DURATION)


PRIORITY = f"""{LOG}, op AS (SELECT ws, id, start_us, end_us, confidence FROM latest WHERE status = 'hypothesized'),
sg AS (SELECT ws, start_us AS s, end_us AS e, confidence AS conf, CASE WHEN CAST(id AS BIGINT) % 4 > 0 THEN 'k' || (CAST(id AS BIGINT) % 4) ELSE '' END AS speaker FROM log WHERE status = 'invalid' AND start_us < end_us),
hd AS (SELECT op.ws, op.id, count(*) AS n, count(*) FILTER (conf < 0.6) AS weak, count(DISTINCT CASE WHEN speaker <> '' THEN speaker END) AS speakers FROM op JOIN sg ON sg.ws = op.ws AND s < end_us AND start_us < e GROUP BY op.ws, op.id),
sc AS (SELECT op.ws, op.id, start_us, end_us, round(coalesce(1 - confidence, 0.5), 4) AS self_doubt, CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END AS transcript_silence, round(coalesce(weak / n, 0.0), 4) AS asr_weakness,
  CASE WHEN speakers >= 2 THEN 1.0 ELSE 0.0 END AS speaker_shift FROM op LEFT JOIN hd ON hd.ws = op.ws AND hd.id = op.id),
pr AS (SELECT *, round(self_doubt::DOUBLE * 0.4::DOUBLE + transcript_silence::DOUBLE * 0.25::DOUBLE + asr_weakness::DOUBLE * 0.2::DOUBLE + speaker_shift::DOUBLE * 0.15::DOUBLE, 3) AS score FROM sc)"""


def priorities(spark, d):
    speaker = F.when(F.col("id").cast("long") % 4 > 0, F.concat(F.lit("k"), (F.col("id").cast("long") % 4).cast("string"))).otherwise("")
    seg = fx.ledger(spark, d).where("status = 'invalid'").select("ws", F.col("start_us").alias("rstart"), F.col("end_us").alias("rend"), F.col("confidence").alias("conf"), speaker.alias("speaker"))
    return audit.priorities(state(spark, d).where("status = 'hypothesized'"), seg, DAY // 4)


@query("verify_signals", f"WITH {PRIORITY} SELECT * FROM pr")
def verify_signals(spark, d):
    """D05."""
    return priorities(spark, d)


@query("verify_queue", f"WITH {PRIORITY} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY score DESC, start_us, id) AS rank FROM pr) x WHERE rank <= 5")
def verify_queue(spark, d):
    """The open hypotheses most in doubt, five a workspace."""
    return audit.queue(priorities(spark, d))


# -- grounding of cuts: two evidence spans a cut, a checkpoint named by three cuts in four

CUT = """li AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord, l_partkey % 1000 AS start_s, CAST(l_quantity AS BIGINT) AS len FROM lineitem),
ct AS (SELECT seq, ord, start_s * 1000 AS "start", (start_s + len) * 1000 AS "end", len FROM li)"""
GROUND = f"""{CUT}, ev AS (SELECT seq, ord, "start" + (ord % 3) * 700 AS s, "start" + len * 600 AS e FROM ct UNION ALL SELECT seq, ord, "start" + len * (500 + (seq % 3) * 200), "end" - (seq % 5) * 300 FROM ct),
e2 AS (SELECT ct.seq, ct.ord, "start", "end", greatest("start", s) AS s, least("end", e) AS e FROM ct JOIN ev ON ev.seq = ct.seq AND ev.ord = ct.ord WHERE greatest("start", s) < least("end", e)),
e3 AS (SELECT *, max(e) OVER (PARTITION BY seq, ord ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e2),
gp AS (SELECT seq, ord, "start", "end", coalesce(m, "start") AS gap_start, s AS gap_end FROM e3 WHERE s > coalesce(m, "start") UNION ALL SELECT seq, ord, "start", "end", max(e), "end" FROM e2 GROUP BY seq, ord, "start", "end" HAVING max(e) < "end"
  UNION ALL SELECT seq, ord, "start", "end", "start", "end" FROM ct WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE e2.seq = ct.seq AND e2.ord = ct.ord)),
gb AS (SELECT *, NOT ((gap_start = "start" OR gap_end = "end") AND gap_end - gap_start <= least(2000.0, ("end" - "start") * 0.1::DOUBLE)) AS blocking FROM gp)"""


def grounding(spark, d):
    c = fx.cuts(spark, d).select("seq", "ord", (F.col("start_s") * 1000).alias("start"), ((F.col("start_s") + F.col("length_s")) * 1000).alias("end"), "length_s")
    one = c.select("seq", "ord", (F.col("start") + F.col("ord") % 3 * 700).alias("s"), (F.col("start") + F.col("length_s") * 600).alias("e"))
    two = c.select("seq", "ord", (F.col("start") + F.col("length_s") * (500 + F.col("seq") % 3 * 200)).alias("s"), (F.col("end") - F.col("seq") % 5 * 300).alias("e"))
    return c, audit.uncovered(c.drop("length_s"), one.unionByName(two), ["seq", "ord"])


@query("cut_grounding", f"WITH {GROUND} SELECT * FROM gb")
def cut_grounding(spark, d):
    """Uncovered stretches, with the slack at a cut's edges."""
    return grounding(spark, d)[1]


@query("grounded_sequences", f"""WITH {GROUND}, rf AS (SELECT seq, ord, (seq * 3 + ord) % 400 AS id FROM ct WHERE (seq + ord) % 4 > 0), nm AS (SELECT rf.*, p_partkey IS NULL AS u, coalesce(p_size % 9 = 0, false) AS w FROM rf LEFT JOIN part ON p_partkey = rf.id),
bc AS (SELECT seq, ord, count(*) FILTER (u) AS unknown, count(*) FILTER (w) AS unsupported FROM nm GROUP BY seq, ord), bl AS (SELECT seq, ord, count(*) AS blocking FROM gb WHERE blocking GROUP BY seq, ord),
o AS (SELECT ct.seq, CAST(count(*) FILTER (unknown IS NULL) AS BIGINT) AS bare, CAST(sum(coalesce(unknown, 0)) AS BIGINT) AS unknown, CAST(sum(coalesce(unsupported, 0)) AS BIGINT) AS unsupported, CAST(sum(coalesce(blocking, 0)) AS BIGINT) AS blocking
  FROM ct LEFT JOIN bc ON bc.seq = ct.seq AND bc.ord = ct.ord LEFT JOIN bl ON bl.seq = ct.seq AND bl.ord = ct.ord GROUP BY ct.seq) SELECT *, bare + unknown + unsupported + blocking = 0 AS grounded FROM o""")
def grounded_sequences(spark, d):
    """H02, D09."""
    c, gaps = grounding(spark, d)
    refs = c.where("(seq + ord) % 4 > 0").select("seq", "ord", ((F.col("seq") * 3 + F.col("ord")) % 400).alias("id"))
    known = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 9 != 0).alias("supported"))
    return audit.grounded_sequences(c, refs, gaps, known)


PINS = f"""{CUT}, rf AS (SELECT seq, ord, (seq * 3 + ord) % 400 AS id FROM ct WHERE (seq + ord) % 4 > 0), pn AS (SELECT DISTINCT seq, id, sha256('r' || (id * 2 + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END)) AS pin FROM rf WHERE (id + seq) % 6 > 0),
cu AS (SELECT p_partkey AS id, sha256('r' || (p_partkey * 2)) AS hash FROM part), dr AS (SELECT seq, pn.id FROM pn LEFT JOIN cu ON cu.id = pn.id WHERE hash IS NULL OR hash <> pin)"""


def pinned(spark, d):
    c = grounding(spark, d)[0]
    refs = c.where("(seq + ord) % 4 > 0").select("seq", "ord", ((F.col("seq") * 3 + F.col("ord")) % 400).alias("id"))
    digest = lambda x: F.sha2(F.concat(F.lit("r"), x.cast("string")), 256)
    pins = refs.where("(id + seq) % 6 > 0").select("seq", "id", digest(F.col("id") * 2 + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("pin")).distinct()
    now = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), digest(F.col("p_partkey") * 2).alias("hash"))
    return c, refs, pins, audit.drift(pins, now)


@query("revision_drift", f"WITH {PINS} SELECT * FROM dr")
def revision_drift(spark, d):
    """D10."""
    return pinned(spark, d)[3]


@query("cut_states", f"""WITH {PINS}, g AS (SELECT rf.seq, rf.ord, bool_or(dr.id IS NOT NULL) AS dd, bool_or(pn.id IS NULL) AS uu FROM rf LEFT JOIN pn ON pn.seq = rf.seq AND pn.id = rf.id LEFT JOIN dr ON dr.seq = rf.seq AND dr.id = rf.id GROUP BY rf.seq, rf.ord)
SELECT CASE WHEN dd IS NULL AND ct.ord % 2 = 0 THEN 'signal_only' WHEN dd THEN 'drifted' WHEN uu THEN 'unpinned' ELSE 'current' END AS state, count(*) AS cuts, CAST(sum("end" - "start") AS BIGINT) AS total_ms FROM ct LEFT JOIN g ON g.seq = ct.seq AND g.ord = ct.ord GROUP BY 1""")
def cut_states(spark, d):
    """Cuts and their length by grounding state."""
    c, refs, pins, drifted = pinned(spark, d)
    cuts = c.select("seq", "ord", (F.col("end") - F.col("start")).alias("length"), (F.col("ord") % 2 == 0).alias("has_signals"))
    return audit.cut_states(refs, pins, drifted, cuts).groupBy("state").agg(F.count("*").alias("cuts"), F.sum("length").alias("total_ms"))


@query("mended_ends", f"""WITH {LOG.split('coded AS')[0].rstrip().rstrip(',')}, far AS (SELECT ws, id, line_no, start_us, end_us, CASE WHEN end_us > 1296000000000 AND end_us - 1296000000000 <= 3000000 AND start_us < 1296000000000 THEN 1296000000000 ELSE end_us END AS mended FROM
  (SELECT ws, id, line_no, start_us, CASE WHEN line_no % 2 = 0 THEN 1296000000000 + (line_no % 9) * 700000 ELSE end_us END AS end_us FROM log)) SELECT count(*) FILTER (mended <> end_us) AS mended, count(*) FILTER (mended > 1296000000000) AS beyond, CAST(sum(mended) AS BIGINT) AS total FROM far""")
def mended_ends(spark, d):
    """Legacy ends beyond the duration."""
    half = 1_296_000_000_000
    log = fx.ledger(spark, d).withColumn("end_us", F.when(F.col("line_no") % 2 == 0, F.lit(half) + F.col("line_no") % 9 * 700_000).otherwise(F.col("end_us")))
    out = audit.mended(log.withColumn("was", F.col("end_us")), half)
    return out.agg(F.count_if(F.col("was") != F.col("end_us")).alias("mended"), F.count_if(F.col("end_us") > half).alias("beyond"), F.sum("end_us").alias("total"))


MEDIA = "SELECT s_suppkey AS ws, round(s_acctbal, 3) AS duration, 25.0 + (s_suppkey % 3) * 0.006 AS fps, 1920 AS width, CASE WHEN s_suppkey % 11 = 0 THEN 1088 ELSE 1080 END AS height FROM supplier"


@query("probe_drift", f"""WITH a AS ({MEDIA}), b AS (SELECT ws, duration + CASE WHEN ws % 4 = 0 THEN 0.2 ELSE 0.01 END AS duration, 25.0 AS fps, 1920 AS width, 1080 AS height FROM a),
r AS (SELECT a.ws, concat_ws(',', CASE WHEN abs(a.duration - b.duration) > 0.05 THEN 'duration' END, CASE WHEN abs(a.fps - b.fps) > 0.01 THEN 'fps' END, CASE WHEN a.width <> b.width THEN 'width' END, CASE WHEN a.height <> b.height THEN 'height' END) AS drift FROM a JOIN b ON a.ws = b.ws)
SELECT * FROM r WHERE drift <> ''""")
def probe_drift(spark, d):
    """C11."""
    s = fx.table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("ws"), F.round("s_acctbal", 3).alias("duration"), (25.0 + F.col("s_suppkey") % 3 * 0.006).alias("fps"), F.lit(1920).alias("width"), F.when(F.col("s_suppkey") % 11 == 0, 1088).otherwise(1080).alias("height"))
    new = old.select("ws", (F.col("duration") + F.when(F.col("ws") % 4 == 0, 0.2).otherwise(0.01)).alias("duration"), F.lit(25.0).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return audit.probe_drift(old, new)


@query("binding_states", """WITH m AS (SELECT c_custkey % 7 > 0 AS readable, c_custkey % 4 AS ids, 3 AS wanted, c_nationkey % 2 = 0 AS draft FROM customer)
SELECT CASE WHEN NOT readable THEN 'unreadable' WHEN ids > 0 AND ids < wanted THEN 'incomplete' WHEN ids >= wanted THEN 'bound' WHEN draft THEN 'draft' ELSE 'legacy' END AS state, count(*) AS n FROM m GROUP BY 1""")
def binding_states(spark, d):
    """C12."""
    c = fx.table(spark, d, "customer").select((F.col("c_custkey") % 7 > 0).alias("readable"), (F.col("c_custkey") % 4).alias("ids"), F.lit(3).alias("wanted"), (F.col("c_nationkey") % 2 == 0).alias("draft"))
    return audit.binding(c).groupBy("state").agg(F.count("*").alias("n"))


@query("derived_spans", """WITH m AS (SELECT o_orderkey AS id, 100.0 + o_custkey % 900 AS duration, CAST(o_orderkey % 700 AS DOUBLE) AS s, 100.0 + o_custkey % 900 + (o_orderkey % 23) - 8 AS e FROM orders)
SELECT id, s AS "start", CASE WHEN e > duration AND s < duration AND e - duration <= greatest(5.0, duration * 0.01::DOUBLE) THEN duration ELSE e END AS "end" FROM m""")
def derived_spans(spark, d):
    """C09."""
    o = fx.table(spark, d, "orders")
    m = o.select(F.col("o_orderkey").alias("id"), (100.0 + F.col("o_custkey") % 900).alias("duration"), (F.col("o_orderkey") % 700).cast("double").alias("start"), (100.0 + F.col("o_custkey") % 900 + F.col("o_orderkey") % 23 - 8).alias("end"))
    return audit.clamped(m, F.col("duration")).select("id", "start", "end")


# -- presence: views are sights, clicks absences, purchases uncertain; an hour is an instant

SAMPLES = """sm AS (SELECT user_id % 20 AS ws, (epoch_us(ts) - 1704067200000000) // 3600000000 AS t, event_id AS n, CASE event_type WHEN 'view' THEN 'present' WHEN 'click' THEN 'absent' ELSE 'uncertain' END AS state, value > 100 AS grounded FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
HOURS = 720


def samples(spark, d):
    e = fx.table(spark, d, "events").where("event_type in ('view', 'click', 'purchase')")
    kind = F.when(F.col("event_type") == "view", "present").when(F.col("event_type") == "click", "absent").otherwise("uncertain")
    return e.select((F.col("user_id") % 20).alias("ws"), F.floor(fx.micros("ts", "2024-01-01") / 3_600_000_000).alias("t"), F.col("event_id").alias("n"), kind.alias("state"), (F.col("value") > 100).alias("grounded"))


@query("departures", f"""WITH {SAMPLES}, g AS (SELECT ws, t, count(DISTINCT state) AS states, first(state ORDER BY CASE WHEN grounded THEN 0 ELSE 1 END, n) AS st, first(grounded ORDER BY CASE WHEN grounded THEN 0 ELSE 1 END, n) AS gd, max(CASE WHEN state = 'absent' THEN 1 ELSE 0 END) AS ab FROM sm GROUP BY ws, t),
p AS (SELECT *, lag(states) OVER w AS ps, lag(st) OVER w AS pst, lag(gd) OVER w AS pgd, lag(t) OVER w AS pt FROM g WINDOW w AS (PARTITION BY ws ORDER BY t))
SELECT ws, pt AS before_t, t AS after_t, states = 1 AND pgd AND gd AS verified, CASE WHEN states > 1 THEN 'conflicting_state_at_timestamp' WHEN NOT (pgd AND gd) THEN 'endpoint_evidence_missing' END AS reason FROM p WHERE ps = 1 AND pst = 'present' AND ((states = 1 AND st = 'absent') OR (states > 1 AND ab = 1))""")
def departures(spark, d):
    """F12."""
    return series.departures(samples(spark, d))


def nations(spark, d):
    return fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ws"))


UNSURE = f"""{SAMPLES}, e AS (SELECT ws, min(t) FILTER (state <> 'uncertain') AS lo, max(t) FILTER (state <> 'uncertain') AS hi FROM sm GROUP BY ws),
r AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q, CASE WHEN state = 'uncertain' AND coalesce(lag(state) OVER w, '') <> 'uncertain' THEN 1 ELSE 0 END AS nw FROM sm WINDOW w AS (PARTITION BY ws ORDER BY t, n)),
k AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY t, n ROWS UNBOUNDED PRECEDING) AS k FROM r),
u AS (SELECT ws, k, coalesce(arg_min(coalesce(p, 0), t * 1000000000 + n), 0) AS s, coalesce(arg_max(coalesce(q, {HOURS}), t * 1000000000 + n), {HOURS}) AS e FROM k WHERE state = 'uncertain' GROUP BY ws, k),
a AS (SELECT ws, 0 AS s, {HOURS} AS e, 'presence_unresolved' AS reason, 0 AS o FROM e WHERE lo IS NULL UNION ALL SELECT ws, 0, lo, 'unobserved_prefix', 0 FROM e WHERE lo > 0 UNION ALL SELECT ws, hi, {HOURS}, 'unobserved_suffix', 1 FROM e WHERE hi < {HOURS}
  UNION ALL SELECT u.ws, s, u.e, 'presence_unresolved', k + 2 FROM u JOIN e ON e.ws = u.ws WHERE lo IS NOT NULL AND s < u.e)"""


@query("uncertain_intervals", f'WITH {UNSURE} SELECT ws, s AS "start", e AS "end", arg_max(reason, o) AS reason FROM a GROUP BY ws, s, e UNION ALL SELECT n_nationkey, 0, {HOURS}, \'no_presence_observations\' FROM nation WHERE n_nationkey NOT IN (SELECT ws FROM sm)')
def uncertain_intervals(spark, d):
    """a nation is a workspace, and some have no samples."""
    return series.uncertainty(samples(spark, d), HOURS, nations(spark, d))


@query("follow_ups", f"WITH {UNSURE} SELECT ws, CAST(t AS DOUBLE) AS t FROM sm WHERE state = 'uncertain' UNION SELECT ws, lo / 2 FROM e WHERE lo > 0 UNION SELECT ws, (hi + {HOURS}) / 2 FROM e WHERE hi < {HOURS} UNION SELECT n_nationkey, (i + 0.5) * {HOURS} / 4 FROM nation, range(4) r(i) WHERE n_nationkey NOT IN (SELECT ws FROM sm)")
def follow_ups(spark, d):
    """F13."""
    return series.follow_ups(samples(spark, d), HOURS, nations(spark, d))


# -- boundaries and series

ALIGN = f"""{TURNS}{WORD_SQL}, pt AS (SELECT ws, id AS p, start_ms + 200 * (id % 5) + 100 AS t, -60 + (start_ms % 97) / 2 AS rb, -60 + (end_ms % 89) / 2 AS ra FROM seg),
al AS (SELECT pt.*, (SELECT word FROM word w WHERE w.ws = pt.ws AND w.start_ms < pt.t AND pt.t < w.end_ms) AS in_word, (SELECT max(end_ms) FROM word w WHERE w.ws = pt.ws AND w.end_ms <= pt.t) AS prev_end, (SELECT min(start_ms) FROM word w WHERE w.ws = pt.ws AND w.start_ms >= pt.t) AS next_start FROM pt),
a2 AS (SELECT *, CASE WHEN in_word IS NULL THEN next_start - prev_end END AS gap, CASE WHEN in_word IS NULL THEN t - prev_end END AS tail_gap FROM al)"""


@query("boundary_flags", f"""WITH {ALIGN} SELECT ws, p, t, in_word, prev_end, next_start, gap, tail_gap, concat_ws(',', CASE WHEN abs(round(rb - ra, 2)) > 12 THEN 'loud_step' END, CASE WHEN tail_gap < 120 AND gap >= 300 THEN 'tight_tail' END, CASE WHEN in_word IS NOT NULL THEN 'word_interior' END) AS flags FROM a2""")
def boundary_flags(spark, d):
    """D06, F11."""
    seg = fx.turns(spark, d)
    at = seg.select("ws", F.col("id").alias("p"), (F.col("start_ms") + 200 * (F.col("id") % 5) + 100).alias("t"), (F.col("start_ms") % 97 / 2 - 60).alias("rms_before"), (F.col("end_ms") % 89 / 2 - 60).alias("rms_after"))
    out = series.boundary_flags(series.aligned(at, tr.words(seg)))
    return out.select("ws", "p", "t", "in_word", "prev_end", "next_start", "gap", "tail_gap", "flags")


@query("join_reports", f"""WITH {CUT}, j AS (SELECT *, lead("start") OVER w AS to_t, -60.0 + (start_s_ * 7 % 50) AS ro, lead(-60.0 + (start_s_ * 11 % 50)) OVER w AS ri, (start_s_ % 100) / 100.0 AS lk, lead((start_s_ % 100) / 100.0) OVER w AS lk2 FROM (SELECT *, "start" // 1000 AS start_s_ FROM ct) x WINDOW w AS (PARTITION BY seq ORDER BY ord)),
r AS (SELECT seq, ord, "end" AS from_t, to_t, round(abs(ro - ri), 2) AS step_db, round(1 - abs(lk::DOUBLE - lk2::DOUBLE), 4) AS alike FROM j WHERE to_t IS NOT NULL)
SELECT *, concat_ws(',', CASE WHEN alike > 0.75 AND to_t - from_t > 40 THEN 'jump_cut_risk' END, CASE WHEN step_db > 12 THEN 'loud_join' END) AS flags FROM r""")
def join_reports(spark, d):
    """F10."""
    c = fx.cuts(spark, d)
    s = F.col("start_s")
    c = c.select("seq", "ord", (s * 1000).alias("start"), ((s + F.col("length_s")) * 1000).alias("end"), (-60.0 + s * 7 % 50).alias("rms_out"), (-60.0 + s * 11 % 50).alias("rms_in"), (s % 100 / 100.0).alias("look"))
    return series.join_reports(c, 40)


SIG = "sig AS (SELECT event_type AS ws, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, value FROM events), sg AS (SELECT *, i * 40 AS t_ms FROM sig)"


def motions(spark, d):
    s = fx.signals(spark, d).select("ws", "i", "t_ms", F.round(F.col("value") * 100).cast("long").alias("v"), F.explode(F.array(*map(F.lit, range(3)))).alias("roi"))
    return s.select("ws", "t_ms", F.col("roi").cast("long").alias("roi"), ((F.floor(F.col("i") / 3) * (7 + F.col("roi") * 13) + F.col("v") % 2) % 100).alias("amount"))


@query("speaker_runs", f"""WITH {SIG}, m AS (SELECT ws, t_ms, roi, (i // 3 * (7 + roi * 13) + CAST(round(value * 100) AS BIGINT) % 2) % 100 AS amount FROM sg, range(3) r(roi)),
top AS (SELECT ws, t_ms, CAST(roi AS BIGINT) AS roi FROM (SELECT *, row_number() OVER (PARTITION BY ws, t_ms ORDER BY amount DESC, roi) AS rn FROM m) x WHERE rn = 1),
a AS (SELECT *, CASE WHEN lag(roi) OVER (PARTITION BY ws ORDER BY t_ms) = roi THEN 0 ELSE 1 END AS nw FROM top), b AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS k FROM a),
r AS (SELECT ws, k, min(t_ms) AS s, max(t_ms) AS e, any_value(roi) AS roi FROM b GROUP BY ws, k), c AS (SELECT *, sum(CASE WHEN k = 1 OR e - s >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY ws ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM r),
h AS (SELECT ws, g, min(s) AS s, max(e) AS e, arg_min(roi, k) AS roi FROM c GROUP BY ws, g), h2 AS (SELECT *, CASE WHEN lag(roi) OVER (PARTITION BY ws ORDER BY g) = roi THEN 0 ELSE 1 END AS nw FROM h),
h3 AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY g ROWS UNBOUNDED PRECEDING) AS rr FROM h2) SELECT ws, min(s) AS start_ms, max(e) AS end_ms, arg_min(roi, g) AS roi FROM h3 GROUP BY ws, rr""")
def speaker_runs(spark, d):
    """F15."""
    return series.speaker_runs(motions(spark, d), 100)


@query("caption_runs", f"""WITH {SIG}, l AS (SELECT ws, t_ms, CASE WHEN i % 5 = 4 THEN '' ELSE 'c' || (i // 12 % 3) END AS text FROM sg), a AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY ws ORDER BY t_ms) = text THEN 0 ELSE 1 END AS nw FROM l WHERE text <> ''),
b AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT ws, text, min(t_ms) AS start_ms, max(t_ms) + 40 AS end_ms, count(*) AS n FROM b GROUP BY ws, k, text""")
def caption_runs(spark, d):
    """F06."""
    s = fx.signals(spark, d)
    text = F.when(F.col("i") % 5 == 4, "").otherwise(F.concat(F.lit("c"), (F.floor(F.col("i") / 12) % 3).cast("string")))
    return series.caption_runs(s.select("ws", "t_ms", text.alias("text")), 40)


@query("excluded_bands", f"""WITH {CUT}, c AS (SELECT seq % 50 AS grp, greatest("start", 0) AS s, least("end", 600000) AS e FROM ct WHERE seq % 13 < 4), c2 AS (SELECT * FROM c WHERE s < e),
m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM c2) SELECT grp, p AS gap_start, s AS gap_end FROM m WHERE s - p > 0 UNION ALL SELECT grp, max(e), 600000 FROM c2 GROUP BY grp HAVING max(e) < 600000""")
def excluded_bands(spark, d):
    """sources of which some sequences are cut."""
    c = fx.cuts(spark, d).where("seq % 13 < 4").select((F.col("seq") % 50).alias("grp"), (F.col("start_s") * 1000).alias("s"), ((F.col("start_s") + F.col("length_s")) * 1000).alias("e"))
    return series.excluded(c, ["grp"], "s", "e", 600_000)


@query("sharpest_frames", f"""WITH {SIG}, t AS (SELECT ws, i AS "at" FROM sg WHERE i % 10 = 0), n AS (SELECT t.ws, "at", i, t_ms, floor(value / 10) AS score FROM t JOIN sg ON sg.ws = t.ws AND i BETWEEN "at" - 5 AND "at" + 5)
SELECT ws, "at", t_ms, score FROM (SELECT *, row_number() OVER (PARTITION BY ws, "at" ORDER BY score DESC, abs(i - "at"), t_ms) AS rn FROM n) x WHERE rn = 1""")
def sharpest_frames(spark, d):
    """F18."""
    s = fx.signals(spark, d)
    return series.sharpest(s.where("i % 10 = 0").select("ws", "i"), s.select("ws", "i", "t_ms", F.floor(F.col("value") / 10).cast("double").alias("score")), 5)


@query("end_cards", f"""WITH {SIG}, f AS (SELECT ws, t_ms, value % 40 AS luma, (i % 7) / 7.0 AS look FROM sg), l AS (SELECT *, round(1 - abs(look::DOUBLE - lag(look::DOUBLE) OVER w), 4) AS a, round(1 - abs(look::DOUBLE - lead(look::DOUBLE) OVER w), 4) AS b FROM f WHERE luma >= 16 WINDOW w AS (PARTITION BY ws ORDER BY t_ms)),
k AS (SELECT *, greatest(a, b) AS alike FROM l) SELECT ws, t_ms, alike FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY coalesce(alike, -1) DESC, t_ms DESC) AS rn FROM k) x WHERE rn = 1""")
def end_cards(spark, d):
    """F19."""
    s = fx.signals(spark, d)
    return series.end_card(s.select("ws", "t_ms", (F.col("value") % 40).alias("luma"), (F.col("i") % 7 / 7.0).alias("look")))


@query("inherited_evidence", f"""WITH {LOG}, h AS (SELECT ws, id, line_no, line_no % 3 = 1 AS has, CASE WHEN line_no % 2 = 0 THEN '' ELSE 'e' || line_no END AS ev FROM acc),
k AS (SELECT *, sum(CASE WHEN has THEN 1 ELSE 0 END) OVER (PARTITION BY ws, id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS k FROM h) SELECT ws, id, line_no, CASE WHEN k > 0 THEN first(ev) OVER (PARTITION BY ws, id, k ORDER BY line_no) END AS evidence FROM k""")
def inherited_evidence(spark, d):
    """a row without the field inherits it, an empty one clears it."""
    ok = ledger.guarded(ledger.validated(fx.ledger(spark, d), DURATION).where("code is null")).where("accepted")
    has = ok.select("ws", "id", "line_no", (F.col("line_no") % 3 == 1).alias("has"), F.when(F.col("line_no") % 2 == 0, "").otherwise(F.concat(F.lit("e"), F.col("line_no").cast("string"))).alias("evidence"))
    return series.inherited(has).select("ws", "id", "line_no", "evidence")


@query("strip_windows", """WITH m AS (SELECT s_suppkey AS ws, CAST(s_suppkey % 20 AS DOUBLE) AS s, round(s_suppkey % 20 + abs(s_acctbal) / 10, 3) AS e FROM supplier), k AS (SELECT *, CAST(ceil((e - s) / 112) AS BIGINT) AS k FROM m WHERE e > s), w AS (SELECT *, (e - s) / k AS w, unnest(range(k)) AS i FROM k)
SELECT ws, i, round(s + i * w, 3) AS from_s, round(s + (i + 1) * w, 3) AS to_s, CAST(least(16, greatest(1, ceil(w / 7))) AS BIGINT) AS cells FROM w""")
def strip_windows(spark, d):
    """F23."""
    s = fx.table(spark, d, "supplier")
    m = s.select(F.col("s_suppkey").alias("ws"), (F.col("s_suppkey") % 20).cast("double").alias("start"), F.round(F.col("s_suppkey") % 20 + F.abs("s_acctbal") / 10, 3).alias("end"))
    return series.strip_windows(m).drop("middles")


@query("cell_middles", """WITH m AS (SELECT o_orderkey AS id, CAST(o_custkey % 50 AS DOUBLE) AS s, CAST(o_custkey % 50 + 1 + o_orderkey % 97 AS DOUBLE) AS e, 1 + o_orderkey % 16 AS n FROM orders) SELECT id, i, round(s + (i + 0.5::DOUBLE) * (e - s) / n, 6) AS middle FROM (SELECT *, unnest(range(n)) AS i FROM m) x""")
def cell_middles(spark, d):
    """F24."""
    o = fx.table(spark, d, "orders")
    m = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).cast("double").alias("s"), (F.col("o_custkey") % 50 + 1 + F.col("o_orderkey") % 97).cast("double").alias("e"), (1 + F.col("o_orderkey") % 16).alias("n"))
    return m.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("id", "i", F.round(F.col("s") + (F.col("i") + 0.5) * (F.col("e") - F.col("s")) / F.col("n"), 6).alias("middle"))


@query("colour_check", f"""WITH {SIG}, s AS (SELECT ws, t_ms + 13 AS t_ms FROM sg WHERE i % 25 = 0), c AS (SELECT ws, t_ms * 3 AS t, value / 500 AS d FROM sg WHERE i % 3 = 0) SELECT s.ws, s.t_ms, round(coalesce(max(d), 0), 3) AS color, coalesce(max(d), 0) >= 0.5 AS confirmed FROM s LEFT JOIN c ON c.ws = s.ws AND abs(c.t - s.t_ms) <= 750 GROUP BY s.ws, s.t_ms""")
def colour_check(spark, d):
    """D04."""
    s = fx.signals(spark, d)
    scenes = s.where("i % 25 = 0").select("ws", (F.col("t_ms") + 13).alias("t_ms"))
    return series.colour_check(scenes, s.where("i % 3 = 0").select("ws", (F.col("t_ms") * 3).alias("t_ms"), (F.col("value") / 500).alias("d")), 750, 0.5)


@query("nearest_beats", f"""WITH {CUT}, p AS (SELECT seq, ord, seq % 10 AS grp, sum(len) OVER (PARTITION BY seq ORDER BY ord) * 1000 + (seq % 7) * 90 AS t FROM ct), b AS (SELECT s.s AS grp, k * 700 + (k * (s.s + 3) % 5) * 60 AS beat FROM range(10) s(s), range(600) r(k)),
n AS (SELECT p.seq, p.ord, p.t, (SELECT max(beat) FROM b WHERE b.grp = p.grp AND beat <= t) AS lo, (SELECT min(beat) FROM b WHERE b.grp = p.grp AND beat >= t) AS hi FROM p) SELECT seq, ord, CAST(t AS BIGINT) AS t, CASE WHEN hi IS NULL OR t - lo <= hi - t THEN lo ELSE hi END AS beat FROM n""")
def nearest_beats(spark, d):
    """Joins and an uneven beat grid."""
    order = W.partitionBy("seq").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    c = fx.cuts(spark, d)
    p = c.select("seq", "ord", (F.col("seq") % 10).alias("grp"), (F.sum("length_s").over(order) * 1000 + F.col("seq") % 7 * 90).alias("t"))
    b = spark.range(6000).select((F.col("id") % 10).alias("grp"), F.floor(F.col("id") / 10).alias("k"))
    b = b.select("grp", (F.col("k") * 700 + F.col("k") * (F.col("grp") + 3) % 5 * 60).alias("beat"))
    return series.nearest_beats(p, b, ["grp"]).select("seq", "ord", "t", "beat")


@query("speech_coverage", f"""WITH {TURNS}, sp AS (SELECT ws, sum(end_ms - start_ms) AS spoken FROM seg WHERE id % 3 = 0 GROUP BY ws), h AS (SELECT ws, sum(end_ms - start_ms) AS speech, sum(greatest(0, least(end_ms, 40000 + ws * 100) - start_ms)) AS pre FROM seg GROUP BY ws)
SELECT h.ws, CAST(coalesce(spoken, 0) AS BIGINT) AS spoken_ms, CAST(speech AS BIGINT) AS speech_ms, CAST(pre AS BIGINT) AS prefix_ms, speech >= 60000 AND coalesce(spoken, 0) / speech < 0.5 AS collapsed, pre <= 0 OR coalesce(spoken, 0) / pre >= 0.5 AS prefix_intact FROM h LEFT JOIN sp ON sp.ws = h.ws""")
def speech_coverage(spark, d):
    """E25, D14."""
    seg = fx.turns(spark, d)
    stall = seg.select("ws").distinct().withColumn("stall", 40_000 + F.col("ws") * 100)
    return series.speech_coverage(seg.where("id % 3 = 0"), seg.select("ws", "start_ms", "end_ms"), stall)


@query("repetition_ratio", """WITH t AS (SELECT doc_id AS id, source AS ws, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT ws, id, len(w) AS n, unnest(w) AS x FROM t), c AS (SELECT ws, id, n, x, count(*) AS c FROM e GROUP BY ALL)
SELECT ws, id, CASE WHEN max(n) >= 12 THEN round(max(c / n), 6) ELSE 0.0 END AS ratio FROM c GROUP BY ws, id""")
def repetition_ratio(spark, d):
    """E27."""
    t = fx.table(spark, d, "documents").where("text is not null").select(F.col("source").alias("ws"), F.col("doc_id").alias("id"), "text")
    return series.repetition(t)


@query("words_in_segments", f"""WITH {TURNS}{WORD_SQL} SELECT s.ws, s.id, count(*) AS n_words, min(w.start_ms) AS first_ms, max(w.end_ms) AS last_ms FROM (SELECT ws, id, start_ms + 395 AS a, end_ms - 405 AS b FROM seg) s JOIN word w ON w.ws = s.ws AND w.start_ms >= a - 10 AND w.end_ms <= b + 10 GROUP BY s.ws, s.id""")
def words_in_segments(spark, d):
    """D13."""
    seg = fx.turns(spark, d)
    inner = seg.withColumns({"start_ms": F.col("start_ms") + 395, "end_ms": F.col("end_ms") - 405}).where("start_ms - 10 <= end_ms + 10")
    return series.words_in(inner, tr.words(seg))


@query("loudness_windows", f"WITH {SIG} SELECT ws, t_ms // 500 * 500 AS window_ms, count(*) AS n, CAST(sum(CAST(round(value * value * 100) AS BIGINT)) AS BIGINT) AS energy FROM sg GROUP BY 1, 2")
def loudness_windows(spark, d):
    """S06."""
    return series.tumbling(fx.signals(spark, d), 500)


@query("presence_checkpoints", """WITH j AS (SELECT event_id AS id, CAST(event_id % 700 AS DOUBLE) / 10 AS t, CASE event_type WHEN 'view' THEN 'present' WHEN 'click' THEN 'absent' ELSE 'uncertain' END AS state FROM events), o AS (SELECT *, greatest(0.0, t - 0.5) AS "start", least(60.0, t + 0.5) AS "end", CASE WHEN state = 'uncertain' THEN 'hypothesized' ELSE 'verified' END AS status FROM j)
SELECT status, state, count(*) AS n, round(sum("end" - "start"), 3) AS seconds FROM o WHERE "start" <= t AND t < "end" GROUP BY ALL""")
def presence_checkpoints(spark, d):
    """L04."""
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "present").when(F.col("event_type") == "click", "absent").otherwise("uncertain")
    j = e.select(F.col("event_id").alias("id"), ((F.col("event_id") % 700).cast("double") / 10).alias("t"), kind.alias("state"))
    return audit.presence(j, 60.0).groupBy("status", "state").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))
