"""Registered queries of the hand-off formats, evidence checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import evidence, exports
from ..sources import fixtures as fx
from .registry import CUTS, LOG, TURNS, query, state

#: Rate of the registered hand-offs: 30000/1001 frames a second.
NUM, DEN = 30000, 1001


def _even(a: str, b: int) -> str:
    return f"(({a}) // {b} + CASE WHEN (({a}) % {b}) * 2 > {b} OR ((({a}) % {b}) * 2 = {b} AND (({a}) // {b}) % 2 = 1) THEN 1 ELSE 0 END)"


def _frames(ms: str, num: int = NUM, den: int = DEN) -> str:
    return _even(f"({ms}) * {num}", 1000 * den)


def _timecode(ms: str) -> str:
    f = _frames(ms)
    return f"printf('%02d:%02d:%02d:%02d', {f} // 108000, ({f} // 1800) % 60, ({f} // 30) % 60, {f} % 30)"


def _clock(ms: str, mark: str = ".") -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def cuts(spark, d):
    c = fx.cuts(spark, d)
    ids, signals = F.array(F.concat(F.lit("c"), F.col("start_s").cast("string"))), F.when(F.col("ord") % 2 == 0, F.array(F.lit("beat")))
    return c.select(
        "seq", "ord", (F.col("start_s") * 1000 + 33 * F.col("ord")).alias("start_ms"), (F.col("length_s") * 1000 + 17).alias("length_ms"),
        exports.note(F.concat(F.lit("cut <"), F.col("ord").cast("string"), F.lit(">\nmore")), ids, signals).alias("note"), F.concat_ws("-", "seq", "ord").alias("name"), F.lit("cut").alias("status"),
    )


HC = f"""{CUTS}, hc AS (SELECT seq, ord, start_s * 1000 + 33 * ord AS start_ms, length_s * 1000 + 17 AS length_ms, 'cut <' || ord || '> | grounding: checkpoint:c' || start_s || CASE WHEN ord % 2 = 0 THEN ', signal:beat' ELSE '' END AS note, seq || '-' || ord AS name FROM cut),
pl AS (SELECT *, CAST(sum(length_ms) OVER (PARTITION BY seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - length_ms AS record_ms FROM hc),
edl AS (SELECT seq, ord, printf('%03d', ord) || '  AX       V     C        ' || {_timecode('start_ms')} || ' ' || {_timecode('start_ms + length_ms')} || ' ' || {_timecode('record_ms')} || ' ' || {_timecode('record_ms + length_ms')}
  || chr(10) || '* FROM CLIP NAME: clip.mp4' || chr(10) || '* COMMENT: ' || note || chr(10) AS block FROM pl)"""


@query("edl_blocks", f"WITH {HC} SELECT * FROM edl")
def edl_blocks(spark, d):
    """B01."""
    return exports.edl(cuts(spark, d), "clip.mp4", NUM, DEN)


@query("edl_receipts", f"WITH {HC} SELECT seq, 'edl' AS format, sha256('TITLE: clip' || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY ord)) AS artifact_sha256, count(*) AS checkpoints FROM edl GROUP BY seq")
def edl_receipts(spark, d):
    """B01 with B06: digest of each sequence's whole document."""
    c = cuts(spark, d)
    text = exports.document(exports.edl(c, "clip.mp4", NUM, DEN), "seq", "ord", "TITLE: clip\nFCM: NON-DROP FRAME\n\n")
    shown = c.select("seq", F.col("name").alias("id"), "status", F.lit(None).cast("double").alias("confidence"))
    return exports.receipts(text, "seq", shown, "edl").withColumn("checkpoints", F.size("checkpoints").cast("long"))


def _rational(c: str) -> str:
    return f"({_frames(c)} * {DEN} || '/{NUM}s')"


_QUOTED = """replace(replace(replace(note, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"""


@query("fcpxml_clips", f"""WITH {HC} SELECT seq, ord, '<asset-clip ref="r2" offset="' || {_rational('record_ms')} || '" start="' || {_rational('start_ms')} || '" duration="' || {_rational('length_ms')} || '" name="' || name || '" format="r1"><marker start="'
|| {_rational('start_ms')} || '" duration="' || {_rational('length_ms')} || '" value="' || name || ' [cut]" note="' || {_QUOTED} || '"/></asset-clip>' AS block FROM pl""")
def fcpxml_clips(spark, d):
    """B03."""
    return exports.fcpxml(cuts(spark, d), NUM, DEN)


def _otio_time(c: str) -> str:
    return """'{"OTIO_SCHEMA":"RationalTime.1","rate":25.0,"value":' || CAST(CAST(""" + _frames(c, 25, 1) + """ AS DOUBLE) AS VARCHAR) || '}'"""


@query("otio_clips", f"""WITH {HC} SELECT seq, ord, '{{"OTIO_SCHEMA":"Clip.2","name":"' || name || '","source_range":{{"OTIO_SCHEMA":"TimeRange.1","start_time":' || {_otio_time('start_ms')} || ',"duration":' || {_otio_time('length_ms')} || '}},"metadata":{{"status":"cut","note":"' || note || '"}}}}' AS block FROM pl""")
def otio_clips(spark, d):
    """B04."""
    return exports.otio(cuts(spark, d), 25, 1)


@query("xmeml_markers", f"""WITH {LOG} SELECT ws, id, '  <marker>' || chr(10) || '   <name>' || id || ' [' || status || ']</name>' || chr(10) || '   <comment>a &lt; b</comment>' || chr(10) || '   <in>' || {_frames('start_us // 1000')} || '</in>' || chr(10)
|| '   <out>' || {_frames('end_us // 1000')} || '</out>' || chr(10) || '  </marker>' AS block FROM latest""")
def xmeml_markers(spark, d):
    """B02."""
    s = state(spark, d).select("ws", "id", "status", fn.div(F.col("start_us"), 1000).alias("start_ms"), fn.div(F.col("end_us"), 1000).alias("end_ms"), F.lit(" a < b").alias("comment"))
    return exports.xmeml(s, NUM, DEN)


@query("srt_cues", f"""WITH {TURNS}, r AS (SELECT ws, id, start_ms, end_ms, text FROM seg WHERE speaker = 'user' UNION ALL SELECT ws, id, start_ms, end_ms, text FROM seg WHERE speaker <> 'user' AND NOT EXISTS (SELECT 1 FROM seg s WHERE s.ws = seg.ws AND s.speaker = 'user' AND trim(s.text, e' \\t\\n\\r') <> '')),
o AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY id) AS ord FROM r WHERE trim(text, e' \\t\\n\\r') <> '')
SELECT ws, ord, ord || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || trim(text, e' \\t\\n\\r') || chr(10) AS block FROM o""")
def srt_cues(spark, d):
    """Speech is the user's turns; where a workspace has none, the others' turns fill in."""
    t = fx.turns(spark, d)
    return exports.srt(t.where("speaker = 'user'"), t.where("speaker <> 'user'"))


@query("clock_forms", f"""WITH {TURNS}, m AS (SELECT ws, id, start_ms * 7 + 13 AS ms FROM seg), ff AS (SELECT *, {_clock('ms')} AS full_form FROM m), k AS (SELECT *, CASE WHEN ms < 3600000 THEN full_form[4:] ELSE ms // 3600000 || ':' || full_form[4:] END AS compact FROM ff)
SELECT ws, id, full_form, compact, regexp_replace(compact, '\\.000$', '') AS label, printf('t%09d.jpg', ms) AS frame, {_timecode('ms')} AS timecode, ms AS parsed FROM k""")
def clock_forms(spark, d):
    """An instant in every form, and read back."""
    ms = F.col("ms")
    t = fx.turns(spark, d).select("ws", "id", (F.col("start_ms") * 7 + 13).alias("ms"))
    return t.select("ws", "id", fn.clock(ms).alias("full_form"), fn.clock_compact(ms).alias("compact"), fn.clock_label(ms).alias("label"), fn.frame_name(ms).alias("frame"), fn.timecode(ms, NUM, DEN).alias("timecode"), fn.parse_clock(fn.clock(ms)).alias("parsed"))


def _slug_sql(c: str) -> str:
    for x in fn.RESERVED:
        c = f"replace({c}, chr({ord(x)}), '%{ord(x):02X}')"
    return c


@query("slugs", f"""WITH s AS (SELECT page_id, url, trim({_slug_sql('url')}) AS s, trim(regexp_replace(url, '[^0-9A-Za-z가-힣-]+', '-', 'g'), '-') AS r FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE WHEN s = '' THEN '_' WHEN length(s) > 80 THEN left(s, 71) || '-' || left(sha256(url), 8) ELSE s END AS slug, CASE WHEN r = '' THEN '' ELSE '-' || rtrim(left(r, 40), '-') END AS reason FROM s""")
def slugs(spark, d):
    """J19, J20."""
    p = fx.table(spark, d, "pages").where("url is not null")
    return p.select("page_id", fn.slug(F.col("url")).alias("slug"), fn.reason_slug(F.col("url")).alias("reason"))


def _size_sql(n: str) -> str:
    out = f"CASE WHEN {n} < 1024 THEN {n} || 'B'"
    for k, unit in enumerate(fn.UNITS[1:], 1):
        t = _even(f"{n} * 10", 1024**k)
        out += f" {'ELSE' if k == 4 else f'WHEN {n} < {1024 ** (k + 1)} THEN'} {t} // 10 || '.' || {t} % 10 || '{unit}'"
    return out + " END"


@query("human_sizes", f"WITH b AS (SELECT o_orderkey, (o_orderkey * o_orderkey * o_custkey) % 5000000000000 AS n FROM orders) SELECT o_orderkey, {_size_sql('n')} AS size FROM b")
def human_sizes(spark, d):
    """K08."""
    most = 5_000_000_000_000
    part = lambda c: (c % most).cast("decimal(13,0)")  # noqa: E731  # the product of two has 26 digits; that of the keys themselves soon no longer fits a long
    k, c = part(F.col("o_orderkey")), part(F.col("o_custkey"))
    return fx.table(spark, d, "orders").select("o_orderkey", fn.human_size((part(k * k) * c % most).cast("long")).alias("size"))


_PARTS = "[" + ", ".join(f"'{p}'" for p in fn.PARTICLES) + "]"
_STEM = "CASE " + " ".join(f"WHEN ends_with(token, '{p}') AND length(token) >= {len(p) + 2} THEN left(token, length(token) - {len(p)})" for p in fn.PARTICLES) + " ELSE token END"


@query("stems", f"""WITH t AS (SELECT p_partkey, ['가', '나다', '서울', '사람'][p_partkey % 4 + 1] || CASE WHEN p_partkey % 5 = 0 THEN '합니다' ELSE {_PARTS}[p_partkey % {len(fn.PARTICLES)} + 1] END AS token FROM part)
SELECT p_partkey, token, {_STEM} AS stem, regexp_matches(token, '({'|'.join(fn.VERB_ENDINGS)})$') AS verb FROM t""")
def stems(spark, d):
    """J03, J04."""
    k = F.col("p_partkey")
    token = F.concat(F.get(F.array(*map(F.lit, ("가", "나다", "서울", "사람"))), k % 4), F.when(k % 5 == 0, "합니다").otherwise(F.get(F.array(*map(F.lit, fn.PARTICLES)), k % len(fn.PARTICLES))))
    t = fx.table(spark, d, "part").select("p_partkey", token.alias("token"))
    return t.select("p_partkey", "token", fn.stem(F.col("token")).alias("stem"), fn.verb_form(F.col("token")).alias("verb"))


@query("segment_support", f"""WITH {TURNS}, ck AS (SELECT ws, id, start_ms + 700 AS s, end_ms + 700 AS e, unnest([id, id + 1]) AS ref FROM seg), h AS (SELECT ck.ws, ck.id, ck.ref, coalesce(max(CAST(seg.id IS NOT NULL AND greatest(s, start_ms) < least(e, end_ms) AS INT)), 0) AS ok FROM ck LEFT JOIN seg ON seg.ws = ck.ws AND seg.id = ck.ref GROUP BY ALL)
SELECT ws, id, min(ok) = 1 AS supported, count(*) AS declared FROM h GROUP BY ws, id""")
def segment_support(spark, d):
    """Each turn as a checkpoint, shifted by 0.7 s, that declares itself and the next turn."""
    t = fx.turns(spark, d)
    ck = t.select("ws", "id", (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"), F.array("id", F.col("id") + 1).alias("refs"))
    return evidence.segment_support(ck, t.select("ws", F.col("id").alias("ref"), "start_ms", "end_ms"))


_IMAGES = """im AS (SELECT event_id, event_type <> 'view' AS tracked, event_type = 'click' AS film, CASE WHEN value < 20 THEN [event_id % 100, event_id % 70] END AS ts, CASE WHEN value < 60 THEN event_id % 90 END AS t, CASE WHEN value < 120 THEN event_id % 50 END AS s0, user_id % 40 AS c0 FROM events),
ok AS (SELECT *, CASE WHEN ts IS NOT NULL THEN len(list_filter(ts, lambda x: c0 <= x AND x < c0 + 30)) > 0 WHEN t IS NOT NULL THEN c0 <= t AND t < c0 + 30 WHEN s0 IS NOT NULL THEN greatest(s0, c0) < least(s0 + 10, c0 + 30) END AS inside FROM im)"""


def images(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    k, v = F.col("event_id"), F.col("value")
    return e.select(
        "event_id", (F.col("event_type") != "view").alias("tracked"), F.when(F.col("event_type") == "click", "filmstrip").otherwise("frame").alias("kind"), F.when(v < 20, F.array(k % 100, k % 70)).alias("timestamps"), F.when(v < 60, k % 90).alias("t"),
        F.when(v < 120, k % 50).alias("span_start"), F.when(v < 120, k % 50 + 10).alias("span_end"), (F.col("user_id") % 40).alias("start"), (F.col("user_id") % 40 + 30).alias("end"),
    )


@query("image_issues", f"WITH {_IMAGES} SELECT event_id, concat_ws(',', CASE WHEN NOT tracked THEN 'evidence_provenance_missing' END, CASE WHEN film THEN 'evidence_role_not_verification' END, CASE WHEN inside IS NULL THEN 'evidence_time_unavailable' WHEN NOT inside THEN 'evidence_outside_checkpoint' END) AS issues FROM ok")
def image_issues(spark, d):
    """C17."""
    return evidence.image_issues(images(spark, d)).select("event_id", F.concat_ws(",", "issues").alias("issues"))


@query("visual_support", f"WITH {_IMAGES} SELECT event_id % 7 AS ws, event_id AS id, tracked AND NOT film AND coalesce(inside, false) AND event_id % 3 > 0 AS supported FROM ok")
def visual_support(spark, d):
    """Each event refers to its image and to one that doesn't exist; two images in three can be decoded."""
    m = images(spark, d).withColumns({"ws": F.col("event_id") % 7, "path": F.concat(F.lit("frames/"), F.col("event_id").cast("string")), "decodable": F.col("event_id") % 3 > 0})
    ck = m.select("ws", F.col("event_id").alias("id"), "start", "end", F.array("path", F.concat("path", F.lit("x"))).alias("paths"))
    return evidence.visual_support(ck, m)


@query("sequence_forward", """WITH l AS (SELECT o_custkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS r FROM orders)
SELECT seq, line_no, r >= coalesce(max(r) OVER (PARTITION BY seq ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM l""")
def sequence_forward(spark, d):
    """C06."""
    from pyspark.sql import Window as W

    status = F.when(F.col("o_orderstatus") == "O", "assembled").when(F.col("o_orderstatus") == "P", "boundary_verified").otherwise("exported")
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("line_no"), status.alias("status"))
    return evidence.forward_only(o).drop("status")


@query("sequence_codes", f"""WITH {CUTS}, c AS (SELECT seq, ord, ord // 2 AS place, start_s, start_s + length_s - 2 AS e, start_s % 5 AS k FROM cut)
SELECT seq, ord, CASE WHEN start_s >= e THEN 'span' WHEN count(*) OVER (PARTITION BY seq, place) > 1 THEN 'order' WHEN k = 0 THEN 'grounding' WHEN k > 2 THEN 'unknown_checkpoint' END AS code FROM c""")
def sequence_codes(spark, d):
    """Places are shared by two cuts, checkpoints above 2 unknown, none for 0."""
    k = F.col("start_s") % 5
    c = fx.cuts(spark, d).select("seq", F.col("ord").alias("cut"), fn.div(F.col("ord"), 2).alias("ord"), F.col("start_s").alias("start_ms"), (F.col("start_s") + F.col("length_s") - 2).alias("end_ms"), F.when(k > 0, F.array(k)).alias("checkpoint_ids"), F.lit(None).cast("array<string>").alias("signals"))
    return evidence.sequence_codes(c, spark.range(3).select("id")).select("seq", F.col("cut").alias("ord"), "code")


@query("content_modes", f"""WITH {TURNS}, g AS (SELECT *, start_ms - coalesce(max(end_ms) OVER (PARTITION BY ws ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM seg),
w AS (SELECT ws, max(end_ms) * (1 + ws % 4) AS dur, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech, count(*) AS n, greatest(max(gap), max(end_ms) * (ws % 4)) AS hole, ws % 9 AS ocr FROM g GROUP BY ws)
SELECT ws, CASE WHEN speech * 100 < dur * 35 AND ocr >= 5 AND ocr * 60000 >= 5 * dur THEN 'text_led' WHEN speech * 100 >= dur * 35 AND hole >= 120000 THEN CASE WHEN ws % 2 = 0 THEN 'mixed_unsure' ELSE 'mixed' END
  WHEN speech * 100 >= dur * 35 AND ocr > 0 THEN 'text_on_screen' WHEN speech * 100 < dur * 35 THEN 'visual_led' ELSE 'speech_led' END AS mode FROM w""")
def content_modes(spark, d):
    """C14: recordings stretched by one to four, with screen texts by workspace."""
    from pyspark.sql import Window as W

    before = F.max("end_ms").over(W.partitionBy("ws").orderBy("start_ms", "end_ms", "id").rowsBetween(W.unboundedPreceding, -1))
    t = fx.turns(spark, d).withColumn("gap", F.col("start_ms") - F.coalesce(before, F.lit(0)))
    w = t.groupBy("ws").agg(F.max("end_ms").alias("last"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count("*").alias("segments"), F.max("gap").alias("gap"))
    ws = F.col("ws")
    w = w.select("ws", (F.col("last") * (1 + ws % 4)).alias("duration_ms"), "speech_ms", "segments", F.greatest("gap", F.col("last") * (ws % 4)).alias("longest_gap_ms"), (ws % 9).alias("ocr"), F.lit(5).alias("scenes"), F.lit(1).alias("bursts"), F.when(ws % 2 == 0, 0.3).otherwise(0.9).alias("coverage"))
    return evidence.content_mode(w).select("ws", "mode")
