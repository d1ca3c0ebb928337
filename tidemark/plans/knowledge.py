"""Registered queries of corpus knowledge, choices and set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, selection, wiki
from ..sources import fixtures as fx
from .registry import LOG, TURNS, query, state

#: Checkpoints with tags, labels, relations and tokens, from documents and their labels.
CP = """lab AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
cp AS (SELECT d.doc_id AS id, source AS ws, lang AS mode, CASE WHEN quality IS NULL THEN 'unsupported' WHEN quality = 1 AND toxic = 0 THEN 'cross_modal' WHEN quality = 1 THEN 'visual_only' ELSE 'transcript_only' END AS level,
  ['task-' || lang, 'task-t' || (d.doc_id % 7), 'tool-' || CASE WHEN lang = 'en' THEN 't' || (d.doc_id % 3) WHEN lang = 'de' THEN 'x' ELSE source END, 'other'] AS tags,
  ['e' || (d.doc_id % 37), ' e' || (d.doc_id % 11) || ' ', 'u' || d.doc_id] AS entities, CASE WHEN d.doc_id % 6 = 0 THEN [] ELSE ['s' || (d.doc_id % 5), ''] END AS speakers, CASE WHEN d.doc_id % 3 = 0 THEN 'q' ELSE '' END AS quote,
  CASE WHEN d.doc_id % 4 = 0 THEN [{'s': 'e' || (d.doc_id % 37), 'p': 'with', 'o': 'u' || d.doc_id}] WHEN d.doc_id % 4 = 1 THEN [{'s': 'e1', 'p': '', 'o': 'e2'}] ELSE [] END AS relations,
  CASE WHEN d.doc_id % 2 = 0 THEN ['k' || (d.doc_id % 9), ' '] ELSE [] END AS tokens FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id)"""


def checkpoints(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "source")
    marks = fx.table(spark, d, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("quality"), F.any_value("toxic").alias("toxic"))
    level = F.when(F.col("quality").isNull(), "unsupported").when((F.col("quality") == 1) & (F.col("toxic") == 0), "cross_modal").when(F.col("quality") == 1, "visual_only").otherwise("transcript_only")
    n = lambda prefix, m=None: F.concat(F.lit(prefix), (F.col("doc_id") % m if m else F.col("doc_id")).cast("string"))
    tool = F.when(F.col("lang") == "en", n("t", 3)).when(F.col("lang") == "de", "x").otherwise(F.col("source"))
    triple = lambda s, p, o: F.array(F.struct(s.alias("s"), p.alias("p"), o.alias("o")))
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")
    k = F.col("doc_id") % 4
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("ws"), F.col("lang").alias("mode"), level.alias("level"),
        F.array(F.concat(F.lit("task-"), "lang"), n("task-t", 7), F.concat(F.lit("tool-"), tool), F.lit("other")).alias("tags"),
        F.array(n("e", 37), F.concat(n(" e", 11), F.lit(" ")), n("u")).alias("entities"),
        F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(n("s", 5), F.lit(""))).alias("speakers"), F.when(F.col("doc_id") % 3 == 0, "q").otherwise("").alias("quote"),
        F.when(k == 0, triple(n("e", 37), F.lit("with"), n("u"))).when(k == 1, triple(F.lit("e1"), F.lit(""), F.lit("e2"))).otherwise(none).alias("relations"),
        F.when(F.col("doc_id") % 2 == 0, F.array(n("k", 9), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("tokens"),
    )


def _labels(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({c}, lambda x: trim(x)), lambda x: x <> '')))"


VALID = "list_filter(relations, lambda r: r.s <> '' AND r.p <> '' AND r.o <> '')"


@query("relation_candidates", f"WITH {CP} SELECT ws, id, array_to_string({_labels('list_concat(entities, speakers)')}, ',') AS labels FROM cp WHERE len({VALID}) = 0 AND len({_labels('list_concat(entities, speakers)')}) >= 2")
def relation_candidates(spark, d):
    """E33, C27, J17."""
    return wiki.relation_candidates(checkpoints(spark, d))


@query("wiki_entities", f"""WITH {CP}, a AS (SELECT label, count(*) AS appearances, array_to_string(list_sort(list_distinct(list(ws))), ',') AS workspaces FROM (SELECT ws, id, unnest({_labels('list_concat(entities, speakers)')}) AS label FROM cp) x GROUP BY label),
q AS (SELECT label, count(*) AS quotes FROM (SELECT unnest({_labels('speakers')}) AS label FROM cp WHERE quote <> '') x GROUP BY label), r AS (SELECT label, count(*) AS relations FROM (SELECT unnest([r.s, r.o]) AS label FROM (SELECT unnest({VALID}) AS r FROM cp) y) x GROUP BY label),
n AS (SELECT DISTINCT 'u' || doc_id AS label FROM labels WHERE quality = 1) SELECT a.label, appearances, workspaces, coalesce(quotes, 0) AS quotes, coalesce(relations, 0) AS relations, appearances >= 2 OR q.label IS NOT NULL OR r.label IS NOT NULL OR n.label IS NOT NULL AS durable
FROM a LEFT JOIN q ON q.label = a.label LEFT JOIN r ON r.label = a.label LEFT JOIN n ON n.label = a.label""")
def wiki_entities(spark, d):
    """E17, E18, E21."""
    notes = fx.table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("label"))
    return wiki.entities(checkpoints(spark, d), notes)


@query("tag_index", f"WITH {CP} SELECT mode, tag, count(*) AS n, count(DISTINCT ws) AS workspaces FROM (SELECT ws, mode, unnest(list_distinct(tags)) AS tag FROM cp) x GROUP BY mode, tag")
def tag_index(spark, d):
    """E19."""
    return wiki.tag_index(checkpoints(spark, d))


STEP = f"""{CP}, st AS (SELECT ws, id, unnest(list_transform(list_filter(tags, lambda t: starts_with(t, 'task-')), lambda t: t[6:])) AS task, list_transform(list_filter(tags, lambda t: starts_with(t, 'tool-')), lambda t: t[6:]) AS tools, tokens, level,
  CASE WHEN level IN ('cross_modal', 'visual_only') THEN 'visual_verified' WHEN level = 'transcript_only' THEN 'speech_only' ELSE 'agent_estimated' END AS evidence FROM cp WHERE level <> 'unsupported'),
us AS (SELECT DISTINCT task, ws, unnest(tools) AS tool FROM st), tg AS (SELECT DISTINCT task, ws FROM us), sz AS (SELECT task, count(*) AS tagged FROM tg GROUP BY task),
sh AS (SELECT us.task, tool FROM us JOIN sz ON sz.task = us.task GROUP BY us.task, tool, tagged HAVING count(*) >= tagged // 2 + 1), ofd AS (SELECT task, count(*) AS n FROM tg WHERE NOT EXISTS (SELECT 1 FROM us JOIN sh ON sh.task = us.task AND sh.tool = us.tool WHERE us.task = tg.task AND us.ws = tg.ws) GROUP BY task),
co AS (SELECT sz.task, tagged, coalesce((SELECT string_agg(tool, ',' ORDER BY tool) FROM sh WHERE sh.task = sz.task), '') AS consensus, CASE WHEN NOT EXISTS (SELECT 1 FROM sh WHERE sh.task = sz.task) AND tagged < 2 THEN 0 ELSE coalesce(n, 0) END AS off_domain FROM sz LEFT JOIN ofd ON ofd.task = sz.task)"""


def steps(spark, d):
    return wiki.procedure_steps(checkpoints(spark, d))


@query("procedure_steps", f"WITH {STEP} SELECT ws, id, task, array_to_string(tools, ',') AS tools, evidence FROM st")
def procedure_steps(spark, d):
    """E07, J18."""
    return steps(spark, d).select("ws", "id", "task", F.array_join("tools", ",").alias("tools"), "evidence")


@query("tool_coherence", f"WITH {STEP} SELECT task, tagged, consensus, off_domain FROM co")
def tool_coherence(spark, d):
    """E08."""
    return wiki.coherence(steps(spark, d))


@query("procedure_maturity", f"""WITH {STEP}, m AS (SELECT task, count(DISTINCT ws) AS workspaces, count(*) AS steps, count(*) FILTER (level IN ('cross_modal', 'visual_only')) AS visual FROM st GROUP BY task)
SELECT m.task, workspaces, steps, round(visual / steps, 4) AS visual_ratio, coalesce(consensus, '') AS consensus, coalesce(off_domain, 0) AS off_domain, workspaces >= 3 AND coalesce(off_domain, 0) = 0 AS candidate, visual < 0.5 * steps AS warning,
  CASE WHEN workspaces >= 3 AND coalesce(off_domain, 0) = 0 THEN 'draft' WHEN off_domain > 0 THEN 'blocked-intent' ELSE 'needs-workspaces(' || workspaces || '/3)' END AS route FROM m LEFT JOIN co ON co.task = m.task""")
def procedure_maturity(spark, d):
    """E09, E12."""
    return wiki.maturity(steps(spark, d))


@query("unverified_tokens", f"""WITH {STEP}, r AS (SELECT task, ws, id, list_filter(tokens, lambda t: trim(t) <> '') AS k FROM st WHERE evidence = 'speech_only'), o AS (SELECT * FROM r WHERE len(k) > 0)
SELECT task, ws, id, array_to_string(k, ' ') AS tokens, (SELECT count(*) FROM o) AS step_count, CAST((SELECT sum(len(k)) FROM o) AS BIGINT) AS token_count FROM o ORDER BY task, ws, id LIMIT 20""")
def unverified_tokens(spark, d):
    """E11, G12."""
    return wiki.unverified_tokens(steps(spark, d))


@query("group_rollup", "SELECT CASE WHEN g = '' THEN '(root)' ELSE g END AS grp, count(*) AS workspaces, CAST(sum(n) AS BIGINT) AS items FROM (SELECT regexp_extract(regexp_replace(url, '^https?://[^/]*', ''), '^/?([^/?]+)', 1) AS g, page_id % 9 AS n FROM pages) x GROUP BY 1")
def group_rollup(spark, d):
    """E22."""
    p = fx.table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://[^/]*", "").alias("path"), (F.col("page_id") % 9).alias("items"))
    return wiki.group_rollup(p, "path")


@query("stale_workspaces", "WITH n AS (SELECT o_custkey % 200 AS ws, max(o_orderdate) AS newest FROM orders WHERE o_orderkey % 5 = 0 OR o_custkey % 3 > 0 GROUP BY 1) SELECT ws, newest, date_diff('day', CAST(newest AS DATE), DATE '2024-06-01') AS age_days FROM n WHERE date_diff('day', CAST(newest AS DATE), DATE '2024-06-01') > 30")
def stale_workspaces(spark, d):
    """Files are orders."""
    o = fx.table(spark, d, "orders").where("o_orderkey % 5 = 0 or o_custkey % 3 > 0").select((F.col("o_custkey") % 200).alias("ws"), F.col("o_orderdate").alias("mtime"))
    return wiki.stale_workspaces(o, F.lit("2024-06-01").cast("date"), 30)


CATALOG = "ca AS (SELECT DISTINCT user_id % 20 AS ws, user_id % 200 AS image FROM events), ix AS (SELECT DISTINCT user_id % 20 AS ws, user_id % 200 + CASE WHEN value > 480 THEN 1000 ELSE 0 END AS image FROM events WHERE event_id % 5 > 0 AND user_id % 7 > 0)"


@query("image_index_consistency", f"WITH {CATALOG}, j AS (SELECT coalesce(ca.ws, ix.ws) AS ws, ca.ws IS NOT NULL AS c, ix.ws IS NOT NULL AS i FROM ca FULL JOIN ix ON ca.ws = ix.ws AND ca.image = ix.image) SELECT ws, count(*) FILTER (c) AS catalog, count(*) FILTER (i) AS indexed, count(*) FILTER (NOT i) AS missing, count(*) FILTER (NOT c) AS orphaned, bool_or(NOT i OR NOT c) AS stale FROM j GROUP BY ws")
def image_index_consistency(spark, d):
    """E15, D11."""
    e = fx.table(spark, d, "events")
    ca = e.select((F.col("user_id") % 20).alias("ws"), (F.col("user_id") % 200).alias("image"))
    ix = e.where("event_id % 5 > 0 and user_id % 7 > 0").select((F.col("user_id") % 20).alias("ws"), (F.col("user_id") % 200 + F.when(F.col("value") > 480, 1000).otherwise(0)).alias("image"))
    return wiki.index_consistency(ca, ix)


@query("image_backlinks", f"""WITH {LOG}, im AS (SELECT DISTINCT user_id % 20 AS ws, 'i' || (user_id % 200) AS image, 'frames/' || (user_id % 200) || '.jpg' AS path FROM events), rf AS (SELECT ws, id, CASE WHEN line_no % 2 = 0 THEN 'i' || (CAST(id AS BIGINT) % 200) ELSE 'frames/' || (CAST(id AS BIGINT) % 200) || '.jpg' END AS ref FROM latest)
SELECT im.ws, image, string_agg(DISTINCT id, ',' ORDER BY id) AS checkpoints FROM im JOIN rf ON rf.ws = im.ws AND (ref = image OR ref = path) GROUP BY im.ws, image""")
def image_backlinks(spark, d):
    """D12."""
    n = (F.col("user_id") % 200).cast("string")
    im = fx.table(spark, d, "events").select((F.col("user_id") % 20).alias("ws"), F.concat(F.lit("i"), n).alias("image"), F.concat(F.lit("frames/"), n, F.lit(".jpg")).alias("path")).distinct()
    k = (F.col("id").cast("long") % 200).cast("string")
    return wiki.backlinks(im, state(spark, d).select("ws", "id", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("i"), k)).otherwise(F.concat(F.lit("frames/"), k, F.lit(".jpg"))).alias("ref")))


@query("qualified_only", """WITH t AS (SELECT source AS ws, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS token, doc_id % 3 > 0 AS qualified FROM documents WHERE text IS NOT NULL)
SELECT ws, token FROM t WHERE token NOT IN ('the', 'der', 'la') GROUP BY ws, token HAVING bool_and(qualified)""")
def qualified_only(spark, d):
    """H06."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    t = fx.table(spark, d, "documents").where("text is not null").select(F.col("source").alias("ws"), (F.col("doc_id") % 3 > 0).alias("qualified"), F.explode(words).alias("token"))
    return wiki.qualified_only(t, ["the", "der", "la"])


@query("reassigned_slugs", "WITH o AS (SELECT c_custkey AS slug, c_name AS label FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey AS slug, CASE WHEN c_custkey % 10 = 0 THEN c_name || '*' ELSE c_name END AS label FROM customer WHERE c_custkey % 4 > 0) SELECT n.slug, o.label AS was, n.label FROM n JOIN o ON o.slug = n.slug WHERE o.label <> n.label")
def reassigned_slugs(spark, d):
    """H04."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("label"))
    new = c.where("slug % 4 > 0").withColumn("label", F.when(F.col("slug") % 10 == 0, F.concat("label", F.lit("*"))).otherwise(F.col("label")))
    return wiki.reassigned(c.where("slug % 3 > 0"), new)


@query("unseen_edges", """WITH e AS (SELECT user_id || ':' || event_type AS edge_id, event_id AS seq, value FROM events), k AS (SELECT DISTINCT edge_id FROM e WHERE seq % 50 = 0), n AS (SELECT * FROM e WHERE edge_id NOT IN (SELECT edge_id FROM k))
SELECT edge_id, min(seq) AS seq, arg_min(value, seq) AS value FROM n GROUP BY edge_id""")
def unseen_edges(spark, d):
    """An append that may be repeated."""
    e = fx.table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("edge_id"), F.col("event_id").alias("seq"), "value")
    return wiki.unseen(e, e.where("seq % 50 = 0"), "edge_id")


@query("lost_ids", "SELECT 'lost' AS what, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 48) UNION ALL SELECT 'stale', p_name FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 20 EXCEPT SELECT p_name FROM part WHERE p_size >= 20)")
def lost_ids(spark, d):
    """What a rewrite lost, and files owned but no longer current."""
    p = fx.table(spark, d, "part")
    had = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    lost = had.join(fx.table(spark, d, "lineitem").where("l_quantity < 48").select(F.col("l_orderkey").alias("id")).distinct(), "id", "left_anti")
    stale = p.where("p_size < 20").select("p_name").distinct().join(p.where("p_size >= 20").select("p_name").distinct(), "p_name", "left_anti")
    return lost.select(F.lit("lost").alias("what"), F.col("id").cast("string").alias("id")).unionByName(stale.select(F.lit("stale").alias("what"), F.col("p_name").alias("id")))


EDGE = """e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


def graph(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return li.select(p.alias("src"), s.alias("dst")).union(li.select(s.alias("src"), p.alias("dst")))


@query("link_reachability", f"WITH RECURSIVE {EDGE}, r AS (SELECT 's1' AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM r")
def link_reachability(spark, d):
    """All edges, to the end."""
    return corpus.reachable(graph(spark, d), spark.range(1).select(F.lit("s1").alias("node"))).select("node")


@query("orphan_pages", f"WITH RECURSIVE {EDGE}, f AS (SELECT * FROM e WHERE src < dst AND hash_of(src) % 3 > 0), r AS (SELECT 'p1' AS node UNION SELECT f.dst FROM r JOIN f ON r.node = f.src) SELECT DISTINCT src AS node FROM e WHERE src LIKE 's%' AND src NOT IN (SELECT node FROM r)".replace("hash_of(src)", "CAST(src[2:] AS BIGINT)"))
def orphan_pages(spark, d):
    """Pages that no walk along forward edges finds."""
    e = graph(spark, d)
    forward = e.where((F.col("src") < F.col("dst")) & (F.substring("src", 2, 20).cast("long") % 3 > 0))
    found = corpus.reachable(forward, spark.range(1).select(F.lit("p1").alias("node")))
    return e.where("src like 's%'").select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti")


# -- choices


@query("caption_sidecars", """WITH f AS (SELECT c_nationkey AS ws, c_custkey AS n, c_name || CASE c_custkey % 5 WHEN 0 THEN '.ko.vtt' WHEN 1 THEN '.ko-orig.vtt' WHEN 2 THEN '.en.vtt' ELSE '.fr.vtt' END AS name FROM customer WHERE c_custkey % 5 >= c_nationkey % 5)
SELECT ws, name FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY CASE WHEN contains(name, '.ko.') THEN 0 WHEN contains(name, '.ko-orig.') THEN 1 WHEN contains(name, '.en.') THEN 2 ELSE 3 END, n) AS rn FROM f) x WHERE rn = 1""")
def caption_sidecars(spark, d):
    """A11."""
    k = F.col("c_custkey") % 5
    end = F.when(k == 0, ".ko.vtt").when(k == 1, ".ko-orig.vtt").when(k == 2, ".en.vtt").otherwise(".fr.vtt")
    c = fx.table(spark, d, "customer").where("c_custkey % 5 >= c_nationkey % 5")
    return selection.sidecar(c.select(F.col("c_nationkey").alias("ws"), F.col("c_custkey").alias("n"), F.concat("c_name", end).alias("name")))


@query("file_times", r"""WITH f AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN printf('t%09d_cab12cd34-why.jpg', event_id) WHEN 1 THEN printf('strip_%09d_%09d_n%d.jpg', event_id, event_id * 3, event_id % 16) WHEN 2 THEN printf('strip_%09d_%09d_n8_c4_v2-x.jpg', event_id, event_id * 3) ELSE printf('t%d.jpg', event_id) END AS file FROM events)
SELECT id, TRY_CAST(regexp_extract(file, '^t(\d{9})(?:_c[0-9a-f]{8})?(?:-[^.]+)?\.jpg$', 1) AS BIGINT) AS t_ms, TRY_CAST(regexp_extract(file, '^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-[^.]+)?\.jpg$', 1) AS BIGINT) AS start_ms,
  TRY_CAST(regexp_extract(file, '^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-[^.]+)?\.jpg$', 2) AS BIGINT) AS end_ms, TRY_CAST(regexp_extract(file, '^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-[^.]+)?\.jpg$', 3) AS BIGINT) AS cells,
  TRY_CAST(regexp_extract(file, '^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-[^.]+)?\.jpg$', 4) AS BIGINT) AS cols, TRY_CAST(regexp_extract(file, '^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-[^.]+)?\.jpg$', 5) AS BIGINT) AS version FROM f""")
def file_times(spark, d):
    """A15."""
    i = F.col("event_id")
    name = F.when(i % 4 == 0, F.format_string("t%09d_cab12cd34-why.jpg", i)).when(i % 4 == 1, F.format_string("strip_%09d_%09d_n%d.jpg", i, i * 3, i % 16)).when(i % 4 == 2, F.format_string("strip_%09d_%09d_n8_c4_v2-x.jpg", i, i * 3)).otherwise(F.format_string("t%d.jpg", i))
    return selection.file_times(fx.table(spark, d, "events").select(i.alias("id"), name.alias("file")), "file").drop("file")


PATHS = ["a.jpg", "frames/b.PNG", "/abs.jpg", "x/../b.jpg", "frames\\\\c.webp", "other/d.jpg", "frames/e.gif", "./f.jpeg"]
SAFE = [f"frames/{x}" if x else None for x in ("a.jpg", "b.PNG", None, None, "c.webp", None, None, "f.jpeg")]


@query("image_paths", f"WITH p AS (SELECT event_id % {len(PATHS)} AS k FROM events) SELECT [{', '.join(repr(x) if x else 'NULL' for x in SAFE)}][k + 1] AS path, count(*) AS n FROM p GROUP BY 1")
def image_paths(spark, d):
    """The SQL lists what each form must become."""
    given = F.get(F.array(*(F.lit(x.replace("\\\\", "\\")) for x in PATHS)), (F.col("event_id") % len(PATHS)).cast("int"))
    return fx.table(spark, d, "events").groupBy(selection.image_path(given).alias("path")).agg(F.count("*").alias("n"))


@query("paired_reasons", """WITH s AS (SELECT o_orderkey AS ws, list_transform(range(1 + o_orderkey % 4), lambda x: x * 10) AS times, list_transform(range(o_custkey % 5), lambda x: 'r' || x) AS reasons FROM orders),
p AS (SELECT ws, times, CASE WHEN len(reasons) > 1 AND len(reasons) <> len(times) THEN 'count_mismatch' END AS code, CASE WHEN len(reasons) = 1 THEN list_transform(times, lambda x: reasons[1]) WHEN len(reasons) = 0 THEN list_transform(times, lambda x: NULL) ELSE reasons END AS rs FROM s)
SELECT ws, code, NULL AS t, NULL AS reason FROM p WHERE code IS NOT NULL UNION ALL SELECT ws, code, unnest(times), unnest(rs) FROM p WHERE code IS NULL""")
def paired_reasons(spark, d):
    """C20."""
    o = fx.table(spark, d, "orders")
    times = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 4), lambda x: x * 10)
    reasons = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda x: x < F.col("o_custkey") % 5), lambda x: F.concat(F.lit("r"), x.cast("string")))
    return selection.paired_reasons(o.select(F.col("o_orderkey").alias("ws"), times.alias("times"), reasons.alias("reasons")))


_CLEAN = r"""translate(regexp_replace({c}, 'https?://\S+|@\S+|#\S+|\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?\b|[▶►★☆♥♡]', ' ', 'g'), '[]()<>{{}}|·,、/\"' || chr(39) || '“”‘’!?~*_', '                         ')"""


def _terms(c: str) -> str:
    clean = _CLEAN.format(c=c)
    return (
        f"list_filter(regexp_extract_all({clean}, '[0-9A-Za-z가-힣]{{2,}}'), lambda w: NOT regexp_matches(w, '^\\d+$') AND NOT list_contains([{', '.join(repr(x) for x in selection.STOP)}], lower(w)))"
    )


def _distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _except(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


PRIOR = f"""m AS (SELECT doc_id AS ws, text[:90] || ' @me 12:30 2026 the Official' AS title, lang || 'Channel' || doc_id || ' ' || text[91:120] AS uploader, text[60:400] || ' https://x.y/z #tag' AS description FROM documents WHERE text IS NOT NULL),
q AS (SELECT ws, {_terms('title')} AS t, {_terms('uploader')} AS u, {_terms('description')} AS d FROM m), w AS (SELECT ws, {_distinct('t')}[:12] AS t, {_distinct('u')}[:12] AS u, {_distinct('d')}[:12] AS d FROM q),
s1 AS (SELECT *, t[:6] AS st FROM w), s2 AS (SELECT *, {_except('u', 'st')}[:2] AS su FROM s1), s3 AS (SELECT *, {_except('d', 'list_concat(st, su)')}[:4] AS sd FROM s2),
x0 AS (SELECT *, list_concat(st, su, sd) AS seen FROM s3), x1 AS (SELECT *, {_except('t', 'seen')}[:12 - len(seen)] AS xt FROM x0), x2 AS (SELECT *, {_except('u', 'list_concat(seen, xt)')}[:12 - len(seen) - len(xt)] AS xu FROM x1),
x3 AS (SELECT *, {_except('d', 'list_concat(seen, xt, xu)')}[:12 - len(seen) - len(xt) - len(xu)] AS xd FROM x2)"""


@query("prior_terms", f"WITH {PRIOR} SELECT ws, array_to_string(list_concat(sd, xd, su, xu, st, xt), ' ') AS terms FROM x3")
def prior_terms(spark, d):
    """J06, G10, D20."""
    t = fx.table(spark, d, "documents").where("text is not null")
    part = lambda a, n: F.substring("text", a, n)
    m = t.select(
        F.col("doc_id").alias("ws"), F.concat(part(1, 90), F.lit(" @me 12:30 2026 the Official")).alias("title"),
        F.concat("lang", F.lit("Channel"), F.col("doc_id").cast("string"), F.lit(" "), part(91, 30)).alias("uploader"), F.concat(part(60, 341), F.lit(" https://x.y/z #tag")).alias("description"),
    )
    return selection.priors(m)


@query("hotwords", "WITH t AS (SELECT p_name AS term, count(DISTINCT l_suppkey) AS sources, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), b AS (SELECT * FROM t ORDER BY sources DESC, n DESC, term DESC LIMIT 50) SELECT term, sources, n, row_number() OVER (ORDER BY sources, n, term) AS place FROM b")
def hotwords(spark, d):
    """G06."""
    j = fx.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(fx.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("term")), "l_partkey")
    return selection.hotwords(j.groupBy("term").agg(F.count_distinct("l_suppkey").alias("sources"), F.count("*").alias("n")))


@query("graph_entities", "SELECT 'c' || o_custkey AS label, count(*) AS n, count(DISTINCT o_orderstatus) AS workspaces FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 400")
def graph_entities(spark, d):
    """G07."""
    return selection.graph_entities(fx.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("label"), F.col("o_orderstatus").alias("ws")))


@query("intent_hits", f"""WITH {TURNS}, h AS (SELECT ws, id, start_ms, CAST(contains(lower(text), 'how') AS BIGINT) + CAST(contains(lower(text), 'the') AS BIGINT) + CAST(contains(lower(text), 'an') AS BIGINT) AS hits FROM seg)
SELECT ws, id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY hits DESC, start_ms, id) AS rank FROM h WHERE hits > 0) x WHERE rank <= 3""")
def intent_hits(spark, d):
    """G09."""
    return selection.intent_hits(fx.turns(spark, d), ["How", "the", "an"], 3)


@query("chosen_records", "WITH a AS (SELECT o_orderkey AS place, o_custkey * 2 AS id FROM orders WHERE o_orderkey % 10 = 0) SELECT place, id, c_custkey IS NOT NULL AS found, c_name AS name FROM a LEFT JOIN customer ON c_custkey = id")
def chosen_records(spark, d):
    """G11."""
    ids = fx.table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("place"), (F.col("o_custkey") * 2).alias("id"))
    return selection.chosen(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), ids)


@query("image_order", "WITH r AS (SELECT user_id % 20 AS ws, 'f' || event_id AS path, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS DOUBLE) END AS s, CASE WHEN event_id % 3 = 1 THEN value END AS t FROM events) SELECT ws, path, row_number() OVER (PARTITION BY ws ORDER BY coalesce(s, t, 1e300), path) AS place FROM r")
def image_order(spark, d):
    """G13."""
    e = fx.table(spark, d, "events")
    i = F.col("event_id")
    r = e.select((F.col("user_id") % 20).alias("ws"), F.concat(F.lit("f"), i.cast("string")).alias("path"), F.when(i % 3 == 0, (i % 50).cast("double")).alias("start"), F.when(i % 3 == 1, F.col("value")).alias("t"))
    return selection.image_order(r).select("ws", "path", "place")


@query("speaker_ribbons", f"""WITH {TURNS}, s AS (SELECT ws, id, start_ms, end_ms, CASE WHEN ws % 2 = 0 THEN ['x'] WHEN id % 4 = 0 THEN [speaker, 'x'] ELSE [speaker] END AS sp FROM seg), u AS (SELECT ws, id, start_ms, end_ms, len(sp) > 1 AS shared, unnest(sp) AS speaker FROM s)
SELECT * FROM u WHERE ws IN (SELECT ws FROM u GROUP BY ws HAVING count(DISTINCT speaker) >= 2)""")
def speaker_ribbons(spark, d):
    """C31."""
    sp = F.when(F.col("ws") % 2 == 0, F.array(F.lit("x"))).when(F.col("id") % 4 == 0, F.array("speaker", F.lit("x"))).otherwise(F.array("speaker"))
    return selection.ribbons(fx.turns(spark, d).select("ws", "id", "start_ms", "end_ms", sp.alias("speakers")))


@query("reply_locales", "WITH q AS (SELECT [' auto ', 'en-US', 'ko', 'AUTO', 'x', 'de-'][event_id % 6 + 1] AS a, CASE WHEN event_id % 4 = 0 THEN '무엇' ELSE 'what' END AS t FROM events) SELECT CASE WHEN lower(trim(a)) = 'auto' THEN CASE WHEN t = '무엇' THEN 'ko' ELSE 'en' END WHEN a = 'en-US' THEN 'en' WHEN a = 'ko' THEN 'ko' ELSE '' END AS locale, count(*) AS n FROM q GROUP BY 1")
def reply_locales(spark, d):
    """C19."""
    a = F.get(F.array(*map(F.lit, [" auto ", "en-US", "ko", "AUTO", "x", "de-"])), (F.col("event_id") % 6).cast("int"))
    t = F.when(F.col("event_id") % 4 == 0, "무엇").otherwise("what")
    return fx.table(spark, d, "events").groupBy(selection.reply_locale(t, a).alias("locale")).agg(F.count("*").alias("n"))


@query("last_reasons", "SELECT user_id % 20 AS ws, event_id % 90 AS file, arg_max(event_type, event_id) AS reason FROM events GROUP BY 1, 2")
def last_reasons(spark, d):
    """L15."""
    return selection.last_reasons(fx.table(spark, d, "events").select((F.col("user_id") % 20).alias("ws"), (F.col("event_id") % 90).alias("file"), F.col("event_id").alias("n"), F.col("event_type").alias("reason")))


@query("merged_glossary", """WITH o AS (SELECT 't' || (l_partkey % 500) AS term, l_suppkey AS ws, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2), n AS (SELECT 't' || (l_partkey % 500) AS term, l_suppkey AS ws, count(*) AS n FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2),
b AS (SELECT term, ws, n, 0 AS o FROM o UNION ALL SELECT term, ws, n, 1 FROM n), u AS (SELECT term, ws, arg_max(n, o) AS n FROM b GROUP BY term, ws) SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS sources FROM u GROUP BY term""")
def merged_glossary(spark, d):
    """L14, K11."""
    li = fx.table(spark, d, "lineitem").select(F.concat(F.lit("t"), (F.col("l_partkey") % 500).cast("string")).alias("term"), F.col("l_suppkey").alias("ws"), "l_linenumber")
    count = lambda x: x.groupBy("term", "ws").agg(F.count("*").alias("n"))
    return selection.merged_glossary(count(li.where("l_linenumber < 4")), count(li.where("l_linenumber >= 3")))


@query("source_states", "WITH f AS (SELECT p_partkey % 5 > 0 AS present, p_size % 7 > 0 AS readable, p_partkey % 3 AS valid FROM part) SELECT CASE WHEN NOT present THEN 'absent' WHEN NOT readable THEN 'unreadable' WHEN valid = 0 THEN 'present_without_valid_records' ELSE 'ready' END AS state, count(*) AS n FROM f GROUP BY 1")
def source_states(spark, d):
    """L16."""
    f = fx.table(spark, d, "part").select((F.col("p_partkey") % 5 > 0).alias("present"), (F.col("p_size") % 7 > 0).alias("readable"), (F.col("p_partkey") % 3).alias("valid"))
    return selection.source_states(f).groupBy("state").agg(F.count("*").alias("n"))


@query("export_policy", """WITH r AS (SELECT ['edl', 'otio', 'fcpxml', 'xml', 'md', 'srt'][o_orderkey % 6 + 1] AS format, o_custkey % 2 = 0 AS receipt, o_custkey % 3 > 0 AS output, o_custkey % 5 = 0 AS ids, o_custkey % 7 < 4 AS sequence FROM orders)
SELECT format, CASE WHEN receipt AND NOT output THEN 'receipt_without_output' WHEN receipt AND format NOT IN ('edl', 'otio', 'fcpxml') THEN 'receipt_unsupported' WHEN sequence AND ids THEN 'ids_and_sequence' WHEN sequence AND format NOT IN ('edl', 'otio', 'fcpxml') THEN 'sequence_unsupported' END AS code, count(*) AS n FROM r GROUP BY 1, 2""")
def export_policy(spark, d):
    """B07."""
    k = F.col("o_custkey")
    f = F.get(F.array(*map(F.lit, (*selection.RICH, *selection.PLAIN))), (F.col("o_orderkey") % 6).cast("int"))
    r = fx.table(spark, d, "orders").select(f.alias("format"), (k % 2 == 0).alias("receipt"), (k % 3 > 0).alias("output"), (k % 5 == 0).alias("ids"), (k % 7 < 4).alias("sequence"))
    return selection.refused(r).groupBy("format", "code").agg(F.count("*").alias("n"))
