"""Registered queries of snapping, pools, links, aliases, qualifiers and time bases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import beats, markdown, naming, pool, qualifiers, timebase
from ..sources import fixtures as fx
from .registry import CUTS, SERIES, query

MEDIA_MS = 1_035_000

SNAP = f"""WITH RECURSIVE {CUTS}, {SERIES}, grid AS (SELECT CASE ws WHEN 'click' THEN 'A' WHEN 'view' THEN 'N' WHEN 'purchase' THEN 'R' END AS grid, list(b ORDER BY b) AS beats FROM (SELECT ws, i * 500 + CAST(floor(value) AS BIGINT) % 300 AS b FROM ser WHERE ws IN ('click', 'view', 'purchase')) x GROUP BY ws),
flag AS (SELECT l_orderkey AS seq, max(l_returnflag) AS grid FROM lineitem GROUP BY 1),
c AS (SELECT cut.seq, ord, start_s * 1000 AS s, (start_s + length_s) * 1000 AS e, count(*) OVER (PARTITION BY cut.seq) AS n, beats FROM cut JOIN flag USING (seq) JOIN grid USING (grid)),
st AS (SELECT 0::BIGINT AS ord, seq, 0::BIGINT AS elapsed, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS delta, NULL::VARCHAR AS reason FROM (SELECT DISTINCT seq FROM c) q
  UNION ALL SELECT ord, seq, joint + CASE WHEN why IS NULL THEN move ELSE 0 END, s, e + CASE WHEN why IS NULL THEN move ELSE 0 END, CASE WHEN why IS NULL THEN move ELSE 0 END, why
  FROM (SELECT *, CASE WHEN ord = n THEN 'tail-cut' WHEN e + move - s < 50 OR e + move > {MEDIA_MS} THEN 'span-bounds' END AS why
    FROM (SELECT *, CASE WHEN k = 0 THEN beats[1] WHEN k = len(beats) OR abs(beats[k] - joint) <= abs(beats[k + 1] - joint) THEN beats[k] ELSE beats[k + 1] END - joint AS move
      FROM (SELECT c.ord, c.seq, c.s, c.e, c.n, c.beats, st.elapsed + c.e - c.s AS joint, len(list_filter(c.beats, lambda b: b <= st.elapsed + c.e - c.s)) AS k FROM st JOIN c ON c.seq = st.seq AND c.ord = st.ord + 1) x) y) z)
SELECT seq, ord, s AS start_ms, e AS end_ms, delta AS delta_ms, reason IS NULL AS snapped, reason FROM st WHERE ord > 0"""


@query("snapped_cuts", SNAP)
def snapped_cuts(spark, d):
    """Each sequence on the grid that its return flag names."""
    li = fx.table(spark, d, "lineitem")
    flag = li.groupBy(F.col("l_orderkey").alias("seq")).agg(F.max("l_returnflag").alias("grid"))
    cuts = fx.cuts(spark, d).join(flag, "seq").select("seq", "ord", (F.col("start_s") * 1000).alias("start_ms"), ((F.col("start_s") + F.col("length_s")) * 1000).alias("end_ms"), F.lit(MEDIA_MS).cast("long").alias("duration_ms"), "grid")
    s = fx.signals(spark, d)
    grid = F.when(F.col("ws") == "click", "A").when(F.col("ws") == "view", "N").when(F.col("ws") == "purchase", "R")
    grids = s.select(grid.alias("grid"), (F.col("i") * 500 + F.floor("value") % 300).cast("long").alias("beat_ms")).where("grid is not null")
    return beats.snapped(cuts.where(F.col("grid").isin("A", "N", "R")), grids)


@query("keyframe_pool", """WITH RECURSIVE f AS (SELECT user_id % 20 AS ws, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n, CAST(floor(value * 1000) AS BIGINT) AS t, value / 500 AS w, event_type AS src FROM events),
g AS (SELECT * FROM f WHERE t BETWEEN 1000 AND 480000), m AS (SELECT ws, max(n) AS last FROM f GROUP BY ws),
p AS (SELECT ws, 0::BIGINT AS n, [{'t': 0::BIGINT, 'w': 0::DOUBLE, 'src': [''], 'n': 0::BIGINT}][2:] AS pool FROM m
  UNION ALL SELECT ws, n, CASE WHEN t IS NULL THEN pool WHEN hit IS NULL THEN list_append(pool, {'t': t, 'w': w, 'src': [src], 'n': 1::BIGINT})
    ELSE list_transform(pool, lambda x: CASE WHEN x.t = hit THEN {'t': x.t, 'w': greatest(x.w, w), 'src': CASE WHEN list_contains(x.src, src) THEN x.src ELSE list_append(x.src, src) END, 'n': x.n + 1} ELSE x END) END
  FROM (SELECT p.ws, p.n + 1 AS n, pool, g.t, g.w, g.src, list_filter(pool, lambda x: abs(x.t - g.t) <= 500)[1].t AS hit FROM p JOIN m ON m.ws = p.ws AND p.n < m.last LEFT JOIN g ON g.ws = p.ws AND g.n = p.n + 1) y)
SELECT ws, x.t AS t_ms, x.w AS weight, array_to_string(x.src, '+') AS source, x.n AS n FROM (SELECT p.ws, unnest(pool) AS x FROM p JOIN m ON m.ws = p.ws AND p.n = m.last) z""")
def keyframe_pool(spark, d):
    """Events as candidates in the order of time, at the moment that their value names."""
    e = fx.table(spark, d, "events").withColumn("ws", F.col("user_id") % 20)
    n = F.row_number().over(W.partitionBy("ws").orderBy("ts", "event_id")).cast("long")
    found = e.select("ws", n.alias("n"), F.floor(F.col("value") * 1000).cast("long").alias("t_ms"), (F.col("value") / 500).alias("weight"), F.col("event_type").alias("source"))
    return pool.candidates(found, 1000, 480_000)


MARKDOWN = r"""href AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS w FROM pages),
wp AS (SELECT w, 'w/' || w || CASE WHEN contains(w, 'th') THEN '(th)' ELSE '' END || '.md' AS path, max(page_id) AS p FROM href WHERE w <> '' GROUP BY w),
md AS (SELECT 'p/' || page_id || '.md' AS path, regexp_replace(regexp_replace(html, '<a href="/([^"]*th[^"]*)">([^<]*)</a>', '[\2](../w/\1(th).md#top)', 'g'), '<a href="/([^"]*)">([^<]*)</a>', '[\2](<../w/\1.md>) [x](../no page.md)', 'g') AS text FROM pages
  UNION ALL SELECT path, '[page](../p/' || p || '.md) [site](http://x.org/a.md) [img](a.png)' FROM wp),
raws AS (SELECT path, unnest(regexp_extract_all(text, '\]\(((?:[^()]|\([^()]*\))*)\)', 1)) AS raw FROM md),
nm AS (SELECT path, raw, CASE WHEN starts_with(trim(raw), '<') AND ends_with(trim(raw), '>') THEN trim(raw)[2:-2] ELSE trim(raw) END AS name, starts_with(trim(raw), '<') AS wrapped FROM raws),
tg AS (SELECT path, raw, wrapped, trim(split_part(name, '#', 1)) AS name FROM nm),
ln AS (SELECT path, raw, CASE WHEN contains(name, ' ') AND NOT wrapped THEN NULL ELSE name[4:] END AS page FROM tg WHERE ends_with(name, '.md') AND NOT contains(name, '://'))"""


def markdown_pages(spark, d):
    """Pages as Markdown, and a page for each word that they link to, which links to the last page that does."""
    p = fx.table(spark, d, "pages").select("page_id", "html")
    w = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'))).alias("w")).where("w <> ''").groupBy("w").agg(F.max("page_id").alias("p"))
    text = F.regexp_replace("html", '<a href="/([^"]*th[^"]*)">([^<]*)</a>', "[$2](../w/$1(th).md#top)")
    text = F.regexp_replace(text, '<a href="/([^"]*)">([^<]*)</a>', "[$2](<../w/$1.md>) [x](../no page.md)")
    own = p.select(F.format_string("p/%d.md", "page_id").alias("path"), text.alias("text"))
    path = F.concat(F.lit("w/"), "w", F.when(F.contains("w", F.lit("th")), "(th)").otherwise(""), F.lit(".md"))
    return own.unionByName(w.select(path.alias("path"), F.concat(F.lit("[page](../p/"), F.col("p").cast("string"), F.lit(".md) [site](http://x.org/a.md) [img](a.png)")).alias("text")))


@query("markdown_links", f"WITH {MARKDOWN} SELECT path, raw, page, count(*) AS n FROM ln GROUP BY ALL")
def markdown_links(spark, d):
    """Destinations with parentheses, in angle brackets, with fragments, with bare spaces."""
    return markdown.links(markdown_pages(spark, d)).groupBy("path", "raw", "page").agg(F.count("*").alias("n"))


@query("markdown_integrity", f"""WITH RECURSIVE {MARKDOWN}, ed AS (SELECT DISTINCT ln.path AS src, page AS dst FROM ln JOIN md ON md.path = page),
re AS (SELECT 'p/' || min(page_id) || '.md' AS path FROM pages UNION SELECT dst FROM re JOIN ed ON src = path),
ct AS (SELECT path, count(*) AS links, count(*) FILTER (page IS NULL OR page NOT IN (SELECT path FROM md)) AS broken FROM ln GROUP BY path)
SELECT md.path, coalesce(links, 0) AS links, coalesce(broken, 0) AS broken, md.path IN (SELECT path FROM re) AS reached FROM md LEFT JOIN ct USING (path)""")
def markdown_integrity(spark, d):
    """Broken links and orphans, from the first page on."""
    root = fx.table(spark, d, "pages").agg(F.format_string("p/%d.md", F.min("page_id")).alias("node"))
    return markdown.integrity(markdown_pages(spark, d), root)


@query("alias_groups", r"""WITH RECURSIVE l AS (SELECT DISTINCT p_name || ' ' || p_type || ' (' || p_brand || ')' AS label FROM part),
t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY label) AS i, label, list_distinct(list_filter(regexp_split_to_array(regexp_replace(label, '\([^)]*\)', ' ', 'g'), '\s+'), lambda w: w <> '')) AS t FROM l),
s AS MATERIALIZED (SELECT y.i, list(x.i) AS near FROM t x JOIN t y ON x.i < y.i AND len(list_intersect(x.t, y.t)) * 2 >= len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) GROUP BY y.i),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS lead, []::BIGINT[] AS leaders
  UNION ALL SELECT i, lead, CASE WHEN lead = i THEN list_append(leaders, i) ELSE leaders END
  FROM (SELECT r.i + 1 AS i, coalesce(list_min(list_intersect(s.near, leaders)), r.i + 1) AS lead, leaders FROM r LEFT JOIN s ON s.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM t)) x)
SELECT a.label AS leader, b.label FROM r JOIN t b ON b.i = r.i JOIN t a ON a.i = r.lead WHERE r.lead IN (SELECT lead FROM r WHERE lead > 0 GROUP BY lead HAVING count(*) > 1)""")
def alias_groups(spark, d):
    """Parts by name, type and brand, of which the brand stands in parentheses."""
    p = fx.table(spark, d, "part")
    label = F.concat(F.concat_ws(" ", "p_name", "p_type"), F.lit(" ("), "p_brand", F.lit(")"))
    return naming.alias_groups(p.select(label.alias("label")).distinct())


MARKERS = ("tion", "cht", "osa")
#: So many ids at most are sent to every executor.
FEW = 1_000_000
_MARKED = " OR ".join(f"contains(clause, '{m}')" for m in MARKERS)


@query("dropped_qualifiers", rf"""WITH x AS (SELECT d.source AS ws, d.text, d.doc_id IN (SELECT doc_id FROM labels) AS known FROM documents d WHERE d.text IS NOT NULL),
pt AS (SELECT ws, regexp_replace(text, '\([^()]*\)', ' ', 'g') AS part FROM x WHERE known UNION ALL SELECT ws, unnest(regexp_extract_all(text, '\(([^()]*)\)', 1)) FROM x WHERE known),
cl AS (SELECT ws, unnest(regexp_split_to_array(part, '[.!?。\n;]|—')) AS clause FROM pt),
tk AS (SELECT ws, ({_MARKED}) AS m, unnest(list_distinct(regexp_extract_all(clause, '[가-힣]{{2,}}|[A-Za-z]{{3,}}'))) AS token FROM cl),
qo AS (SELECT ws, token FROM tk GROUP BY ws, token HAVING bool_and(m) AND token NOT IN {MARKERS}),
rl AS (SELECT ws, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM x WHERE NOT known),
li AS (SELECT ws, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM rl),
lc AS (SELECT ws, line_no, line, unnest(regexp_split_to_array(translate(line, '()', '  '), '[.!?。\n;,，]|—')) AS clause FROM li WHERE line <> '' AND NOT regexp_matches(line, '^(#|\(|<!--)')),
wd AS (SELECT DISTINCT ws, line_no, line, ltrim(unnest(regexp_split_to_array(clause, '\s+')), '''"“”‘’«»『』「」·*_~`([{{<') AS word FROM lc WHERE NOT ({_MARKED}))
SELECT DISTINCT wd.ws, line_no, token, line[:120] AS line FROM wd JOIN qo ON qo.ws = wd.ws AND starts_with(word, token)""")
def dropped_qualifiers(spark, d):
    """Labelled documents as the ledger of their source, the others as its narrative."""
    x = fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("ws"), "text")
    known = fx.table(spark, d, "labels").select("doc_id").distinct()
    known = F.broadcast(known) if known.count() <= FEW else known  # more are shuffled, and the texts with them
    return qualifiers.dropped_qualifiers(x.join(known, "doc_id", "left_semi").select("ws", "text"), x.join(known, "doc_id", "left_anti").select("ws", "text"), MARKERS)


BASES = {"click": (1001, 30000), "view": (1, 25), "purchase": (1, 90000), "signup": (1001, 24000), "error": (0, 1)}


@query("canonical_spans", f"""WITH s AS (SELECT event_id, value / 3 AS a, value / 3 + (value - floor(value)) * 20 - 1 AS b, 150::DOUBLE AS dur, user_id AS origin,
  CASE event_type {' '.join(f"WHEN '{k}' THEN {n}" for k, (n, _) in BASES.items())} END::BIGINT AS num, CASE event_type {' '.join(f"WHEN '{k}' THEN {m}" for k, (_, m) in BASES.items())} END::BIGINT AS den FROM events),
c AS (SELECT *, CASE WHEN num <= 0 THEN 'base' WHEN NOT (a >= 0 AND a < b) THEN 'order' WHEN b > dur THEN 'bounds' END AS code, (split_part(a::VARCHAR, '.', 1) || rpad(split_part(a::VARCHAR, '.', 2), 18, '0'))::HUGEINT AS ua, (split_part(b::VARCHAR, '.', 1) || rpad(split_part(b::VARCHAR, '.', 2), 18, '0'))::HUGEINT AS ub FROM s),
p AS (SELECT *, CASE WHEN code IS NULL THEN ua * den // (num * 1000000000000000000::HUGEINT) END AS pa, CASE WHEN code IS NULL THEN (ub * den + num * 1000000000000000000::HUGEINT - 1) // (num * 1000000000000000000::HUGEINT) END AS pb FROM c)
SELECT event_id, code, (origin + pa)::BIGINT AS start_pts, (origin + pb)::BIGINT AS end_pts, pa::DOUBLE * num / den AS start_s, CASE WHEN pb IS NOT NULL THEN least(dur, pb::DOUBLE * num / den) END AS end_s FROM p""")
def canonical_spans(spark, d):
    """Spans of events on the time base of their type."""
    e = fx.table(spark, d, "events")
    of = lambda i: F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v[i])) for k, v in BASES.items())).cast("long")
    a = F.col("value") / 3
    s = e.select("event_id", a.alias("start"), (a + (F.col("value") - F.floor("value")) * 20 - 1).alias("end"), F.lit(150.0).alias("duration"), F.col("user_id").alias("origin"), of(0).alias("num"), of(1).alias("den"))
    return timebase.canonical(s).select("event_id", "code", "start_pts", "end_pts", "start_s", "end_s")
