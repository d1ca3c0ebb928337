"""Registered queries of the stored search index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..shared import folder
from ..sources import fixtures as fx
from .registry import TURNS, query

#: Folders of indexes by table folder: a session writes each once, and asks it as often as it likes.
_built: dict[tuple[int, str], search.Index] = {}


def documents(spark, d) -> DataFrame:
    """Conversations as transcripts, documents as screen texts, benchmark passages as checkpoints; a workspace each hundred."""
    t = fx.turns(spark, d).select((F.col("ws") % 50).alias("ws"), (F.col("ws") * 10_000_000 + F.col("start_ms")).alias("start"), (F.col("ws") * 10_000_000 + F.col("end_ms")).alias("end"), "text")
    b = fx.table(spark, d, "benchmark").select((F.col("item_id") % 50).alias("ws"), F.col("item_id").alias("id"), F.col("item_id").alias("start"), (F.col("item_id") + 1).alias("end"), "text")
    o = fx.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("ws"), F.col("doc_id").alias("start"), (F.col("doc_id") + 1).alias("end"), "text")
    return search.collected(t, b, o)


def index(spark, d) -> search.Index:
    at = (id(spark), d)
    if at not in _built:
        path = f"{folder(spark)}/search-{uuid.uuid4().hex}"
        search.sync(documents(spark, d), path)
        _built[at] = search.Index(spark, path)
    return _built[at]


DOC = f"""{TURNS}, tx AS (SELECT ws % 50 AS ws, ws * 10000000 + start_ms AS s, ws * 10000000 + end_ms AS e, trim(nfc_normalize(text)) AS text FROM seg WHERE trim(text) <> ''),
ld AS (SELECT *, lead(s) OVER w AS s1, lead(e) OVER w AS e1, lead(text) OVER w AS t1, lead(s, 2) OVER w AS s2, lead(e, 2) OVER w AS e2, lead(text, 2) OVER w AS t2 FROM tx WINDOW w AS (PARTITION BY ws ORDER BY s, e)),
dc AS (SELECT ws, 'transcript' AS source, 'transcript' AS family, s, e, text, false AS win, NULL AS mem FROM tx
  UNION ALL SELECT ws, 'transcript-window', 'transcript', s, CASE WHEN s2 - e1 <= 5000 THEN e2 ELSE e1 END, CASE WHEN s2 - e1 <= 5000 THEN concat_ws(' ', text, t1, t2) ELSE concat_ws(' ', text, t1) END, true,
    CASE WHEN s2 - e1 <= 5000 THEN [{{'s': s, 'e': e, 't': text}}, {{'s': s1, 'e': e1, 't': t1}}, {{'s': s2, 'e': e2, 't': t2}}] ELSE [{{'s': s, 'e': e, 't': text}}, {{'s': s1, 'e': e1, 't': t1}}] END FROM ld WHERE s1 - e <= 5000
  UNION ALL SELECT item_id % 50, 'checkpoint:' || item_id, 'understanding', item_id, item_id + 1, trim(nfc_normalize(text)), false, NULL FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT doc_id % 50, 'ocr', 'screen', doc_id, doc_id + 1, trim(nfc_normalize(text)), false, NULL FROM documents WHERE trim(text) <> ''),
tk AS (SELECT *, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS toks, greatest(length(lower(text)) - 2, 0) AS tri, lower(text) AS low FROM dc)"""


def _scored(name: str, terms: list[str], size: str, where: str = "true") -> str:
    """BM25 over the documents in which every term occurs; each term an expression that counts it."""
    f = "greatest(1e-6, ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE))) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {s} / mean))"
    own = range(len(terms))
    return f"""{name}f AS (SELECT *, {", ".join(f"{t} AS f{i}" for i, t in enumerate(terms))} FROM tk), {name}s AS (SELECT count(*) AS n, sum({size})::DOUBLE / count(*) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in own)} FROM {name}f),
{name}b AS (SELECT {name}f.*, round({" + ".join(f.format(i=i, s=size) for i in own)}, 6) AS score FROM {name}f, {name}s WHERE {" AND ".join(f"f{i} > 0" for i in own)} AND {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, ws, source, s, e) AS rank FROM {name}b) x WHERE rank <= 40)"""


def _begins(t: str) -> str:
    return f"len(list_filter(toks, lambda x: starts_with(x, '{t}')))"


def _holds(t: str, c: str = "low") -> str:
    return f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}"


A, Z = "tion", "ing"
#: No term overlaps itself, so that counting by replacement counts all its places.
FUSED = """bt AS (SELECT family, (SELECT count(*) FROM wd WHERE wd.family = f.family) > 0 AS w, (SELECT count(*) FROM tr WHERE tr.family = f.family) > 0 AS t FROM (VALUES ('understanding'), ('screen'), ('transcript')) f(family)),
un AS (SELECT wd.family, ws, source, s, e, text, mem, rank FROM wd UNION ALL SELECT tr.family, ws, source, s, e, text, mem, rank FROM tr),
fu AS (SELECT family, ws, source, s, e, any_value(text) AS text, any_value(mem) AS mem, sum(1.0::DOUBLE / (60 + rank)) AS sc FROM un GROUP BY family, ws, source, s, e),
ft AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(sc, 12) DESC, ws, source, s, e) AS pos FROM fu), fh AS (SELECT * FROM ft WHERE pos <= 40)"""


def _ranked(words: list[str], texts: list[str], where: str = "true") -> str:
    return f"{_scored('wd', words, 'len(toks)', where)}, {_scored('tr', texts, 'tri', where)},\n{FUSED}"


RANKED = _ranked([_begins(A), _begins(Z)], [_holds(A), _holds(Z)])
FINAL = """rs AS (SELECT family, ws, pos, CASE WHEN mem IS NULL THEN source ELSE 'transcript' END AS source, CASE WHEN mem IS NULL THEN s ELSE b.s END AS s, CASE WHEN mem IS NULL THEN e ELSE b.e END AS e
  FROM (SELECT *, CASE WHEN mem IS NOT NULL THEN list_reduce(mem, lambda x, y: CASE WHEN {cy} > {cx} THEN y ELSE x END) END AS b FROM fh) y),
dd AS (SELECT family, ws, source, s, e, min(pos) AS pos FROM rs GROUP BY family, ws, source, s, e), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pos) AS r FROM dd)
SELECT ws, source, family, s AS "start", e AS "end", round(1.0::DOUBLE / (60 + r), 4) AS score FROM rk ORDER BY 1.0::DOUBLE / (60 + r) DESC, CASE family WHEN 'understanding' THEN 0 WHEN 'screen' THEN 1 ELSE 2 END, ws, source, s, e LIMIT 10"""


def _final(*terms: str) -> str:
    cx, cy = (" + ".join(_holds(t, f"{v}.t") for t in terms) for v in "xy")
    return FINAL.replace("{cx}", cx).replace("{cy}", cy)


@query("search", f"WITH {DOC}, {RANKED}, {_final(A, Z)}")
def search_(spark, d):
    """Two terms, all retrievers."""
    return search.search(index(spark, d), f"{A} {Z}", 10)


PHRASES = ["the-of", "And-TH"]


def _phrase(t: str) -> str:
    """Places at which the words of t stand one after the other, the last as the beginning of one."""
    a, b = t.lower().split("-")
    return f"len(list_filter(range(1, len(toks)), lambda i: toks[i] = '{a}' AND starts_with(toks[i + 1], '{b}')))"


@query("search_phrases", f"WITH {DOC}, {_ranked([_phrase(t) for t in PHRASES], [_holds(t.lower()) for t in PHRASES])}, {_final(*PHRASES)}")
def search_phrases(spark, d):
    """Terms of several words are phrases, found by the places of their words."""
    return search.search(index(spark, d), " ".join(PHRASES), 10)


@query("search_single", f"WITH {DOC}, {_ranked([_begins(A)], [_holds(A)], 'NOT win')}, {_final(A)}")
def search_single(spark, d):
    """A single term asks no windows."""
    return search.search(index(spark, d), A, 10)


COV = ["enti", "athawh", "thhe", "zzz"]
_LOW = [f"CAST(contains(low, '{t}') AS BIGINT)" for t in COV]


@query("search_fallback", f"""WITH {DOC}, cv AS (SELECT *, {' + '.join(_LOW)} AS matched, {' + '.join(_holds(t) for t in COV)} AS occ FROM tk),
fh AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY matched DESC, occ DESC, ws, source, s, e) AS pos FROM cv WHERE matched >= 3 QUALIFY pos <= 40), {_final(*COV)}""")
def search_fallback(spark, d):
    """No document has all four terms, some have three."""
    return search.search(index(spark, d), " ".join(COV), 10)


@query("search_documents", f"WITH {DOC} SELECT ws, source, family, s AS \"start\", e AS \"end\", win AS is_window, len(text) AS size, coalesce(len(mem), 0) AS members FROM dc")
def search_documents(spark, d):
    """I01, F01, H08."""
    return documents(spark, d).select("ws", "source", "family", "start", "end", "is_window", F.length("text").alias("size"), F.greatest(F.coalesce(F.size("members"), F.lit(0)), F.lit(0)).alias("members"))


@query("search_sync", f"""WITH {DOC}, n AS (SELECT ws, count(*) AS n FROM dc GROUP BY ws) SELECT 'first' AS step, count(*) AS changed FROM n UNION ALL SELECT 'again', 0 UNION ALL SELECT 'one', 1 UNION ALL SELECT 'gone', (SELECT count(*) FROM n WHERE ws % 10 = 3)""")
def search_sync(spark, d):
    """An unchanged corpus writes nothing, a changed workspace itself alone, and those without documents go."""
    path = f"{folder(spark)}/search-{uuid.uuid4().hex}"
    docs = documents(spark, d)
    first = docs.agg(F.min("ws")).collect()[0][0]
    less = docs.where(F.col("ws") % 10 != 3)
    edited = lambda x: x.withColumn("text", F.when(F.col("ws") == first, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    steps = [("first", docs), ("again", docs), ("one", edited(docs)), ("gone", edited(less))]
    return spark.createDataFrame([(k, search.sync(x, path)) for k, x in steps], "step string, changed long")
