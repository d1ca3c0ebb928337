"""Links of Markdown pages: destinations with balanced parentheses, the graph of pages, broken links and orphans."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .corpus import reachable


def destinations(text: str) -> list[str]:
    """What stands between `](` and the parenthesis that closes it; an open one takes the rest and is none."""
    out, at = [], 0
    while (begin := text.find("](", at)) >= 0:
        depth, begin = 1, begin + 2
        at = begin
        while depth and at < len(text):
            close, open_ = text.find(")", at), text.find("(", at)
            if close < 0:
                at = len(text)
            elif 0 <= open_ < close:
                depth, at = depth + 1, open_ + 1
            else:
                depth, at = depth - 1, close + 1
        if depth:
            break
        out.append(text[begin : at - 1])
    return out


def target(path: str, raw: str) -> tuple[str, str | None] | None:
    """(raw, page) of a destination that means a Markdown page, None of another.

    Angle brackets are taken off, what follows # too, percent escapes read; a bare space makes the link broken (page null).
    """
    name = raw.strip()
    wrapped = len(name) > 1 and name.startswith("<") and name.endswith(">")
    name = (name[1:-1] if wrapped else name).split("#", 1)[0].strip()
    page = unquote(name)
    if not page or "://" in page or not page.endswith(".md"):
        return None
    if " " in name and not wrapped:
        return raw, None
    return raw, posixpath.normpath(posixpath.join(posixpath.dirname(path), page))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("page", T.StringType())])))
def _targets(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for paths, texts in series:
        found = ([t for t in (target(p, raw) for raw in destinations(x or "")) if t] for p, x in zip(paths, texts, strict=True))
        yield pd.Series([[{"raw": r, "page": g} for r, g in own] for own in found])


def links(pages: DataFrame) -> DataFrame:
    """(path, raw, page) of every link from a page (path, text) to a Markdown page, as often as it stands there."""
    return pages.select("path", F.explode(_targets("path", "text")).alias("t")).select("path", "t.raw", "t.page")


def integrity(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """Pages (path) with their links, the broken ones among them, and whether the roots (node) lead there."""
    found = links(pages)
    there = pages.select(F.col("path").alias("page")).distinct().withColumn("there", F.lit(True))
    marked = found.join(there, "page", "left")
    counts = marked.groupBy("path").agg(F.count("*").alias("links"), F.count_if(F.col("there").isNull()).alias("broken"))
    edges = marked.where("there").select(F.col("path").alias("src"), F.col("page").alias("dst"))
    reached = reachable(edges, roots).select(F.col("node").alias("path"), F.lit(True).alias("reached"))
    out = pages.select("path").distinct().join(counts, "path", "left").join(reached, "path", "left")
    return out.select("path", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("broken", F.lit(0)).alias("broken"), F.coalesce("reached", F.lit(False)).alias("reached"))
