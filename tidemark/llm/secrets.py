"""Secret scans with multipart credential linking, in DataFrame operations only.

Certain patterns are always reported. Weak candidates (a bare 40-character key, an endpoint) are
reported only where an access identifier stands within the same scope: parts are intervals of a text,
and an interval-join over bins of the scope's width finds the complementary ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, staged

#: The base patterns in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Possessive and anchored forms that find just the matches that pass the length rules.
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"
HEX_LONG = r"[0-9a-f]{32,}"
#: Weak candidates.
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"https?://[^\x20\x09-\x0D\"'<>]+"
KINDS = ["assign", "access", "hex", "key", "endpoint"]
#: Code points between complementary parts at most.
SCOPE = 256


def spans(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """[start, end, group lengths..] of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches alternate, so starts are running sums of their lengths;
    these are built block by block, that a text with very many matches isn't copied at each.
    """
    block = 256
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fields = {"h": F.transform(hits, F.length), "g": F.transform(gaps, F.length)}
    fields |= {f"e{k}": F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)), F.length) for k in groups}
    zipped = F.filter(F.arrays_zip(*(v.alias(k) for k, v in fields.items())), lambda x: x["h"].isNotNull())
    kind = "struct<s:int,e:int" + "".join(f",e{k}:int" for k in groups) + ">"

    def inner(start: Column, part: Column) -> Column:
        def add(a, x):
            s = a["p"] + x["g"]
            new = F.struct(s.alias("s"), (s + x["h"]).alias("e"), *(x[f"e{k}"].alias(f"e{k}") for k in groups))
            return F.struct((s + x["h"]).alias("p"), F.concat(a["o"], F.array(new.cast(kind))).alias("o"))

        return F.aggregate(part, F.struct(start.alias("p"), F.array().cast(f"array<{kind}>").alias("o")), add)

    def outer(z: Column) -> Column:
        def add(a, b):
            got = inner(a["p"], F.slice(z, b * block + 1, block))
            return F.struct(got["p"].alias("p"), F.concat(a["o"], F.array(got["o"])).alias("o"))

        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int"))
        zero = F.struct(F.lit(0).alias("p"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        return F.aggregate(blocks, zero, add, lambda a: F.flatten(a["o"]))

    none = F.array().cast(f"array<{kind}>")
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(F.array(zipped), outer)[0]).otherwise(none)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text plus found: array of (s, k, kind, e), sorted; k is the kind's place in KINDS.

    The base spans are always there; a weak candidate is where an access identifier lies within SCOPE code
    points of it and it overlaps no base span. A null text is an empty one, an empty table gives no rows. A column
    found is replaced, others may have any name; repeated rows and keys are rows of their own, as the join runs on
    a row number of the written table.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept, cols = plain(df, text, "found")
    rest = [f"c{i}" for i in range(len(kept))]
    assign = F.filter(spans(F.col("_t"), ASSIGN, (2,)), lambda x: x["e2"] >= 8)
    # runs are maximal either way, so that the long form has the matches of the base form that are long enough;
    # for access identifiers the base match may start earlier, within a run that holds AKIA twice: still the same
    made = {
        "_assign": F.transform(assign, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))),
        "_access": spans(F.col("_t"), ACCESS_LONG),
        "_hex": spans(F.col("_t"), HEX_LONG),
    }
    first = df.select(*cols, t.alias("_t")).select(*rest, "_t", *(v.alias(k) for k, v in made.items()))
    has = F.size("_access") > 0
    none = F.array().cast("array<struct<s:int,e:int>>")
    first = first.select(
        F.monotonically_increasing_id().alias("_row"),
        *rest,
        "_assign",
        "_access",
        "_hex",
        F.when(has, spans(F.col("_t"), KEY)).otherwise(none).alias("_key"),
        F.when(has, spans(F.col("_t"), ENDPOINT)).otherwise(none).alias("_endpoint"),
    )
    first = staged(first, "secrets")
    some = first.where((F.size("_access") > 0) & ((F.size("_key") > 0) | (F.size("_endpoint") > 0)))
    numbered = lambda k: F.transform(f"_{k}", lambda x: F.struct(F.lit(KINDS.index(k)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    weak = some.select("_row", F.explode(F.concat(numbered("key"), numbered("endpoint"))).alias("w"))
    reach = F.sequence(F.floor((F.col("w.s") - SCOPE) / SCOPE), F.floor((F.col("w.e") + SCOPE) / SCOPE))
    weak = weak.select("_row", "w", F.explode(reach).alias("bin"))
    ids = some.select("_row", F.explode("_access").alias("a"))
    ids = ids.select("_row", "a", F.explode(F.sequence(F.floor(F.col("a.s") / SCOPE), F.floor(F.col("a.e") / SCOPE))).alias("bin"))
    near = weak.join(ids, ["_row", "bin"]).where((F.col("a.s") <= F.col("w.e") + SCOPE) & (F.col("w.s") <= F.col("a.e") + SCOPE))
    linked = near.select("_row", "w").distinct().groupBy("_row").agg(F.collect_list("w").alias("_weak"))
    tag = lambda k: F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), F.lit(k).alias("kind"), x["e"].alias("e")))
    out = first.join(linked, "_row", "left").withColumn("_base", F.sort_array(F.concat(tag("assign"), tag("access"), tag("hex"))))
    clear = F.filter(F.coalesce("_weak", F.array().cast("array<struct<k:int,s:int,e:int>>")), lambda w: ~F.exists("_base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    more = F.transform(clear, lambda w: F.struct(w["s"].alias("s"), w["k"].alias("k"), F.when(w["k"] == 3, F.lit("key")).otherwise(F.lit("endpoint")).alias("kind"), w["e"].alias("e")))
    return out.select(*rest, F.sort_array(F.concat("_base", more)).alias("found")).toDF(*kept, "found")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    base = F.filter("found", lambda x: x["k"] < 3)
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each secret of its texts replaced by <kind>; overlapping spans are one replacement.

    Columns and rows stay as they are, whatever their names and keys: each row is cut by its own spans. A text is cut in as many
    stretches as a stretch has spans, so that no span walks the whole text: with m spans the work is that of the root of m
    passes over it.
    """
    found = scan(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_whole"), F.col(f"`{text}`").alias("_copy")), "_copy")
    own, n = F.col(f"_whole.`{text}`"), F.ceil(F.sqrt(F.size("found"))).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("found", i * n + 1, n))
    stretches = F.filter(stretches, lambda b: F.size(b) > 0)
    tops = F.transform(stretches, lambda b: F.array_max(F.transform(b, lambda x: x["e"])))
    # where each stretch begins: behind all spans before it, whichever reaches farthest
    begins = F.aggregate(tops, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.greatest(F.element_at(a, -1), t))))

    def cut(z):
        here = F.substring(own, z["p"] + 1, z["q"] - z["p"])

        def one(a, x):
            piece = F.concat(a["o"], F.substring(a["t"], a["p"] - z["p"] + 1, x["s"] - a["p"]), F.lit("<"), x["kind"], F.lit(">"))
            return F.struct(F.greatest(a["p"], x["e"]).alias("p"), F.when(x["s"] < a["p"], a["o"]).otherwise(piece).alias("o"), a["t"].alias("t"))

        return F.aggregate(z["b"], F.struct(z["p"].alias("p"), F.lit("").alias("o"), here.alias("t")), one, lambda a: a["o"])

    zipped = F.arrays_zip(stretches.alias("b"), F.slice(begins, F.lit(1), F.size(stretches)).alias("p"), F.slice(begins, F.lit(2), F.size(stretches)).alias("q"))
    new = F.concat(F.array_join(F.transform(zipped, cut), ""), F.substring(own, F.array_max(begins) + 1, F.length(own)))
    new = F.when(F.size("found") == 0, own).otherwise(new)
    done = found.select("_whole", new.alias("_new"))
    return done.select(*(F.col("_new").alias(c) if c == text else F.col(f"_whole.`{c}`").alias(c) for c in df.columns))
