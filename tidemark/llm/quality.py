"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Each text gets five statistics, transformed so that extremes stay ordered without weighing too much. Per
language and source the minimum covariance determinant estimate of the most central three quarters is
sought: from three starts, concentration steps go on until no group's determinant falls any more, and the
estimate with the smallest determinant counts. A text whose squared Mahalanobis distance to its group's
estimate is beyond a chi-square quantile is rejected. All sums are over integers (statistics in 256ths),
so the estimates and verdicts do not depend on the order of addition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, plain, staged

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Steps of a statistic's unit.
UNIT = 256
#: Standard deviations that a group is taken to have beforehand, and the weight (in texts) of that prior:
#: a small or uniform group does not reject what is ordinary elsewhere.
PRIOR = [1.2, 1.5, 0.1, 0.15, 0.2]
PRIOR_WEIGHT = 30
#: Share of the most central texts, chance by which a normal point would be rejected, and concentration steps at most.
#: The chance is that small as statistics of texts have heavier tails than normal points: at a usual one of 2.5 %
#: (12.8) a tenth of ordinary texts would go.
CENTRAL, CHANCE, STEPS = 0.75, 1e-9, 8
#: Steps of log2(1 + distance) and the largest of them, and groups that a hot language and source is dealt into.
FINE, LAST, SALTS = 32, 1023, 8
P = len(PRIOR)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of its texts (null: no words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.drop(*STATS).withColumn("_t", F.btrim(t, F.lit(" \t\n\x0b\x0c\r")))
    out = out.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", SPACE + "+")))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    at = F.sequence(F.lit(1), F.greatest(F.col("n_words") - 4, F.lit(1)).cast("int"))
    out = out.withColumn("_h", F.when(F.col("n_words") >= 6, F.transform(at, lambda i: F.xxhash64(F.slice("_w", i, 5)))))
    out = out.withColumn("_again", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    # only texts with a window hash that returns: windows in order, those equal to a neighbour, words that they cover
    out = out.withColumn(
        "_g", F.when(F.col("_again"), F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice("_w", i, 5), " ").alias("g"), i.alias("i")))))
    )
    same = lambda x, k: (F.get("_g", k - 1)["g"] == x["g"]) | (F.get("_g", k + 1)["g"] == x["g"])
    out = out.withColumn(
        "_d", F.sort_array(F.transform(F.filter("_g", lambda x, k: F.coalesce(same(x, k), (F.get("_g", k - 1)["g"] == x["g"]), (F.get("_g", k + 1)["g"] == x["g"]), F.lit(False))), lambda x: x["i"]))
    )
    cover = F.transform("_d", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_d", k + 1) - p, F.lit(5))))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = out.withColumn("_l", lines)
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    ).drop("_t", "_w", "_h", "_again", "_g", "_d", "_l")


def chi2(x: float, p: int) -> float:
    """Chi-square distribution function, by its series."""
    term = total = 1 / math.gamma(p / 2 + 1)
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= (x / 2) / (p / 2 + k)
        total += term
    return total * math.exp(-x / 2) * (x / 2) ** (p / 2)


def quantile(share: float, p: int = P) -> float:
    """The chi-square quantile of a share of points, by bisection."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2(mid, p) < share else (lo, mid)
    return lo


def consistency() -> float:
    """By what a central share's covariance is to be scaled to be that of all normal points."""
    return CENTRAL / chi2(quantile(CENTRAL), P + 2)


#: Squared distance beyond which a text is rejected: 50.8 with five statistics.
CUTOFF = quantile(1 - CHANCE)


def distance() -> Column:
    """Squared Mahalanobis distance by forward substitution: x0..x4, centers m0.., Cholesky factor l00, l10, ..."""
    z: list[Column] = []
    for i in range(P):
        r = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            r = r - F.col(f"l{i}{j}") * z[j]
        z.append(r / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def factored(sums: DataFrame, scale: float, *of: str) -> DataFrame:
    """Centers, Cholesky factors and log determinants (of the factor) of groups with n, s0.., s00, s10, .. (counts, sums, sums of products)."""
    n = F.col("n").cast("double")
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(P)})
    cov = {}
    for i in range(P):
        for j in range(i + 1):
            c = (F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"m{j}")) * scale
            prior = (PRIOR[i] * UNIT) ** 2 * PRIOR_WEIGHT if i == j else 0.0
            cov[f"c{i}{j}"] = (c + F.lit(prior)) / (n + PRIOR_WEIGHT)
    out = out.withColumns(cov)
    for i in range(P):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-6))) if i == j else v / F.col(f"l{j}{j}"))
    det = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    return out.select(*of, *ESTIMATE, det.alias("det"))


ESTIMATE = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def estimates(points: DataFrame) -> DataFrame:
    """Center and Cholesky factor of each group g of a stored table of points x0..x4 (longs).

    Starts: median and quartile range of each statistic; mean and covariance of all points; median and the prior
    standard deviations. Each step sums by group and step of distance, takes the steps up to the central share,
    and refits; a group's estimate of the smallest determinant is kept, and steps end when none has become smaller.
    What is summed has at most LAST + 1 rows a group and start.
    """
    names = ["n"] + [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i in range(P) for j in range(i + 1)]
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    quart = points.groupBy("g").agg(*(F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)))

    def diagonal(start: int, width) -> DataFrame:
        return quart.select(
            "g",
            F.lit(start).alias("start"),
            *(F.get(f"q{i}", 1).alias(f"m{i}") for i in range(P)),
            *(width(i).alias(f"l{i}{i}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)),
        )

    wide = diagonal(0, lambda i: F.greatest((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, F.lit(PRIOR[i] * UNIT / 2)))
    prior = diagonal(2, lambda i: F.lit(PRIOR[i] * UNIT))
    mean = factored(points.groupBy("g").agg(*sums), 1.0, "g").select("g", F.lit(1).alias("start"), *ESTIMATE)
    now = staged(wide.unionByName(mean).unionByName(prior), "mcd")
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(P))), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt")
    best = None
    for _ in range(STEPS):
        d = salted.join(now.select("*", salts), ["g", "_salt"])
        d = d.select("g", "start", F.least(F.floor(F.log2(1 + distance()) * FINE), F.lit(LAST)).cast("int").alias("d"), *(f"x{i}" for i in range(P)))
        by = staged(d.groupBy("g", "start", "d").agg(*sums), "mcd-step")  # written, that its rows are not dealt by group alone
        group = Window.partitionBy("g", "start")
        upto = F.sum("n").over(group.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
        central = by.withColumn("_c", F.coalesce(upto, F.lit(0)) < F.sum("n").over(group) * CENTRAL).where("_c")
        now = staged(factored(central.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in names)), consistency(), "g", "start"), "mcd")
        fits = now.select("g", F.struct("det", "start", *ESTIMATE).alias("fit"))
        if best is not None:
            fits = fits.union(best)
        after = staged(fits.groupBy("g").agg(F.min("fit").alias("fit")), "mcd-best")
        if best is not None:
            was = best.select("g", F.col("fit.det").alias("was"))
            if after.join(was, "g").where(F.col("fit.det") < F.col("was") - 1e-6).isEmpty():
                best = after
                break
        best = after
    return best.select("g", *(F.col(f"fit.{c}").alias(c) for c in ESTIMATE))


def rules(df: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """df's other columns plus the statistics, base_failed, distance2 and kept; the text itself is left out.

    A null or wordless text has zero counts and fails the base rule (fewer than ten words, or over a fifth of
    the words in returning windows). A null language or source is a group of its own. Columns of df with
    these names are replaced. Repeated rows are judged alike; an empty table gives no rows.
    """
    own = [*STATS, "base_failed", "distance2", "kept"]
    left_out = own if text in by else [*own, text]
    kept, cols = plain(df, *left_out)
    grouped = [f"c{kept.index(c)}" for c in by]
    s = statistics(df.select(*cols, F.col(text).alias("_text")), "_text").drop("_text")
    n = F.greatest("n_words", F.lit(1)).cast("double")
    # asinh is linear for ordinary values and logarithmic beyond: extremes count, without outweighing all others
    shape = [
        F.log(1 + n),
        10 * F.asinh(F.col("word_chars") / n / 10),
        F.asinh(F.col("n_symbols") / n),
        F.asinh(F.col("n_dup_lines") / n * 10),
        F.col("n_repeat_words") / n,
    ]
    group = F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in grouped)) if by else F.lit("-")
    s = staged(s.withColumn("g", group).withColumns({f"x{i}": F.round(x * UNIT).cast("long") for i, x in enumerate(shape)}), "quality")
    judged = s.join(estimates(s.select("g", *(f"x{i}" for i in range(P)))), "g").withColumn("distance2", distance())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("distance2") <= CUTOFF))
    return judged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *own)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return rules(docs).select("doc_id", *STATS, "base_failed", "kept")
