"""Spans on a stream's time base, in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds are read with so many decimals, and are fewer than MOST; a time base is of whole numbers below 2 ** 31. So no product overflows.
SCALE, MOST = 18, 1e9


def _exact(seconds: str) -> Column:
    """The decimal number that a double shows as, in units of 10 ** -SCALE."""
    return F.replace(F.col(seconds).cast("string").cast(f"decimal(28,{SCALE})").cast("string"), F.lit(".")).cast("decimal(38,0)")


def _divided(units: Column) -> tuple[Column, Column]:
    """Whole ticks of num / den seconds in these units, rounded down, and what is left; units are not negative."""
    whole = "decimal(38,0)"
    a = (units * F.col("den").cast("decimal(10,0)")).cast(whole)
    b = (F.col("num").cast("decimal(10,0)") * F.lit(10**SCALE).cast("decimal(19,0)")).cast(whole)
    return F.call_function("div", a, b), a % b


def canonical(spans: DataFrame) -> DataFrame:
    """Spans (start, end, duration in seconds, origin, num, den) with code, start_pts, end_pts, start_s and end_s.

    The start is rounded down to a tick of num / den seconds and the end up, in whole numbers, as decimals that a double shows as, so that 1001/30000 has no drift; seconds
    are then read off the ticks, the end not beyond the duration. code names the first rule that is broken (null: none), and a broken
    span has no ticks: `number` (null, NaN or MOST and more), `base` (a time base out of its range), `duration` (not positive), `order`
    (not 0 <= start < end), `bounds` (the end beyond the duration), `empty` (nothing is left on the ticks).
    """
    real = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < MOST), F.lit(False))
    code = (
        F.when(~(real("start") & real("end") & real("duration")), "number")
        .when(~F.coalesce(F.col("num").between(1, 2**31 - 1) & F.col("den").between(1, 2**31 - 1), F.lit(False)), "base")
        .when(F.col("duration") <= 0, "duration")
        .when(~((F.col("start") >= 0) & (F.col("start") < F.col("end"))), "order")
        .when(F.col("end") > F.col("duration"), "bounds")
    )
    sound = spans.withColumn("code", code)
    (first, _), (last, rest) = _divided(_exact("start")), _divided(_exact("end"))
    last = F.when(rest == 0, last).otherwise(last + 1)
    sound = sound.withColumn("_a", F.when(F.col("code").isNull(), first)).withColumn("_b", F.when(F.col("code").isNull(), last))
    seconds = lambda c: F.col(c).cast("double") * F.col("num") / F.col("den")
    start, end = seconds("_a"), F.least("duration", seconds("_b"))
    sound = sound.withColumn("start_s", start).withColumn("end_s", F.when(F.col("_b").isNotNull(), end))
    empty = F.col("code").isNull() & ~(F.col("start_s") < F.col("end_s"))
    keep = lambda c: F.when(~empty, c)
    out = sound.withColumns({"code": F.when(empty, "empty").otherwise(F.col("code")), "start_pts": keep(F.col("origin") + F.col("_a")), "end_pts": keep(F.col("origin") + F.col("_b")), "start_s": keep(F.col("start_s")), "end_s": keep(F.col("end_s"))})
    return out.drop("_a", "_b")
