"""Exact quantiles of groups of any size by histograms that are refined pass by pass.

For each group and wanted rank the values between two bounds are counted in
``RANGES`` equal ranges; the range that holds the rank, with the least and
greatest value in it, gives the next bounds, until they are equal. Counts are
combined before the shuffle, so a hot group costs its tasks a table of ranges
and no list of values, and no sketch is involved: the result is a value of the
group, or lies between two neighbouring ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import forget, written

RANGES = 4096
#: Rows of bounds that are broadcast at most; more are joined by shuffle.
BROADCAST_GROUPS = 100_000


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def quantiles(df: DataFrame, keys: list[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, share, n, quantile): linear between neighbouring values, as percentiles usually are. Nulls and NaN do not count; a group without values has no row. Null keys are a group."""
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    at = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    wanted = whole.select(*keys, "n", "lo", "hi", at.alias("share")).withColumn("place", F.col("share") * (F.col("n") - 1))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("place").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("place").alias("rank")))
    state = written(wanted.select(*keys, "n", "share", "place", "lo", "hi", F.inline(ends)).filter("n > 0"), "bounds")
    while (open_ := state.filter("lo < hi")).head(1):
        bounds = open_.select(*keys, "lo", "hi").distinct()
        near = F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds
        inside = rows.alias("r").join(near.alias("b"), _same(keys, "r", "b") & F.col("_v").between(F.col("lo"), F.col("hi")))
        lo, hi, x = (F.col(c) for c in ("lo", "hi", "_v"))
        # halved where the width is not finite; the range of a value never falls as the value grows
        place = F.coalesce(F.when(hi - lo == float("inf"), F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)), F.try_divide(x - lo, hi - lo))
        counted = inside.select(*(F.col(f"b.{k}").alias(k) for k in keys), "lo", "hi", "_v", F.least(F.floor(place * RANGES), F.lit(RANGES - 1)).alias("range"))
        counted = counted.groupBy(*keys, "lo", "hi", "range").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
        counted = counted.withColumn("before", before)  # at most RANGES rows for each pair of bounds
        here = _same([*keys, "lo", "hi"], "s", "c") & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
        found = state.alias("s").join(counted.alias("c"), here, "left")
        closer = F.col("s.lo") < F.col("s.hi")
        pick = lambda new, old: F.when(closer, new).otherwise(old)
        moved = found.select(*(F.col(f"s.{k}").alias(k) for k in keys), "n", "share", "place", pick(F.col("low"), F.col("s.lo")).alias("lo"), pick(F.col("high"), F.col("s.hi")).alias("hi"), "end", pick(F.col("rank") - F.col("before"), F.col("rank")).alias("rank"))
        last, state = state, written(moved, "bounds")
        forget(last)
    below, above = F.max(F.when(F.col("end") == 0, F.col("lo"))), F.max(F.when(F.col("end") == 1, F.col("lo")))
    part = F.col("place") - F.floor("place")
    value_at = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(F.col("below") * (1 - part) + F.col("above") * part)
    both = state.groupBy(*keys, "share").agg(F.max("n").alias("n"), F.max("place").alias("place"), below.alias("below"), above.alias("above"))
    return both.select(*keys, "share", "n", value_at.alias("quantile"))
