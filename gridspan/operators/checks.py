"""Checks that gate a release; each is a small aggregate that gives (test, value, tolerance, pass) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` itself, or an error that names the columns it lacks."""
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def record_check(df: DataFrame, keys: list[str], start: str | None = None, end: str | None = None, values: list[str] | None = None) -> DataFrame:
    """(keys, n_expected, n_missing, n_outside, n_repeated, n_null, complete) of a daily record by key.

    The span is given or runs from the first to the last date of all keys.
    """
    every = df.agg(F.min("date").alias("a"), F.max("date").alias("b")) if start is None or end is None else None
    span = df.sparkSession.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b")) if every is None else every
    null = F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in [*values, values[0]])) == 1) if values else F.lit(0).cast("long")
    inside = F.col("date").between(F.col("a"), F.col("b"))
    got = df.crossJoin(F.broadcast(span)).groupBy(*keys).agg(  # one row of bounds
        F.max(F.date_diff("b", "a") + 1).alias("n_expected"), F.count_distinct(F.when(inside, F.col("date"))).alias("n_days"), F.count_if(~inside | F.col("date").isNull()).alias("n_outside"), F.count_if(inside).alias("n_rows"), null.alias("n_null")
    )
    out = got.select(*keys, "n_expected", (F.col("n_expected") - F.col("n_days")).alias("n_missing"), "n_outside", (F.col("n_rows") - F.col("n_days")).alias("n_repeated"), "n_null")
    return out.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_outside") == 0) & (F.col("n_repeated") == 0) & (F.col("n_null") == 0))


def null_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, field, n_rows, n_null): nulls of each column by key, NaN among them, in one pass."""
    kinds = dict(df.dtypes)
    null = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(null(c)).alias(f"_{k}") for k, c in enumerate(columns)))
    return got.select(*keys, "n_rows", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_{k}").alias("n_null")) for k, c in enumerate(columns))))).select(*keys, "field", "n_rows", "n_null")


def grid_check(grid: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """(test, value, tolerance, pass): axes strictly ascending, every cell once, areas positive."""

    def descents(i: str, x: str) -> DataFrame:
        axis = grid.groupBy(i).agg(F.min(x).alias("x"), (F.max(x) - F.min(x)).alias("spread"))  # the short axis of a grid
        step = axis.withColumn("step", F.col("x") - F.lag("x").over(Window.orderBy(i)))
        return step.agg(F.count_if((F.col("step") <= 0) | (F.col("spread") > 1e-8)).cast("double").alias("value")).select(F.lit(f"{x}_ascending").alias("test"), "value")

    cells = grid.agg(F.abs(F.count_distinct("cell_id") - n_lat * n_lon).cast("double").alias("value")).select(F.lit("cells_present").alias("test"), "value")
    area = grid.agg(F.count_if(~(F.col("area_km2") > 0) | F.col("area_km2").isNull()).cast("double").alias("value")).select(F.lit("areas_positive").alias("test"), "value")
    out = descents("i", "lat").unionByName(descents("j", "lon")).unionByName(cells).unionByName(area)
    return out.select("test", "value", F.lit(0.0).alias("tolerance"), (F.col("value") <= 0).alias("pass"))


def reconcile(left: DataFrame, right: DataFrame, on: list[str], column: str, test: str, atol: float, rtol: float = 0.0) -> DataFrame:
    """(test, value, tolerance, pass): largest difference of ``column`` of two tables with equal, unique keys.

    A key on one side alone, or twice on a side, fails the test.
    """
    one = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max(column).alias(name))
    j = one(left, "a").join(one(right, "b"), on, "full")
    odd: Column = F.count_if((F.coalesce("n_a", F.lit(0)) != 1) | (F.coalesce("n_b", F.lit(0)) != 1))
    got = j.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("value"), (F.lit(atol) + F.lit(rtol) * F.coalesce(F.max(F.abs("b")), F.lit(0.0))).alias("tolerance"), odd.alias("odd"))
    return got.select(F.lit(test).alias("test"), "value", "tolerance", ((F.col("value") <= F.col("tolerance")) & (F.col("odd") == 0)).alias("pass"))


def require_passed(qc: DataFrame) -> DataFrame:
    """``qc`` itself, or an error that names the tests that failed."""
    failed = sorted(r["test"] for r in qc.filter(~F.coalesce("pass", F.lit(False))).select("test").collect())  # a row a test
    if failed:
        raise RuntimeError(f"checks failed: {', '.join(failed)}")
    return qc


def release_checks(daily: DataFrame, reference: DataFrame, internal: float = 1e-4, external: float = 0.01, relative: float = 1e-11) -> DataFrame:
    """(test, value, tolerance, pass): the five tests of a release.

    ``daily`` has a row a date with the areas of the four definitions and
    ``reference`` (date, total_area_km2, largest_component_area_km2) comes from
    another program. A date of ``daily`` that the reference lacks, or has twice,
    fails both comparisons.
    """
    one = reference.groupBy("date").agg(F.count(F.lit(1)).alias("times"), F.max("total_area_km2").alias("total"), F.max("largest_component_area_km2").alias("top"))
    j = daily.join(one, "date", "left")
    odd = F.count_if(F.coalesce("times", F.lit(0)) != 1)
    apart = lambda a, b: F.max(F.abs(F.col(a) - F.col(b)))
    within = lambda a, b: F.lit(external) + F.lit(relative) * F.max(F.greatest(F.abs(a), F.abs(b)))
    above = lambda a, b: F.greatest(F.max(F.col(a) - F.col(b)), F.lit(0.0))
    row = j.agg(
        (F.date_diff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date")).cast("double").alias("v0"), above("lcc_area_km2", "canonical_area_km2").alias("v1"), above("box_strict_area_km2", "box_inclusive_area_km2").alias("v2"),
        apart("canonical_area_km2", "total").alias("v3"), apart("lcc_area_km2", "top").alias("v4"), within("canonical_area_km2", "total").alias("t3"), within("lcc_area_km2", "top").alias("t4"), odd.alias("odd"),
    )
    tests = (("daily_record_complete", F.lit(0.0)), ("lcc_within_canonical", F.lit(internal)), ("strict_within_inclusive", F.lit(internal)), ("canonical_area_vs_reference", F.col("t3")), ("lcc_area_vs_reference", F.col("t4")))
    rows = [F.struct(F.lit(name).alias("test"), F.col(f"v{k}").alias("value"), t.alias("tolerance"), (F.coalesce(F.col(f"v{k}") <= t, F.lit(False)) & ((F.col("odd") == 0) | F.lit(k < 3))).alias("pass")) for k, (name, t) in enumerate(tests)]
    return row.select(F.inline(F.array(*rows)))


def grids_agree(left: DataFrame, right: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(test, value, tolerance, pass): whether two grids (cell_id, lat, lon, in_mask) have the same cells, mask and coordinates."""
    c = ("lat", "lon", "in_mask")
    side = lambda g, n: g.select("cell_id", *(F.col(x).alias(f"{x}_{n}") for x in c), F.lit(True).alias(n))
    j = side(left, "a").join(side(right, "b"), "cell_id", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    row = j.agg(
        F.count_if(~both).cast("double").alias("cells_on_both_sides"), F.count_if(both & ~F.col("in_mask_a").eqNullSafe(F.col("in_mask_b"))).cast("double").alias("mask_equal"),
        *(F.max(F.abs(F.col(f"{x}_a") - F.col(f"{x}_b"))).alias(f"{x}_equal") for x in ("lat", "lon")),
    )
    tests = (("cells_on_both_sides", 0.0), ("mask_equal", 0.0), ("lat_equal", tolerance), ("lon_equal", tolerance))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("test"), F.col(n).alias("value"), F.lit(t).alias("tolerance"), F.coalesce(F.col(n) <= t, F.lit(False)).alias("pass")) for n, t in tests))))


def thresholds_present(df: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold_c, n_rows, present) of each expected threshold."""
    want = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold_c double")
    n = df.groupBy("threshold_c").agg(F.count(F.lit(1)).alias("n_rows"))
    return want.join(n, "threshold_c", "left").select("threshold_c", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.col("n_rows").isNotNull().alias("present"))


def require_thresholds(df: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """``df`` itself, or an error that names the thresholds it lacks."""
    lacking = [r["threshold_c"] for r in thresholds_present(df, thresholds).filter("not present").collect()]  # a row a threshold
    if lacking:
        raise ValueError("no rows at " + ", ".join(f"{t:g}" for t in sorted(lacking)))
    return df


def with_default(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``df`` with ``column``, which is ``value`` only where the table has no such column."""
    return df if column in df.columns else df.withColumn(column, value)
