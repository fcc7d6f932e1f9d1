"""Daily series on a calendar: spines, gaps, complete years, annual and monthly summaries, rolling means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_series(df: DataFrame, date: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, date, value): sums by day."""
    return df.groupBy(*(keys or []), F.col(date).cast("date").alias("date")).agg(F.sum(value).alias("value"))


def spine(df: DataFrame) -> DataFrame:
    """Every day from the first to the last date."""
    return df.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))


def gaps(df: DataFrame) -> DataFrame:
    """Days of the spine without a row."""
    return spine(df).join(df.select("date").distinct(), "date", "left_anti")


def filled(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The series on the spine of all keys together, 0 where a day is missing."""
    if not keys:
        return spine(df).join(df, "date", "left").select("date", F.coalesce("value", F.lit(0.0)).alias("value"))
    ends = df.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))  # one row
    days = df.select(*keys).distinct().crossJoin(F.broadcast(ends)).select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.join(df, [*keys, "date"], "left").select(*keys, "date", F.coalesce("value", F.lit(0.0)).alias("value"))


def complete_years(df: DataFrame) -> DataFrame:
    """(year, n_days, complete): whether a year has all its 365 or 366 days."""
    leap = F.dayofmonth(F.last_day(F.make_date("year", F.lit(2), F.lit(1)))) == 29
    n = df.groupBy(F.year("date").alias("year")).agg(F.count_distinct("date").alias("n_days"))
    return n.select("year", "n_days", (F.col("n_days") == F.when(leap, 366).otherwise(365)).alias("complete"))


def annual_means(df: DataFrame) -> DataFrame:
    """(year, mean, n_days) of complete years."""
    leap = F.dayofmonth(F.last_day(F.make_date("year", F.lit(2), F.lit(1)))) == 29
    n = df.groupBy(F.year("date").alias("year")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_days"))
    return n.filter(F.col("n_days") == F.when(leap, 366).otherwise(365))


def monthly_climatology(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of each calendar month over all years."""
    return df.groupBy(F.month("date").alias("month")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n_days"))


def annual_metrics(df: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, year, metrics, n_days, date): means of daily values over the complete years, dated at mid-year. Ratios are averaged as they are, day by day."""
    leap = F.dayofmonth(F.last_day(F.make_date("year", F.lit(2), F.lit(1)))) == 29
    n = df.groupBy(*keys, F.year("date").alias("year")).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n_days"))
    return n.filter(F.col("n_days") == F.when(leap, 366).otherwise(365)).withColumn("date", F.make_date("year", F.lit(7), F.lit(1)))


def monthly_metrics(df: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, month, mean and sample deviation of each metric) over all years, incomplete ones too."""
    return df.groupBy(*keys, F.month("date").alias("month")).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


#: Days of a series that are averaged in one group; those near its ends go to the next one too.
BLOCK_DAYS = 2048


def centred_means(df: DataFrame, keys: list[str], metrics: Sequence[str], half: int = 182, least: int = 183) -> DataFrame:
    """``df`` with a column ``<metric>_rolling`` for each metric: the mean over the days around each day, null where fewer than ``least`` have a value.

    The window is of days, not rows, so a day that is missing takes no other's
    place. A series is dealt in blocks of days, each with a halo of ``half``
    days on either side, so a long one is no group of its own. All metrics
    share one sort. A row without a date keeps a null.
    """
    day, size = F.unix_date("date"), max(BLOCK_DAYS, 2 * half)
    block = lambda at: F.floor(at / size)
    rows = df.withColumn("_own", block(day)).withColumn("_block", F.explode_outer(F.sequence(block(day - half), block(day + half))))
    w = Window.partitionBy(*keys, "_block").orderBy(day).rangeBetween(-half, half)
    dated = F.col("date").isNotNull()
    out = rows.withColumns({f"{m}_rolling": F.when(dated & (F.count(m).over(w) >= least), F.avg(m).over(w)) for m in metrics})
    return out.filter(F.col("_own").eqNullSafe(F.col("_block"))).drop("_own", "_block")


def centred_mean(df: DataFrame, half: int = 182, least: int = 183, keys: list[str] | None = None) -> DataFrame:
    """The daily series (keys, date, value) with the mean of the days around each day as ``rolling_mean``."""
    return centred_means(df, keys or [], ["value"], half, least).withColumnRenamed("value_rolling", "rolling_mean")
