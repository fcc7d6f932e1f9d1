"""Spectra of daily series: Welch periodograms, red-noise background, bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_quantile


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(y: np.ndarray, segment: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, one-sided density), mean over Hann-windowed segments, no detrending within them."""
    segment = min(segment, len(y))
    step = segment - min(overlap, segment // 2)
    w = hann(segment)
    starts = np.arange(0, len(y) - segment + 1, step)
    p = np.mean([np.abs(np.fft.rfft(y[s : s + segment] * w)) ** 2 for s in starts], axis=0) / (w @ w)
    p[1 : (segment + 1) // 2] *= 2
    return np.fft.rfftfreq(segment), p


def effective_dof(segment: int, step: int, n: int) -> float:
    """Degrees of freedom of a mean over overlapping segments: fewer the more the window overlaps itself."""
    segments = 1 + (n - segment) // step
    power = np.abs(np.fft.rfft(hann(segment), 2 * segment)) ** 2
    overlap = np.fft.irfft(power)[:segment]
    shift = np.arange(1, min(segments, -(-segment // step)))
    shared = (overlap[shift * step] / overlap[0]) ** 2
    return 2 * segments / (1 + 2 * float(shared @ (1 - shift / segments)))


def red_noise(f: np.ndarray, variance: float, lag1: float) -> np.ndarray:
    """First-order autoregressive spectrum with the given integral."""
    shape = (1 - lag1**2) / (1 + lag1**2 - 2 * lag1 * np.cos(2 * np.pi * f))
    return shape * variance / np.trapezoid(shape, f)


def series_statistics(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(days, statistics) of daily series (keys, date, value): (keys, t, residual) from the first day on, and (keys, n, variance, lag1) of the residuals of the line.

    The line comes from moments, the correlation from each day and the next by a
    join, so no series is gathered. Rows without a date or value are left out;
    then a series must have every day of its span once, or it is an error.
    Series of fewer than 8 days give no rows.
    """
    day = F.unix_date("date")
    s = df.filter(F.col("date").isNotNull() & F.col("value").isNotNull()).select(*keys, day.alias("_day"), F.col("value").cast("double").alias("_value"))
    fit = s.groupBy(*keys).agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"), F.count(F.lit(1)).alias("n"), F.regr_slope("_value", "_day").alias("_slope"), F.regr_intercept("_value", "_day").alias("_intercept")).filter("n >= 8")
    whole = F.when(F.col("_last") - F.col("_first") + 1 == F.col("n"), F.col("_day") - F.col("_first")).otherwise(F.raise_error(F.lit("a series lacks days or repeats some")).cast("int"))
    z = s.join(fit, keys).select(*keys, "n", whole.alias("t"), (F.col("_value") - F.col("_slope") * F.col("_day") - F.col("_intercept")).alias("residual"))
    after = z.select(*keys, (F.col("t") - 1).alias("t"), F.col("residual").alias("_next"))
    both = z.join(after, [*keys, "t"], "left").groupBy(*keys).agg(F.first("n").alias("n"), F.var_samp("residual").alias("variance"), F.corr("residual", "_next").alias("r"), F.count_distinct("t").alias("_days"))
    once = F.when(F.col("_days") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a series repeats days")).cast("long"))
    return z, both.select(*keys, once.cast("int").alias("n"), "variance", F.least(F.greatest("r", F.lit(-0.99)), F.lit(0.99)).alias("lag1"))


def _segments(statistics: DataFrame, segment: int, overlap: int, level: float) -> DataFrame:
    """A row for each series with its segments' length and step and the level of significance in units of the background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = np.minimum(b["n"], segment)
            step = length - np.minimum(overlap, length // 2)
            dof = [effective_dof(int(m), int(d), int(n)) for m, d, n in zip(length, step, b["n"])]
            yield b.assign(length=length, step=step, dof=dof, sure=[chi2_quantile(level, d) / d for d in dof])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in statistics.schema)
    return statistics.mapInPandas(run, f"{fields}, length int, step int, dof double, sure double")


def welch_spectrum(df: DataFrame, keys: list[str], segment: int = 2920, overlap: int = 1460, level: float = 0.95) -> DataFrame:
    """(keys, k, frequency, period_days, psd, background, sig95) of daily series (keys, date, value), linear trend removed.

    Each day goes to the segments that it lies in, each segment is transformed
    where its days meet, and densities are averaged over segments: a group holds
    one segment, whatever the length of a series. Background: first-order
    autoregressive with the series' variance and correlation.
    """
    return spectrum_of(*series_statistics(df, keys), keys, segment, overlap, level)


def spectrum_of(days: DataFrame, statistics: DataFrame, keys: list[str], segment: int = 2920, overlap: int = 1460, level: float = 0.95) -> DataFrame:
    """``welch_spectrum`` from what ``series_statistics`` gives."""
    own = _segments(statistics, segment, overlap, level)
    t, length, step = F.col("t"), F.col("length"), F.col("step")
    last = F.least(F.floor(t / step), F.floor((F.col("n") - length) / step))
    dealt = days.drop("n").join(own.select(*keys, "n", "length", "step"), keys).withColumn("_segment", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((t - length + 1) / step)), last)))
    dealt = dealt.filter(F.col("_segment").between(F.ceil((t - length + 1) / step), last))
    kinds = [f"`{k}` {days.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        length = int(group["length"].iloc[0])
        z = np.zeros(length)
        z[group["t"].to_numpy() - int(key[-1]) * int(group["step"].iloc[0])] = group["residual"].to_numpy()
        return pd.DataFrame([dict(zip(keys, key)) | {"power": np.abs(np.fft.rfft(z * hann(length))) ** 2}])

    powers = dealt.select(*keys, "_segment", "t", "residual", "length", "step").groupBy(*keys, "_segment").applyInPandas(run, ", ".join([*kinds, "power array<double>"]))
    mean = powers.select(*keys, F.posexplode("power").alias("k", "p")).filter("k > 0").groupBy(*keys, "k").agg(F.avg("p").alias("p"))
    out = mean.join(own, keys)
    k, r = F.col("k"), F.col("lag1")
    sides = F.when(k < F.floor((length + 1) / 2), 2.0).otherwise(1.0)
    shape = lambda at: (1 - r * r) / (1 + r * r - 2 * r * F.cos(at / F.col("length") * (2 * np.pi)))
    top = F.floor(length / 2).cast("int")
    area = F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda s, at: s + shape(at) * F.when((at == 1) | (at == top), 0.5).otherwise(1.0)) / length
    background = shape(k) * F.col("variance") / area
    return out.select(*keys, "k", (k / length).alias("frequency"), (length / k).alias("period_days"), (F.col("p") * sides / (length * 0.375)).alias("psd"), background.alias("background"), (background * F.col("sure")).alias("sig95"))


def welch_summary(df: DataFrame, keys: list[str], segment: int = 2920, overlap: int = 1460) -> DataFrame:
    """(keys, n_days, lag1, welch_segment_days, overlap_days, effective_welch_dof, dominant_period_days, detrended_variance) of each series."""
    days, statistics = series_statistics(df, keys)
    own = _segments(statistics, segment, overlap, 0.95)
    top = dominant_period(spectrum_of(days, statistics, keys, segment, overlap), keys)
    return own.join(top, keys).select(*keys, F.col("n").alias("n_days"), "lag1", F.col("length").alias("welch_segment_days"), (F.col("length") - F.col("step")).alias("overlap_days"), F.col("dof").alias("effective_welch_dof"), "dominant_period_days", F.col("variance").alias("detrended_variance"))


def dominant_period(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    return spectrum.groupBy(*keys).agg(F.max_by("period_days", F.struct("psd", -F.col("k"))).alias("dominant_period_days"))


def band_variance(spectrum: DataFrame, variance: DataFrame, keys: list[str], bands: list[tuple[str, float, float]]) -> DataFrame:
    """(keys, band, periods, n_frequencies, integrated_variance, fraction_of_detrended_variance_pct); ends included, null where a band is empty.

    ``variance`` (keys, variance) is that of the detrended series; bands may overlap.
    """
    w = Window.partitionBy(*keys).orderBy("k")
    after, before = F.lead("frequency").over(w), F.lag("frequency").over(w)
    f = F.col("frequency")
    width = F.coalesce((after - before) / 2, after - f, f - before)
    b = spectrum.sparkSession.createDataFrame(bands, "band string, minimum_period_days double, maximum_period_days double")
    inside = F.col("frequency").between(1 / F.col("maximum_period_days"), 1 / F.col("minimum_period_days"))
    every = variance.crossJoin(F.broadcast(b))  # a handful of bands for each series
    part = spectrum.withColumn("width", width).join(F.broadcast(b), inside).groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n_frequencies"), F.sum(F.col("psd") * F.col("width")).alias("integrated_variance"))
    out = every.join(part, [*keys, "band"], "left")
    return out.select(*keys, "band", "minimum_period_days", "maximum_period_days", F.coalesce("n_frequencies", F.lit(0)).alias("n_frequencies"), "integrated_variance", (F.try_divide("integrated_variance", "variance") * 100).alias("fraction_of_detrended_variance_pct"))
