"""Continuous Morlet transform of daily series: power, cone of influence, significance, bands.

A series goes to several groups, each for a block of scales, so that one long
series is worked on by many tasks. A scale is one row with an array of powers;
bands are then ordinary aggregates over those arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_quantile

OMEGA = 6.0
FIRST_SCALE, PER_OCTAVE = 2.0, 12
#: Period of a scale of one.
LAMBDA = 4 * math.pi / (OMEGA + math.sqrt(2 + OMEGA**2))
BLOCK = 8


def scales_of(n: int) -> np.ndarray:
    """Scales from two days, twelve an octave, up to the series' length."""
    return FIRST_SCALE * 2.0 ** (np.arange(int(math.floor(math.log2(n / FIRST_SCALE) * PER_OCTAVE)) + 1) / PER_OCTAVE)


def morlet(z: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Coefficients (scale, time) by the convolution theorem, padded with zeros to a power of two."""
    size = 1 << max(1, (len(z) - 1).bit_length())
    w = 2 * np.pi * np.fft.fftfreq(size)
    f = np.fft.fft(z, size)
    out = np.empty((len(scales), len(z)), complex)
    for k, s in enumerate(scales):
        psi = np.sqrt(2 * np.pi * s) * np.pi**-0.25 * np.exp(-0.5 * (s * w - OMEGA) ** 2) * (w > 0)
        out[k] = np.fft.ifft(f * psi)[: len(z)]
    return out


def cone(n: int) -> np.ndarray:
    """The longest period that the ends do not touch, at every place."""
    return LAMBDA / math.sqrt(2) * (n / 2 - np.abs(np.arange(n) - (n - 1) / 2))


def red_spectrum(period: np.ndarray, lag1: float) -> np.ndarray:
    return (1 - lag1**2) / (1 + lag1**2 - 2 * lag1 * np.cos(2 * np.pi / period))


def wavelet_power(df: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """(keys, k, scale, period_days, n, lag1, sig95, global_power, global_sig95, power): a row a scale, powers by day.

    Series (keys, date, value) lose their linear trend and are divided by their
    sample deviation. Series of fewer than 16 days or without variance give no
    rows. ``global_sig95`` allows for the time that a scale averages over.
    """
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    names = [*keys, "k", "scale", "period_days", "n", "lag1", "sig95", "global_power", "global_sig95", "power"]
    two = chi2_quantile(level, 2.0) / 2

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        *own, block = key
        y = group.dropna(subset=["date", "value"]).sort_values("date")["value"].to_numpy(float)
        n = len(y)
        lo = int(block) * BLOCK
        scales = scales_of(n)[lo : lo + BLOCK] if n >= 16 else np.zeros(0)
        if not len(scales):
            return pd.DataFrame(columns=names)
        x = np.arange(n)
        z = y - np.polyval(np.polyfit(x, y, 1), x)
        if not z.std() > 1e-12 * (1 + np.abs(y).max()):
            return pd.DataFrame(columns=names)
        z = z / z.std(ddof=1)
        r = float(np.clip(np.corrcoef(z[:-1], z[1:])[0, 1], -0.99, 0.99))
        power, period = np.abs(morlet(z, scales)) ** 2, LAMBDA * scales
        back = red_spectrum(period, r)
        dof = np.maximum(2 * np.sqrt(1 + (np.maximum(n - scales, 1) / (2.32 * scales)) ** 2), 2)
        out = pd.DataFrame({"k": np.arange(lo, lo + len(scales)), "scale": scales, "period_days": period, "n": n, "lag1": r, "sig95": back * two, "global_power": power.mean(axis=1), "global_sig95": [b * chi2_quantile(level, d) / d for b, d in zip(back, dof)], "power": list(power)})
        for name, v in zip(keys, own):
            out.insert(0, name, v)
        return out[names]

    per = F.ceil((F.floor(F.log2(F.col("n") / FIRST_SCALE) * PER_OCTAVE) + 1) / BLOCK).cast("int")
    sizes = df.groupBy(*keys).agg(F.count("value").alias("n")).filter("n >= 16").select(*keys, F.explode(F.sequence(F.lit(0), per - 1)).alias("block"))
    spread = df.select(*keys, "date", F.col("value").cast("double")).join(sizes, keys)
    return spread.groupBy(*keys, "block").applyInPandas(run, ", ".join([*kinds, "k int, scale double, period_days double, n int, lag1 double, sig95 double, global_power double, global_sig95 double, power array<double>"]))


def coefficients(power: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, period_days, t, power, ratio, inside): long form; ``inside`` the cone of influence, ratio to the level of significance."""
    long = power.select(*keys, "k", "period_days", "n", "sig95", F.posexplode("power").alias("t", "power"))
    coi = (F.col("n") / 2 - F.abs(F.col("t") - (F.col("n") - 1) / 2)) * (LAMBDA / math.sqrt(2))
    return long.select(*keys, "k", "period_days", "t", "power", (F.col("power") / F.col("sig95")).alias("ratio"), (F.col("period_days") <= coi).alias("inside"))


def wavelet_bands(power: DataFrame, keys: list[str], bands: list[tuple[str, float, float]]) -> DataFrame:
    """(keys, band, periods, valid_coefficients, valid_fraction_pct, mean_normalized_power_inside_coi, significant_fraction_inside_coi_pct); bands may overlap."""
    b = power.sparkSession.createDataFrame(bands, "band string, minimum_period_days double, maximum_period_days double")
    near = power.join(F.broadcast(b), F.col("period_days").between(F.col("minimum_period_days"), F.col("maximum_period_days")))
    own = [*keys, "band", "minimum_period_days", "maximum_period_days"]
    c = coefficients(near, own)
    return c.groupBy(*own).agg(
        F.count_if("inside").alias("valid_coefficients"),
        (F.avg(F.col("inside").cast("double")) * 100).alias("valid_fraction_pct"),
        F.avg(F.when(F.col("inside"), F.col("power"))).alias("mean_normalized_power_inside_coi"),
        (F.avg(F.when(F.col("inside"), (F.col("ratio") >= 1).cast("double"))) * 100).alias("significant_fraction_inside_coi_pct"),
    )
