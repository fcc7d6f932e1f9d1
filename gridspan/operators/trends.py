"""Trends of series: Theil-Sen, autocorrelation, effective sample size, Newey-West."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile, t_two_sided
from .slopes import Slopes

#: Upper 2.5 % point of the normal distribution.
Z95 = 1.959963984540054
_LINE = {"n": "long", "slope": "double", "intercept": "double", "joint_intercept": "double", "low": "double", "high": "double"}


def _tied(v: np.ndarray) -> int:
    k = np.unique(v, return_counts=True)[1].astype(object)
    return int((k * (k - 1) * (2 * k + 5)).sum())


def line_statistics(x: np.ndarray, y: np.ndarray, z: float = Z95) -> dict[str, float] | None:
    """The median slope of all pairs of points with both intercept rules, and the slopes at the ranks that Kendall's variance, with ties, gives. None where all x are equal."""
    s, n = Slopes(x, y), len(x)
    if not s.pairs:
        return None
    slope = s.median()
    half = z * math.sqrt((n * (n - 1) * (2 * n + 5) - _tied(x) - _tied(y)) / 18)
    low, high = max(round((s.pairs - half) / 2), 1) - 1, min(round((s.pairs + half) / 2), s.pairs - 1)
    return {"n": n, "slope": slope, "intercept": float(np.median(y) - slope * np.median(x)), "joint_intercept": float(np.median(y - slope * x)), "low": s.at_rank(low), "high": s.at_rank(high)}


def lines(df: DataFrame, keys: list[str], z: float = Z95) -> DataFrame:
    """(keys, n, slope, intercept, joint_intercept, low, high) of each series (keys, x, y), exact at any length: slopes are selected by rank and no pairs are written. Points with a null are left out."""
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.dropna(subset=["x", "y"])
        found = line_statistics(g["x"].to_numpy(float), g["y"].to_numpy(float), z)
        return pd.DataFrame([dict(zip(keys, key)) | found] if found else [], columns=[*keys, *_LINE])

    return df.select(*keys, F.col("x").cast("double"), F.col("y").cast("double")).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, *(f"{k} {v}" for k, v in _LINE.items())]))


def theil_sen(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, slope, intercept, joint_intercept): both intercept rules, medians apart and median of residuals."""
    return lines(df, keys).select(*keys, "n", "slope", "intercept", "joint_intercept")


def theil_sen_interval(df: DataFrame, keys: list[str], z: float = Z95) -> DataFrame:
    """(keys, n, slope, low, high): the median slope and its interval."""
    return lines(df, keys, z).select(*keys, "n", "slope", "low", "high")


def lag1(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Correlation of a series with itself one row earlier, clipped to 0.99."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.withColumn("before", F.lag(value).over(w)).groupBy(*keys).agg(F.corr(value, "before").alias("r"))
    return r.select(*keys, F.least(F.greatest("r", F.lit(-0.99)), F.lit(0.99)).alias("lag1"))


def detrended(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, residual) after the least-squares line is removed."""
    fit = df.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return df.join(fit, keys).select(*keys, "x", "y", (F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")).alias("residual"))


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Unbiased autocorrelation by the Fourier transform."""
    z, n = x - x.mean(), len(x)
    power = np.abs(np.fft.rfft(z, 2 * n)) ** 2
    c = np.fft.irfft(power, 2 * n)[:n] / np.arange(n, 0, -1)
    return c / c[0] if c[0] else np.zeros(n)


def effective_sample_size(x: np.ndarray) -> float:
    """n / (1 + 2 s), s the weighted autocorrelations summed in whole pairs up to the first pair that is not positive."""
    n = len(x)
    rho, s = autocorrelation(x), 0.0
    weight = 1 - np.arange(n) / n
    for k in range(1, n - 1, 2):  # whole pairs
        pair = slice(k, k + 2)
        if rho[pair].sum() <= 0:
            break
        s += float((weight[pair] * rho[pair]).sum())
    return float(np.clip(n / (1 + 2 * s), 3, n))


def _by_series(df: DataFrame, keys: list[str], fields: dict[str, str], rows) -> DataFrame:
    """``rows(values in order of x)`` of each series (keys, x, y)."""
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(rows(group.dropna(subset=["x", "y"]).sort_values("x")["y"].to_numpy(float)))
        for name, v in zip(keys, key):
            out[name] = v
        return out.reindex(columns=[*keys, *fields])

    return df.select(*keys, F.col("x").cast("double"), F.col("y").cast("double")).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, *(f"{k} {v}" for k, v in fields.items())]))


def autocorrelations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, rho): unbiased autocorrelation of each series at every lag."""
    return _by_series(df, keys, {"lag": "int", "rho": "double"}, lambda y: {"lag": np.arange(len(y)), "rho": autocorrelation(y) if len(y) else y})


def effective_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, effective_sample_size, df) of each series."""

    def rows(y: np.ndarray) -> dict:
        neff = effective_sample_size(y) if len(y) else float("nan")
        return {"n": [len(y)], "effective_sample_size": [neff], "df": [max(neff - 2, 1.0)]}

    return _by_series(df, keys, {"n": "int", "effective_sample_size": "double", "df": "double"}, rows)


def hac_statistics(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Least squares with a Bartlett-weighted covariance, and inference with the effective degrees of freedom."""
    n = len(x)
    design = np.stack([np.ones(n), x - x.mean()], axis=1)
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    lags = max(1, math.floor(4 * (n / 100) ** (2 / 9)))
    u = design * e[:, None]
    middle = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        middle += (1 - k / (lags + 1)) * (g + g.T)
    cov = inverse @ middle @ inverse * n / (n - 2)
    se = float(np.sqrt(cov[1, 1]))
    neff = effective_sample_size(e)
    df = max(neff - 2, 1.0)
    t = float(beta[1]) / se if se else float("nan")
    half = t_quantile(0.975, df) * se
    return {"n": n, "slope": float(beta[1]), "se": se, "maxlags": lags, "effective_sample_size": neff, "df": df, "t": t, "p": t_two_sided(t, df) if se else float("nan"), "low": float(beta[1]) - half, "high": float(beta[1]) + half}


def hac_trend(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newey-West trend of each series (keys, x, y); series are short by nature, so a group fits in memory."""
    fields = {"n": "int", "slope": "double", "se": "double", "maxlags": "int", "effective_sample_size": "double", "df": "double", "t": "double", "p": "double", "low": "double", "high": "double"}

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.dropna(subset=["x", "y"]).sort_values("x")
        if len(g) < 3:
            return pd.DataFrame(columns=[*keys, *fields])
        return pd.DataFrame([{**dict(zip(keys, key)), **hac_statistics(g["x"].to_numpy(float), g["y"].to_numpy(float))}])

    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    return df.select(*keys, F.col("x").cast("double"), F.col("y").cast("double")).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, *(f"{k} {v}" for k, v in fields.items())]))


_TREND = {
    "n": "int", "mean": "double", "theil_sen_slope": "double", "low": "double", "high": "double", "intercept": "double", "effective_sample_size_residual": "double", "effective_degrees_of_freedom": "double",
    "hac_maxlags": "int", "hac_slope": "double", "hac_se": "double", "hac_t": "double", "relative_slope_pct": "double", "hac_low": "double", "hac_high": "double", "hac_p": "double",
}


def trend_statistics(x: np.ndarray, y: np.ndarray, scale: float) -> dict[str, float] | None:
    """What ``trend_table`` says of a series in order of x; None below three points or where all x are equal."""
    line = line_statistics(x, y) if len(x) >= 3 else None
    if line is None:
        return None
    hac = hac_statistics(x, y)
    size = effective_sample_size(y - line["intercept"] - line["slope"] * x)
    df, slope, se, mean = max(size - 2, 1.0), scale * hac["slope"], scale * hac["se"], float(np.mean(y))
    half = t_quantile(0.975, df) * se
    own = {"n": len(x), "mean": mean, "theil_sen_slope": scale * line["slope"], "low": scale * line["low"], "high": scale * line["high"], "intercept": line["intercept"], "effective_sample_size_residual": size, "effective_degrees_of_freedom": df}
    return own | {"hac_maxlags": hac["maxlags"], "hac_slope": slope, "hac_se": se, "hac_t": hac["t"], "relative_slope_pct": 100 * scale * line["slope"] / mean if mean else None, "hac_low": slope - half, "hac_high": slope + half, "hac_p": t_two_sided(hac["t"], df) if se else None}


def trend_table(df: DataFrame, keys: list[str], scale: float = 10.0) -> DataFrame:
    """A row for each series (keys, x, y): the Theil-Sen line with its interval, the Newey-West slope, and the slope relative to the mean in percent.

    Slopes are for ``scale`` units of x (ten years, say). The Newey-West
    inference uses the effective degrees of freedom of the residuals of the
    Theil-Sen line. One shuffle by series; points with a null are left out.
    """
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.dropna(subset=["x", "y"]).sort_values("x")
        found = trend_statistics(g["x"].to_numpy(float), g["y"].to_numpy(float), scale)
        return pd.DataFrame([dict(zip(keys, key)) | found] if found else [], columns=[*keys, *_TREND])

    return df.select(*keys, F.col("x").cast("double"), F.col("y").cast("double")).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, *(f"{k} {v}" for k, v in _TREND.items())]))
