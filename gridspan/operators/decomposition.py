"""Robust seasonal-trend decomposition by locally weighted lines, and what is derived from it by year.

A series is one group: some thousand days. Every smoothing is one array
operation over windows of the series, so memory is a series times a window at
most.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trends


def _fit(at: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray, robust: np.ndarray, span: float) -> np.ndarray:
    """Weighted lines through the rows of (x, y), read at ``at``; tricube weights within ``reach`` times robustness."""
    r = np.abs(x - at[:, None]) / reach[:, None]
    w = np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - r**3) ** 3, 0.0)) * robust
    total = w.sum(axis=1, keepdims=True)
    empty = total[:, 0] <= 0
    w = np.where(total > 0, w / np.where(total > 0, total, 1), 0)
    mean = (w * x).sum(axis=1)
    spread = (w * (x - mean[:, None]) ** 2).sum(axis=1)
    slope = np.where(np.sqrt(spread) > 0.001 * span, (at - mean) / np.where(spread > 0, spread, 1), 0.0)
    out = (w * (1 + slope[:, None] * (x - mean[:, None])) * y).sum(axis=1)
    return np.where(empty, np.nan, out)


def _tricube(r: np.ndarray) -> np.ndarray:
    return np.where(r <= 0.001, 1.0, np.where(r <= 0.999, (1 - r**3) ** 3, 0.0))


@lru_cache(maxsize=8)
def _end_weights(first: int, last: int, q: int, more: int) -> np.ndarray:
    """Weights of the places 0 .. q - 1 for lines read at the places ``first`` .. ``last`` - 1."""
    at = np.arange(first, last, dtype=float)[:, None]
    reach = np.maximum(np.maximum(np.abs(at), np.abs(q - 1 - at)) + more, 1e-9)
    return _tricube(np.abs(np.arange(q) - at) / reach)


def _line(total: np.ndarray, sx: np.ndarray, sxx: np.ndarray, sy: np.ndarray, sxy: np.ndarray, at: np.ndarray, floor: float, span: float) -> np.ndarray:
    """Lines by their weighted sums, read at ``at``; NaN where there is no weight."""
    some = total > floor
    total = np.where(some, total, 1.0)
    mean, my = sx / total, sy / total
    spread = np.maximum(sxx / total - mean**2, 0)
    slope = np.where(np.sqrt(spread) > 0.001 * span, (at - mean) / np.where(spread > 0, spread, 1), 0.0)
    return np.where(some, my + slope * (sxy / total - mean * my), np.nan)


def _end(y: np.ndarray, robust: np.ndarray, first: int, last: int, more: int, span: float) -> np.ndarray:
    """Lines through the whole of a short window, read at the places ``first`` .. ``last`` - 1."""
    q = len(y)
    w, x = _end_weights(first, last, q, more), np.arange(q) - (q - 1) / 2
    sums = w @ np.stack([robust, robust * x, robust * x * x, robust * y, robust * x * y], axis=1)
    return _line(*sums.T, np.arange(first, last) - (q - 1) / 2, 1e-12, span)


def loess(y: np.ndarray, window: int, robust: np.ndarray | None = None, beyond: int = 0) -> np.ndarray:
    """Local lines at every place of an evenly spaced series and ``beyond`` places outside either end.

    Windows hold the ``window`` nearest places, all of them (with a longer
    reach) if the series is shorter. Where no place has weight, the value stays.
    Away from the ends all windows have the same weights, and their sums are
    convolutions.
    """
    n, offset = len(y), float(np.mean(y)) if len(y) else 0.0
    q, more, span = min(window, n), max(0, (window - n) // 2), max(n - 1, 1)
    robust, z = np.ones(n) if robust is None else robust, y - offset
    half = (q - 1) // 2
    middle = np.arange(half, n - (q - 1 - half))  # places whose windows do not reach an end
    if q == n:
        got = _end(z, robust, -beyond, n + beyond, more, span)
    else:
        d = np.arange(-half, q - half)
        kernel, size = _tricube(np.abs(d) / max(half, q - 1 - half, 1e-9)), 1 << (n + q).bit_length()
        kernels = np.fft.rfft(np.stack([kernel, kernel * d, kernel * d * d])[:, ::-1], size)
        inputs = np.fft.rfft(np.stack([robust, robust * z]), size)
        sums = np.fft.irfft(kernels[[0, 1, 2, 0, 1]] * inputs[[0, 0, 0, 1, 1]], size)[:, q - 1 : n]
        inner = _line(*sums, 0.0, 1e-12 * q, span)
        head = _end(z[:q], robust[:q], -beyond, half, more, span)
        tail = _end(z[n - q :][::-1], robust[n - q :][::-1], -beyond, n - 1 - int(middle[-1]), more, span)[::-1]
        got = np.concatenate([head, inner, tail])
    stay = z[np.clip(np.arange(-beyond, n + beyond), 0, max(n - 1, 0))]
    return np.where(np.isnan(got), stay, got) + offset


def _cycles(y: np.ndarray, window: int, robust: np.ndarray) -> np.ndarray:
    """``loess`` of many short series of one length (a row each), one place beyond either end."""
    many, n = y.shape
    q = min(window, n)
    out = np.empty((many, n + 2))
    for column, at in enumerate(range(-1, n + 1)):
        left = min(max(at - (q - 1) // 2, 0), n - q)
        reach = max(at - left, left + q - 1 - at, 1e-9) + max(0, (window - n) // 2)
        part = slice(left, left + q)
        places = np.broadcast_to(np.arange(left, left + q, dtype=float), (many, q))
        got = _fit(np.full(many, float(at)), places, y[:, part], np.full(many, reach), robust[:, part], max(n - 1, 1))
        out[:, column] = np.where(np.isnan(got), y[:, min(max(at, 0), n - 1)], got)
    return out


def _mean(x: np.ndarray, n: int) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(x)])
    return (c[n:] - c[:-n]) / n


def stl(y: np.ndarray, period: int, seasonal: int, trend: int, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, weights); the remainder is what is left. ``outer`` 0 is the form without robustness."""
    n = len(y)
    low = period + 1 + period % 2  # the next odd number after the period
    t, s, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for round_ in range(outer + 1):
        for _ in range(inner):
            d = y - t
            c = np.empty(n + 2 * period)
            for first, last in ((0, n % period), (n % period, period)):  # days of the cycle with one more year, and the others
                if last > first:
                    rows = np.arange(first, last)[:, None] + period * np.arange(-(-(n - first) // period))
                    smooth = _cycles(d[rows], seasonal, robust[rows])
                    c[rows[:, :1] + period * np.arange(smooth.shape[1])] = smooth
            s = c[period : period + n] - loess(_mean(_mean(_mean(c, period), period), 3), low)
            t = loess(y - s, trend, robust)
        if round_ < outer:
            r = np.abs(y - s - t)
            h = 6 * np.median(r)
            u = r / h if h > 0 else np.zeros(n)
            robust = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))
    return s, t, robust


def stl_components(df: DataFrame, keys: list[str], period: int = 365, seasonal: int = 365, trend: int = 1095, outer: int = 15) -> DataFrame:
    """(keys, date, observed, seasonal, trend, remainder) of daily series (keys, date, value); fewer than two periods give no rows."""
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    names = [*keys, "date", "observed", "seasonal", "trend", "remainder"]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.dropna(subset=["date", "value"]).sort_values("date")
        y = g["value"].to_numpy(float)
        if len(y) < 2 * period:
            return pd.DataFrame(columns=names)
        s, t, _ = stl(y, period, seasonal, trend, outer=outer)
        out = pd.DataFrame({"date": g["date"].to_numpy(), "observed": y, "seasonal": s, "trend": t, "remainder": y - s - t})
        for name, v in zip(keys, key):
            out.insert(0, name, v)
        return out[names]

    return df.select(*keys, "date", F.col("value").cast("double")).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "date date, observed double, seasonal double, trend double, remainder double"]))


def _yearly(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, F.year("date").alias("year")).agg(
        (F.max("seasonal") - F.min("seasonal")).alias("amplitude"),
        F.avg("observed").alias("observed_mean"),
        F.sqrt(F.avg(F.col("remainder") ** 2)).alias("remainder_rms"),
        F.count(F.lit(1)).alias("n_days"),
        *(f(c).alias(f"{c}_{n}") for c in PARTS for n, f in (("mean", F.avg), ("spread", F.var_pop))),
    )


def annual_amplitude(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, year, amplitude, observed_mean, relative_amplitude_pct, remainder_rms)."""
    a = _yearly(parts, keys).select(*keys, "year", "amplitude", "observed_mean", "remainder_rms", "n_days")
    return a.withColumn("relative_amplitude_pct", F.try_divide("amplitude", "observed_mean") * 100)


#: What a series is taken apart into.
PARTS = ("remainder", "trend", "seasonal")
_SUMMARY = {"mean": "double", "theil_sen_slope_per_decade": "double", "ci95_low_per_decade": "double", "ci95_high_per_decade": "double"} | {f"{c}_variance": "double" for c in PARTS}


def stl_summary(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, mean, slopes and interval a decade, variances of the parts); variances stand on the amplitude's row.

    Trends are over complete years only, variances over all days. The days are
    read once: all comes from a row for each year.
    """
    kinds = [f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("year")
        n, rows = g["n_days"].to_numpy(float), []
        pooled = {}
        for c in PARTS:
            mean = g[f"{c}_mean"].to_numpy(float)
            within = (n * (g[f"{c}_spread"].to_numpy(float) + (mean - mean @ n / n.sum()) ** 2)).sum()
            pooled[f"{c}_variance"] = within / (n.sum() - 1) if n.sum() > 1 else None
        year = g["year"].to_numpy(float)
        whole = g["n_days"] == np.where((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 366, 365)
        g = g[whole]
        relative = np.where(g["observed_mean"] != 0, 100 * g["amplitude"] / g["observed_mean"].where(g["observed_mean"] != 0), np.nan)
        for metric, y in (("amplitude", g["amplitude"].to_numpy(float)), ("relative_amplitude_pct", np.asarray(relative, float))):
            ok = ~np.isnan(y)
            if not ok.any():
                continue
            line = trends.line_statistics(g["year"].to_numpy(float)[ok], y[ok])
            slopes = [10 * line[c] for c in ("slope", "low", "high")] if line else [None] * 3
            rows.append(dict(zip(keys, key)) | {"metric": metric, "mean": y[ok].mean()} | dict(zip(list(_SUMMARY)[1:4], slopes)) | (pooled if metric == "amplitude" else {}))
        return pd.DataFrame(rows, columns=[*keys, "metric", *_SUMMARY])

    return _yearly(parts, keys).groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "metric string", *(f"{k} {v}" for k, v in _SUMMARY.items())]))
