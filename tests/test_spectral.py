"""Welch spectra by segments and centred means by blocks against forms that hold a whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspan.functions.distributions import chi2_quantile
from gridspan.operators import spectral, timeline

DAY = dt.date(2000, 1, 1)


def series(rng, n, key):
    y = 50 + 0.01 * np.arange(n) + np.cumsum(rng.standard_normal(n)) * 0.2 + np.sin(np.arange(n) * 2 * np.pi / 30)
    return pd.DataFrame({"key": key, "date": [DAY + dt.timedelta(days=k) for k in range(n)], "value": y})


def whole(y, segment, overlap):
    x = np.arange(len(y))
    z = y - np.polyval(np.polyfit(x, y, 1), x)
    f, p = spectral.welch(z, segment, overlap)
    r = np.clip(np.corrcoef(z[:-1], z[1:])[0, 1], -0.99, 0.99)
    used = min(segment, len(y))
    dof = spectral.effective_dof(used, used - min(overlap, used // 2), len(y))
    b = spectral.red_noise(f[1:], z.var(ddof=1), r)
    return f[1:], p[1:], b, b * chi2_quantile(0.95, dof) / dof


@pytest.mark.parametrize("segment,overlap", [(64, 32), (65, 20), (1000, 500), (64, 0)])
def test_segments_equal_whole_series(spark, segment, overlap):
    rng = np.random.default_rng(segment)
    frames = [series(rng, n, k) for k, n in (("a", 300), ("b", 64), ("c", 8), ("d", 7), ("e", 301))]
    got = spectral.welch_spectrum(spark.createDataFrame(pd.concat(frames)).repartition(5), ["key"], segment, overlap).toPandas()
    assert set(got["key"]) == {"a", "b", "c", "e"}
    for frame in frames:
        g = got[got["key"] == frame["key"][0]].sort_values("k")
        if len(g):
            for c, want in zip(("frequency", "psd", "background", "sig95"), whole(frame["value"].to_numpy(), segment, overlap)):
                np.testing.assert_allclose(g[c], want, rtol=1e-7, atol=1e-10)


def test_a_group_holds_one_segment(spark):
    df = spark.createDataFrame(series(np.random.default_rng(0), 500, "a"))
    plan = spectral.welch_spectrum(df, ["key"], 64, 32)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_segment" in plan


def test_missing_and_repeated_days_are_errors(spark):
    df = spark.createDataFrame(series(np.random.default_rng(0), 40, "a"))
    for wrong in (df.filter("day(date) <> 9"), df.unionByName(df.limit(1)), df.filter("date <> '2000-01-05'").unionByName(df.limit(1))):
        with pytest.raises(Exception, match="lacks days or repeats|repeats days"):
            spectral.welch_spectrum(wrong, ["key"], 16, 8).collect()
    assert spectral.welch_spectrum(df.limit(0), ["key"]).count() == 0


def test_summary_of_a_cycle(spark):
    got = spectral.welch_summary(spark.createDataFrame(series(np.random.default_rng(3), 900, "a")), ["key"], 300, 150).first()
    assert (got["n_days"], got["welch_segment_days"], got["overlap_days"]) == (900, 300, 150) and got["lag1"] > 0.5 and got["effective_welch_dof"] > 5


@pytest.mark.parametrize("half,least,block", [(3, 4, 10), (7, 8, 5), (182, 183, 2048)])
def test_centred_means_over_blocks(spark, monkeypatch, half, least, block):
    monkeypatch.setattr(timeline, "BLOCK_DAYS", block)
    rng = np.random.default_rng(half)
    frames = [series(rng, n, k).drop(index=rng.choice(n, n // 6, replace=False)) for k, n in (("a", 400), ("b", 30))]
    got = timeline.centred_means(spark.createDataFrame(pd.concat(frames)).withColumn("other", F.col("value") * 2), ["key"], ["value", "other"], half, least).toPandas()
    assert len(got) == sum(map(len, frames))
    for frame in frames:
        day = np.array([(x - DAY).days for x in frame["date"]])
        order = np.argsort(day)
        day, y = day[order], frame["value"].to_numpy()[order]
        want = [y[np.abs(day - k) <= half].mean() if (np.abs(day - k) <= half).sum() >= least else np.nan for k in day]
        g = got[got["key"] == frame["key"].iloc[0]].sort_values("date")
        np.testing.assert_allclose(g["value_rolling"], want, rtol=1e-12)
        np.testing.assert_allclose(g["other_rolling"], 2 * np.array(want), rtol=1e-12)


def test_rows_without_a_date_have_no_mean(spark):
    df = spark.createDataFrame([(DAY, 1.0), (None, 2.0), (DAY + dt.timedelta(days=1), None)], "date date, value double")
    got = {r["date"]: r["rolling_mean"] for r in timeline.centred_mean(df, 1, 1).collect()}
    assert got == {DAY: 1.0, None: None, DAY + dt.timedelta(days=1): 1.0}
