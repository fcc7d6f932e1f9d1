"""Decomposition, wavelets, intervals, checks and products on small series with known answers."""

import datetime
import itertools
import uuid

import numpy as np
import pandas as pd
import pytest

from gridspan.operators import checks, decomposition, trends, wavelet
from gridspan.sources import products, versions


def daily(y, name="a", start="2001-01-01"):
    return pd.DataFrame({"series": name, "date": pd.date_range(start, periods=len(y)).date, "value": np.asarray(y, float)})


def brute_loess(y, q, at, robust):
    """One place at a time: the nearest q places by distance, a weighted line by least squares."""
    n = len(y)
    near = sorted(range(n), key=lambda k: (abs(k - at), k))[: min(q, n)]
    h = max(abs(k - at) for k in near) + max(0, (q - n) // 2)
    r = np.array([abs(k - at) / h for k in near])
    w = np.where(r <= 0.001, 1, np.where(r <= 0.999, (1 - r**3) ** 3, 0)) * robust[near]
    design = np.stack([np.ones(len(near)), np.array(near) - at], axis=1)
    return np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y[near]))[0]


@pytest.mark.parametrize("n,q", [(30, 7), (30, 15), (9, 21)])
def test_loess_is_a_weighted_line(n, q):
    rng = np.random.default_rng(n + q)
    y, robust = rng.normal(size=n), rng.uniform(0.2, 1, n)
    got = decomposition.loess(y, q, robust, beyond=1)
    assert np.allclose(got, [brute_loess(y, q, k, robust) for k in range(-1, n + 1)], atol=1e-8)


def test_stl_recovers_parts_despite_outliers(spark):
    n, rng = 420, np.random.default_rng(3)
    t = np.arange(n)
    season, trend = 3 * np.sin(2 * np.pi * t / 12), 0.01 * t
    y = season + trend + rng.normal(0, 0.05, n)
    y[[50, 200, 333]] += 40
    got = decomposition.stl_components(spark.createDataFrame(daily(y)), ["series"], 12, 35, 61).toPandas().sort_values("date")
    assert np.allclose(got["seasonal"] + got["trend"] + got["remainder"], y)
    assert np.abs(got["seasonal"] - season).max() < 0.2 and np.abs(got["trend"] - trend).max() < 0.2
    short = decomposition.stl_components(spark.createDataFrame(daily(y[:20])), ["series"], 12, 35, 61)
    assert short.count() == 0


def test_stl_summary_uses_complete_years(spark):
    t = np.arange(365 * 3 + 40)
    parts = daily(0 * t).assign(observed=10.0, seasonal=np.sin(t), trend=0.5 * t, remainder=np.cos(t)).drop(columns="value")
    got = {r["metric"]: r for r in decomposition.stl_summary(spark.createDataFrame(parts), ["series"]).collect()}
    assert set(got) == {"amplitude", "relative_amplitude_pct"}
    assert got["amplitude"]["mean"] == pytest.approx(2, abs=1e-3) and got["relative_amplitude_pct"]["mean"] == pytest.approx(20, abs=1e-2)
    assert got["amplitude"]["trend_variance"] == pytest.approx(np.var(0.5 * t, ddof=1)) and got["relative_amplitude_pct"]["trend_variance"] is None


def test_wavelet_finds_a_period_and_equals_direct_sums(spark):
    n = 512
    y = np.sin(2 * np.pi * np.arange(n) / 32) + 0.01 * np.random.default_rng(1).normal(size=n)
    power = wavelet.wavelet_power(spark.createDataFrame(daily(y)), ["series"]).toPandas()
    assert list(power.sort_values("k")["k"]) == list(range(len(wavelet.scales_of(n))))
    assert power.loc[power["global_power"].idxmax(), "period_days"] == pytest.approx(32, rel=0.06)
    z, s = np.random.default_rng(2).normal(size=64), 5.0
    lag = np.arange(64)[:, None] - np.arange(64)[None, :]
    wave = np.pi**-0.25 * np.exp(-1j * 6 * -lag / s) * np.exp(-((lag / s) ** 2) / 2) / np.sqrt(s)
    inner = slice(24, 40)  # far from the padded ends
    assert np.allclose(wavelet.morlet(z, np.array([s]))[0][inner], (wave @ z)[inner], atol=0.02)


def test_cone_counts_of_the_published_record():
    """Coefficients inside the cone for 16,403 days; periods in days of three bands. Fixed values."""
    n = 16403
    period, coi = wavelet.LAMBDA * wavelet.scales_of(n), wavelet.cone(n)
    assert len(period) == 157
    for low, high, count in BANDS:
        chosen = period[(period >= low) & (period <= high)]
        assert int((chosen[:, None] <= coi[None, :]).sum()) == count


#: Shortest and longest period in days, coefficients inside the cone.
BANDS = [(336, 378, 30816), (550, 1096, 171034), (805, 2922, 261762)]


def test_constant_and_short_series_have_no_wavelet(spark):
    rows = pd.concat([daily(np.ones(100), "flat"), daily(np.arange(5.0), "short")])
    assert wavelet.wavelet_power(spark.createDataFrame(rows), ["series"]).count() == 0


def test_interval_with_ties(spark):
    rng = np.random.default_rng(5)
    x, y = np.repeat(np.arange(12.0), 2)[:23], np.round(rng.normal(size=23), 0)
    got = trends.theil_sen_interval(spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y})), ["k"]).first()
    s = sorted((y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(23), 2) if x[i] != x[j])
    ties = sum(c * (c - 1) * (2 * c + 5) for v in (x, y) for c in np.unique(v, return_counts=True)[1])
    sigma = ((23 * 22 * 51 - ties) / 18) ** 0.5
    lo, hi = max(round((len(s) - trends.Z95 * sigma) / 2), 1) - 1, min(round((len(s) + trends.Z95 * sigma) / 2), len(s) - 1)
    assert (got["slope"], got["low"], got["high"]) == pytest.approx((np.median(s), s[lo], s[hi]))


def test_record_check_names_every_fault(spark):
    d = lambda k: datetime.date(2001, 1, k)
    rows = [("ok", d(k), 1.0) for k in (1, 2, 3)] + [("bad", d(1), None), ("bad", d(1), 1.0), ("bad", d(9), 1.0)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    got = {r["key"]: r.asDict() for r in checks.record_check(df, ["key"], "2001-01-01", "2001-01-03", ["value"]).collect()}
    assert got["ok"]["complete"] and not got["bad"]["complete"]
    assert [got["bad"][c] for c in ("n_expected", "n_missing", "n_outside", "n_repeated", "n_null")] == [3, 2, 1, 1, 1]


def test_reconcile_needs_unique_equal_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    near = spark.createDataFrame([(1, 1.0), (2, 2.05)], "k int, v double")
    passed = lambda b, tol: checks.reconcile(a, b, ["k"], "v", "t", tol).first()["pass"]
    assert passed(near, 0.1) and not passed(near, 0.01)
    assert not passed(near.filter("k = 1"), 0.1) and not passed(near.union(near), 0.1)
    with pytest.raises(RuntimeError):
        checks.require_passed(checks.reconcile(a, near, ["k"], "v", "t", 0.0))
    with pytest.raises(ValueError):
        checks.require_columns(a, ["k", "w"])


def test_products(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    t = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    products.write_csv(t, path + "-csv")
    assert sorted(map(tuple, products.read_csv(spark, path + "-csv", "k int, s string").collect())) == [(1, "x"), (2, None)]
    products.write_json(spark, {"version": "1", "thresholds": [28.0]}, path + "-json")
    assert products.read_json(spark, path + "-json", {"version": "1"})["thresholds"] == [28.0]
    with pytest.raises(RuntimeError):
        products.read_json(spark, path + "-json", {"version": "2"})
    assert products.first_existing(spark, [path + "-none", path + "-csv"]) == path + "-csv"


def test_yearly_checkpoint_rebuilds_only_incomplete_years(spark, tmp_path):
    asked, path = [], f"file://{tmp_path}/{uuid.uuid4().hex}"

    def build(years):
        asked.append(years)
        days = spark.sql("SELECT explode(sequence(date'2001-12-30', date'2003-01-02')) AS date")
        return days.filter(f"year(date) in ({', '.join(map(str, years))})").selectExpr("date", "cast(year(date) as double) as value")

    run = lambda: products.yearly(spark, path, build, "2001-12-30", "2003-01-02").count()
    assert run() == 369 and run() == 369 and asked == [[2001, 2002, 2003]]
    versions.Years(spark, path).replace(lambda years: spark.sql("SELECT date'2002-01-01' AS date, 0D AS value, 2002 AS year"), [2002], {})
    assert run() == 369 and asked[1:] == [[2002]]
