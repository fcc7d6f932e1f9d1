"""Quantiles by refined ranges against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import quantiles

SHARES = (0.0, 0.01, 0.5, 0.95, 1.0)


def groups(rng):
    return {
        "normal": rng.standard_normal(2001),
        "even": rng.standard_normal(500),
        "one": np.array([3.5]),
        "two": np.array([-1.0, 4.0]),
        "constant": np.full(300, 7.25),
        "few values": rng.integers(0, 3, 999) * 1.0,
        "heavy": np.exp(rng.standard_normal(800) * 40),
        "wide": np.array([-1.7e308, -1.0, 0.0, 5e-324, 1.0, 1.7e308]),
        None: rng.random(77),
    }


@pytest.mark.parametrize("ranges", [8, 4096])
def test_equal_to_numpy(spark, monkeypatch, ranges):
    if ranges < 4096:  # narrow tables of ranges need many passes
        monkeypatch.setattr(quantiles, "RANGES", ranges)
    held = groups(np.random.default_rng(ranges))
    if ranges == 8:
        held = {k: held[k] for k in ("two", "few values", None)}
    rows = [(k, float(x)) for k, v in held.items() for x in v] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r["k"], r["share"]): r for r in quantiles.quantiles(df, ["k"], "v", SHARES).collect()}
    assert len(got) == len(held) * len(SHARES)
    for k, v in held.items():
        for s in SHARES:
            assert got[k, s]["n"] == len(v)
            if k != "wide":
                assert got[k, s]["quantile"] == pytest.approx(np.quantile(v, s), rel=1e-12, abs=1e-300), (k, s)
    if "wide" in held:
        assert [got["wide", s]["quantile"] for s in (0.0, 1.0)] == [-1.7e308, 1.7e308]


def test_without_keys_and_empty(spark):
    df = spark.range(1000).select((F.col("id") * 0.5).alias("v"))
    assert [tuple(r) for r in quantiles.quantiles(df, [], "v", (0.5,)).collect()] == [(0.5, 1000, 249.75)]
    assert quantiles.quantiles(df.limit(0), [], "v", (0.5,)).count() == 0


def test_bounds_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    df = spark.range(900).select(F.pmod("id", F.lit(3)).alias("k"), F.col("id").cast("double").alias("v"))
    assert sorted(tuple(r) for r in quantiles.quantiles(df, ["k"], "v", (0.25, 1.0)).collect()) == [(k, s, 300, q) for k in range(3) for s, q in ((0.25, k + 224.25), (1.0, k + 897.0))]
