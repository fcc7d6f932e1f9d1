"""Kernels against brute force, published numbers and invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.functions import distributions as dist
from gridspan.functions import geo
from gridspan.operators import labelling, occurrence, spectral, timeline, trends
from gridspan.sources import fields as src


def brute_labels(mask):
    n_lat, n_lon = mask.shape
    out, seen = -np.ones(mask.shape, int), set()
    for i in range(n_lat):
        for j in range(n_lon):
            if not mask[i, j] or (i, j) in seen:
                continue
            stack, label = [(i, j)], i * n_lon + j
            seen.add((i, j))
            while stack:
                a, b = stack.pop()
                out[a, b] = label
                for x in (a - 1, a, a + 1):
                    for y in (b - 1, b, b + 1):
                        p = (x, y % n_lon)
                        if 0 <= x < n_lat and mask[p] and p not in seen:
                            seen.add(p)
                            stack.append(p)
    return out


@pytest.mark.parametrize("density", [0.0, 0.2, 0.4, 0.6, 1.0])
def test_labels_match_flood_fill(density):
    m = np.random.default_rng(3).random((40, 7, 9)) < density
    got = labelling.label_fields(m)
    assert all((g == brute_labels(x)).all() for g, x in zip(got, m))


def test_labels_are_invariant_under_rotation():
    m = np.random.default_rng(4).random((20, 8, 8)) < 0.4
    a, b = labelling.label_fields(m), labelling.label_fields(np.roll(m, 3, axis=2))
    for x, y in zip(a, np.roll(b, -3, axis=2)):
        pairs = {(p, q) for p, q in zip(x.ravel().tolist(), y.ravel().tolist())}
        assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def test_grid_covers_the_sphere(spark):
    g = src.regular_grid(spark, 36, 72, -87.5, 5.0, 2.5, 5.0)
    total = g.agg(F.sum("area_km2")).first()[0]
    assert math.isclose(total, 4 * math.pi * geo.EARTH_RADIUS_KM**2, rel_tol=1e-12)


def test_non_finite_values_never_pass_a_threshold(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), [float("nan"), float("inf"), None, 1.0])], "d date, v array<double>")
    f = src.fields(df, F.col("d"), "v")
    grid = src.grid_arrays(src.regular_grid(spark, 2, 2, -45.0, 90.0, 90.0, 180.0))
    got = labelling.label_components(f, grid, (0.5,)).collect()
    assert [(r["cell_id"], r["component_id"], r["largest"]) for r in got] == [(3, 3, True)]
    assert labelling.label_components(f.limit(0), grid, (0.5,)).count() == 0
    assert {r["cell_id"]: r["n_valid"] for r in occurrence.cell_statistics(f, grid, (0.5,)).collect()} == {3: 1}
    small = src.fields(spark.createDataFrame([(dt.date(2000, 1, 1), [1.0])], "d date, v array<double>"), F.col("d"), "v")
    with pytest.raises(Exception, match="1 cells where the grid has 4"):
        labelling.label_components(small, grid, (0.5,)).collect()


def test_wrapped_longitude_and_distance(spark):
    r = spark.range(1).select(geo.signed_longitude_difference(F.lit(359.0), F.lit(1.0)).alias("d"), geo.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("k"), geo.great_circle_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("n")).first()
    assert r["d"] == -2 and math.isclose(r["k"], math.pi * geo.EARTH_RADIUS_KM) and r["n"] is None


def test_longest_runs(spark):
    days = [1, 2, 3, 5, 6, 9, 9]
    df = spark.createDataFrame([(1, dt.date(2000, 1, d)) for d in days] + [(2, dt.date(2000, 2, 1))], "k int, date date")
    assert {r["k"]: r["longest_run"] for r in occurrence.longest_runs(df, ["k"]).collect()} == {1: 3, 2: 1}
    assert occurrence.longest_runs(df.limit(0), ["k"]).count() == 0


def test_detached_count_below_zero_is_an_error(spark):
    grid = src.regular_grid(spark, 2, 2, -45.0, 90.0, 90.0, 180.0)
    bad = spark.createDataFrame([(1.0, 0, 5, 1, 2, 1)], "threshold_c double, cell_id int, n_valid long, n_canonical long, n_lcc long, longest_run int")
    with pytest.raises(Exception, match="more often"):
        occurrence.detached_summary(bad, grid).collect()


def test_theil_sen_of_a_line(spark):
    df = spark.createDataFrame([("a", float(x), 3.0 * x + 2.0) for x in range(9)] + [("b", 1.0, 1.0)], "k string, x double, y double")
    got = trends.theil_sen(df, ["k"]).collect()
    assert [(r["k"], r["slope"], r["intercept"], r["joint_intercept"]) for r in got] == [("a", 3.0, 2.0, 2.0)]


def test_distributions_match_known_values():
    assert math.isclose(dist.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)
    assert math.isclose(dist.chi2_quantile(0.95, 2), 5.991464547107979, rel_tol=1e-9)
    assert math.isclose(dist.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)


def test_welch_degrees_of_freedom_match_the_published_value():
    assert math.isclose(spectral.effective_dof(2920, 1460, 16403), 19.04761905, rel_tol=1e-8)


def test_welch_finds_a_sinusoid(spark):
    n = 2000
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(days=k), math.sin(2 * math.pi * k / 20) + 0.01 * k) for k in range(n)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    got = spectral.dominant_period(spectral.welch_spectrum(df, ["key"], 400, 200), ["key"]).first()
    assert got["dominant_period_days"] == 20.0


def test_hac_of_noise_free_shapes():
    x = np.arange(44.0)
    rng = np.random.default_rng(1)
    got = trends.hac_statistics(x, 2 * x + rng.standard_normal(44))
    assert got["maxlags"] == 3 and abs(got["slope"] - 2) < 0.05 and got["low"] < 2 < got["high"] and 3 <= got["effective_sample_size"] <= 44


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1), 1.0), (dt.date(2000, 1, 4), 2.0)], "date date, value double")
    assert sorted(r["date"].day for r in timeline.gaps(df).collect()) == [2, 3]
    assert timeline.filled(df).agg(F.sum("value"), F.count("*")).first()[:] == (3.0, 4)
    assert timeline.gaps(df.limit(0)).count() == 0
    whole = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2001-12-30')) AS date").withColumn("value", F.lit(1.0))
    assert {r["year"]: r["complete"] for r in timeline.complete_years(whole).collect()} == {2000: True, 2001: False}
    mean = timeline.centred_mean(whole.limit(10), 2, 4)
    assert mean.filter("rolling_mean is null").count() == 2


def test_name_resolution(spark):
    df = spark.createDataFrame([(1.0,)], "Latitude double")
    assert src.resolve_column(df, ["lat", "latitude"], "latitude") == "Latitude"
    with pytest.raises(KeyError):
        src.resolve_column(df, ["lon"], "longitude")
