"""Slopes by rank against all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspan.operators import slopes, trends


def brute(x, y):
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    i, j = np.triu_indices(len(x), 1)
    keep = x[i] < x[j]
    return np.sort((y[j[keep]] - y[i[keep]]) / (x[j[keep]] - x[i[keep]]))


def cases(n, rng):
    t = np.arange(n) * 1.0
    return {
        "noise": (rng.random(n) * 100, rng.standard_normal(n)),
        "few values": (t, rng.integers(0, 5, n) * 1.0),
        "ties in both": (rng.integers(0, 20, n) * 1.0, rng.integers(0, 9, n) * 1.0),
        "line": (t, t * 0.25),
        "constant": (t, np.full(n, 3.3)),
        "large numbers": (1e6 + t, 1e12 + np.cumsum(rng.standard_normal(n))),
        "outliers": (t, np.where(rng.random(n) < 0.1, 1e9, rng.standard_normal(n))),
        "two values of x": (np.where(t < n // 2, 0.0, 1.0), rng.standard_normal(n)),
        "unordered": (rng.permutation(t), rng.standard_normal(n)),
    }


@pytest.mark.parametrize("n", [65, 100, 333, 1000])
def test_ranks_equal_all_pairs(n):
    for name, (x, y) in cases(n, np.random.default_rng(n)).items():
        s, want = slopes.Slopes(x, y), brute(x, y)
        assert s.pairs == len(want), name
        for k in {0, 1, len(want) // 7, len(want) // 2, len(want) * 9 // 10, len(want) - 1}:
            assert s.at_rank(k) == want[k], (name, k)
        assert s.median() == np.median(want), name


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-3, 3)), min_size=0, max_size=90))
def test_small_series_of_repeated_points(points):
    x, y = (np.array([p[k] for p in points], float) for k in range(2))
    s, want = slopes.Slopes(x, y), brute(x, y)
    assert s.pairs == len(want)
    for k in range(0, len(want), max(1, len(want) // 5)):
        assert s.at_rank(k) == want[k]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 200])
def test_inversions(n):
    z = np.random.default_rng(n).integers(0, 7, n)
    assert slopes.inversions(z) == sum(z[i] >= z[j] for j in range(n) for i in range(j))


def test_the_record_of_16403_days():
    rng = np.random.default_rng(1)
    x = np.arange(16_403) * 1.0
    y = np.cumsum(rng.standard_normal(len(x))) + 0.01 * x
    s = slopes.Slopes(x, y)
    m = s.median()
    blocks = [(y[k + 1 :] - y[k]) / (x[k + 1 :] - x[k]) for k in range(len(x) - 1)]
    assert sum(int((b < m).sum()) for b in blocks) <= s.pairs // 2 <= sum(int((b <= m).sum()) for b in blocks)


def test_lines_by_series(spark):
    rows = [("a", float(k), 2.0 * k) for k in range(5)] + [("b", 1.0, 1.0), ("b", 1.0, 5.0), ("c", 0.0, None), ("c", 1.0, 2.0)] + [("d", 0.0, 1.0), ("d", 1.0, 4.0), ("d", None, 9.0)]
    got = {r["k"]: r for r in trends.lines(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).collect()}
    assert set(got) == {"a", "d"} and got["a"]["slope"] == 2 and (got["d"]["slope"], got["d"]["n"]) == (3, 2)
    assert trends.trend_table(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).count() == 1
