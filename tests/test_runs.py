"""Occurrence and longest runs from mergeable stretches, against a plain count day by day."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import labelling, occurrence
from gridspan.sources import fields as src

DAY = dt.date(2000, 1, 1)


def record(seed, n_days, missing=()):
    rng = np.random.default_rng(seed)
    base = rng.random(24)
    return {k: np.where(rng.random(24) < 0.05, np.nan, base + np.sin(k / 9 + np.arange(24)) * 0.4) for k in range(n_days) if k not in missing}


def table(spark, days):
    rows = [(DAY + dt.timedelta(days=k), [None if np.isnan(x) else float(x) for x in v]) for k, v in days.items()]
    return spark.createDataFrame(rows, "date date, values array<double>")


def plain(days, grid, thresholds):
    out = {}
    inside = grid.mask.ravel()
    for t in thresholds:
        run = np.zeros(24, int)
        n = {c: [0, 0, 0, 0] for c in range(24)}
        before = None
        for k in sorted(days):
            v = days[k]
            with np.errstate(invalid="ignore"):
                member = (v >= t) & inside
            label = labelling.label_fields(member.reshape(1, *grid.mask.shape)).reshape(1, -1)
            top = (label == labelling.largest_labels(label, grid.area)[:, None])[0] & member
            run = np.where(top, np.where(before == k - 1, run, 0) + 1, 0)
            before = k
            for c in range(24):
                n[c][0] += bool(inside[c] and not np.isnan(v[c]))
                n[c][1] += bool(member[c])
                n[c][2] += bool(top[c])
                n[c][3] = max(n[c][3], int(run[c]))
        out |= {(t, c): tuple(x) for c, x in n.items() if x[0]}
    return out


@pytest.mark.parametrize("seed,missing,parts", [(1, (), 1), (2, (3, 4, 50), 5), (3, range(40, 45), 13)])
def test_statistics_equal_a_plain_count(spark, seed, missing, parts):
    grid = src.grid_arrays(src.regular_grid(spark, 4, 6, -67.5, 45.0, 30.0, 60.0, [0, 7]))
    days, thresholds = record(seed, 90, set(missing)), (0.3, 0.8, 5.0)
    f = table(spark, days)
    for dealt in (f.repartition(parts, F.xxhash64("date")), f.repartitionByRange(parts, "date")):
        got = {(r["threshold_c"], r["cell_id"]): tuple(r)[2:] for r in occurrence.cell_statistics(dealt, grid, thresholds).collect()}
        assert got == plain(days, grid, thresholds)


def test_rows_grow_with_stretches_and_not_with_days(spark):
    grid = src.grid_arrays(src.regular_grid(spark, 4, 6, -67.5, 45.0, 30.0, 60.0))
    n = [occurrence.stretches(table(spark, record(1, k)).coalesce(1), grid, (0.3,)).count() for k in (60, 120)]
    assert n[0] == n[1] <= 48


def test_a_day_that_occurs_twice_is_an_error(spark):
    grid = src.grid_arrays(src.regular_grid(spark, 4, 6, -67.5, 45.0, 30.0, 60.0))
    f = table(spark, record(1, 10))
    with pytest.raises(Exception, match="a day occurs twice"):
        occurrence.cell_statistics(f.unionByName(f.limit(1)), grid, (0.3,)).collect()


def test_empty_record_and_fields_without_values(spark):
    grid = src.grid_arrays(src.regular_grid(spark, 4, 6, -67.5, 45.0, 30.0, 60.0))
    f = table(spark, record(1, 3))
    assert occurrence.cell_statistics(f.limit(0), grid, (0.3,)).count() == 0
    none = f.withColumn("values", F.transform("values", lambda x: F.lit(None).cast("double")))
    assert occurrence.cell_statistics(none, grid, (0.3,)).count() == 0
    got = occurrence.cell_statistics(f, grid, (99.0,)).collect()
    assert got and all(tuple(r)[3:] == (0, 0, 0) for r in got)


def test_merged_runs_over_cuts(spark):
    parts = [(0, 5, 5, 5, 5), (5, 3, 3, 3, 3), (8, 4, 1, 2, 2), (12, 2, 2, 2, 2), (20, 1, 1, 1, 1)]
    df = spark.createDataFrame([(parts[::-1],)], "p array<struct<first_day:int,days:int,prefix:int,suffix:int,best:int>>")
    assert df.select(occurrence.merged_runs(F.col("p"))).first()[0] == 9
    assert df.select(occurrence.merged_runs(F.slice("p", 1, 0))).first()[0] == 0
