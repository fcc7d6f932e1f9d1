"""Sources, grids, products and gates on small made tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.functions.text import code_of, threshold_code, threshold_of
from gridspan.operators import checks, labelling, timeline, trends
from gridspan.sources import fields as src
from gridspan.sources import products

DAY = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def grid(spark):
    return src.grid_arrays(src.regular_grid(spark, 2, 3, -45.0, 90.0, 60.0, 120.0, [5]))


def fields(spark, *values):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=k), v) for k, v in enumerate(values)], "d date, v array<double>")
    return src.fields(df, F.col("d"), "v")


def test_axes_are_brought_into_order(spark, grid):
    lat, lon, order = src.normalised_axes([45.0, -45.0], [-180.0, 60.0, 300.0])
    assert lat.tolist() == [-45.0, 45.0] and lon.tolist() == [60.0, 180.0, 300.0]
    got = src.reordered(fields(spark, [1.0, 2.0, 3.0, 4.0, float("nan"), 6.0]), order).first()["values"]
    assert got == [None, 4.0, 6.0, 2.0, 1.0, 3.0]
    src.require_conformity(lat, lon, grid)
    with pytest.raises(ValueError, match="latitudes"):
        src.require_conformity(lat + 1e-6, lon, grid)
    with pytest.raises(ValueError, match="longitudes"):
        src.require_conformity(lat, lon[:2], grid)
    with pytest.raises(ValueError, match="longitude is repeated"):
        src.normalised_axes([0.0], [10.0, 370.0])
    assert src.reordered(fields(spark, [1.0] * 6).limit(0), order).count() == 0


def test_fields_outside_the_mask_are_null(spark, grid):
    assert src.masked(fields(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]), grid).first()["values"] == [1.0, 2.0, None, 4.0, 5.0, None]
    with pytest.raises(Exception, match="2 cells where the grid has 6"):
        src.masked(fields(spark, [1.0, 2.0]), grid).collect()


def test_singleton_levels(spark):
    df = spark.createDataFrame([([[1.0, 2.0]],)], "v array<array<double>>")
    assert src.squeezed(df, "v").first()["v"] == [1.0, 2.0]
    with pytest.raises(Exception, match="several levels"):
        src.squeezed(spark.createDataFrame([([[1.0], [2.0]],)], "v array<array<double>>"), "v").collect()


def test_stored_grids_and_years(spark, tmp_path):
    src.regular_grid(spark, 2, 3, -45.0, 90.0, 60.0, 120.0).write.parquet(f"{tmp_path}/grid")
    assert src.grid_arrays(src.read_grid(spark, f"{tmp_path}/grid")).mask.all()
    spark.range(1).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="lacks area_km2"):
        src.read_grid(spark, f"{tmp_path}/bad")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        src.read_grid(spark, f"{tmp_path}/none")
    for y in (1999, 2001):
        spark.range(y, y + 1).write.parquet(f"{tmp_path}/f.{y}")
    assert src.read_years(spark, f"{tmp_path}/f.{{year}}", 1999, 1999).first()["id"] == 1999
    with pytest.raises(FileNotFoundError, match="2000"):
        src.read_years(spark, f"{tmp_path}/f.{{year}}", 1999, 2001)


def test_a_grid_with_a_missing_cell_is_an_error(spark):
    g = src.regular_grid(spark, 2, 3, -45.0, 90.0, 60.0, 120.0)
    with pytest.raises(ValueError, match="do not make a grid"):
        src.grid_arrays(g.filter("cell_id <> 2"))


def test_lookup_by_date(spark):
    f = fields(spark, [1.0], [2.0], [3.0])
    assert [r["values"] for r in src.on_dates(f, ["2000-01-02"]).collect()] == [[2.0]]
    with pytest.raises(Exception, match="of 2 dates only 1 are there"):
        src.on_dates(f, ["2000-01-02", "1999-01-01"]).collect()


def test_time_range(spark):
    f = fields(spark, [1.0], [2.0], [3.0])
    assert sorted(r["values"][0] for r in src.time_range(f, "2000-01-01", "2000-01-02").collect()) == [1.0, 2.0]


def test_axis_edges(spark):
    got = src.axis_edges(spark.createDataFrame([(-80.0,), (0.0,), (80.0,)], "lat double"), "lat", (-90.0, 90.0)).orderBy("lat").collect()
    assert [(r["low"], r["high"]) for r in got] == [(-90.0, -40.0), (-40.0, 40.0), (40.0, 90.0)]


def test_days_without_a_component(spark, grid):
    f = fields(spark, [1.0] * 6, [0.0] * 5 + [9.0])
    assert labelling.component_table(f, grid, (0.5, 99.0, 0.7)).count() == 2
    table = labelling.component_table(f, grid, (0.5,))
    assert [(r["date"], r["number"], r["n_cells"], r["largest"]) for r in table.collect()] == [(DAY, 1, 5, True)]
    assert [r["date"] for r in labelling.days_without_component(f, table, (0.5,)).collect()] == [DAY + dt.timedelta(days=1)]
    with pytest.raises(ValueError, match="2000-01-02 at 0.5"):
        labelling.require_components(f, table, (0.5,))


def test_equal_areas_go_to_the_least_label(spark, grid):
    label = np.array([[0, -1, 2, 0, -1, 2], [-1] * 6])
    assert labelling.largest_labels(label, np.ones(6)).tolist() == [0, -1]
    assert labelling.largest_labels(label, np.array([1.0, 1, 1, 1, 1, 1.1])).tolist() == [2, -1]


def test_threshold_codes(spark):
    assert code_of(28.5) == "28p5" and threshold_of("28p5") == 28.5
    assert spark.range(1).select(threshold_code(F.lit(28.0)).alias("c")).first()["c"] == "28p0"


def test_products_by_threshold(spark):
    df = spark.createDataFrame([(1, 0.5, 7), (1, 1.0, 8), (2, 0.5, 9)], "cell int, threshold_c double, n int")
    wide = products.flattened(df, ["cell"], (0.5, 1.0), ("n",))
    assert {tuple(r) for r in wide.collect()} == {(1, 7, 8), (2, 9, None)} and wide.columns == ["cell", "t0p5__n", "t1p0__n"]
    long = products.unflattened(wide, ["cell"], (0.5, 1.0)).filter("value is not null")
    assert {(r["cell"], r["threshold_c"], r["value"]) for r in long.collect()} == {(1, 0.5, 7.0), (1, 1.0, 8.0), (2, 0.5, 9.0)}
    with pytest.raises(ValueError, match="no rows at 2"):
        products.flattened(df, ["cell"], (0.5, 2.0), ("n",))
    with pytest.raises(ValueError, match="no columns at 2"):
        products.unflattened(wide, ["cell"], (2.0,))
    with pytest.raises(ValueError, match="no rows at 2"):
        checks.require_thresholds(df, (0.5, 2.0))


def test_tables_are_reused_or_built(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(len(built), 1)], "n int, m int")

    path = f"{tmp_path}/t"
    assert [products.load_or_build(spark, path, build, need, again).first()["n"] for need, again in (((), False), (("n",), False), ((), True), (("other",), False))] == [1, 1, 2, 3]


def test_csv_has_a_fixed_number_of_digits(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    for value in (1.0, 123456.7890123456):
        products.write_csv(spark.createDataFrame([(1, value), (2, float("nan"))], "k int, v double"), path)
    assert [(r["k"], r["v"]) for r in products.read_csv(spark, path, "k int, v double").orderBy("k").collect()] == [(1, 123456.7890), (2, None)]
    with pytest.raises(Exception):
        products.read_csv(spark, path, "k int, v int").collect()


def test_default_columns(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert checks.with_default(df, "c", F.lit("8")).first()["c"] == "8" and checks.with_default(df, "k", F.lit(5)).first()["k"] == 1


def test_release_checks_fail_where_they_should(spark):
    row = (DAY, 10.0, 11.0, 5.0, 4.0)
    daily = spark.createDataFrame([row], "date date, canonical_area_km2 double, lcc_area_km2 double, box_strict_area_km2 double, box_inclusive_area_km2 double")
    ref = spark.createDataFrame([(DAY, 10.0, 11.0)], "date date, total_area_km2 double, largest_component_area_km2 double")
    got = {r["test"]: r["pass"] for r in checks.release_checks(daily, ref).collect()}
    assert got == {"daily_record_complete": True, "lcc_within_canonical": False, "strict_within_inclusive": False, "canonical_area_vs_reference": True, "lcc_area_vs_reference": True}
    assert sum(r["pass"] for r in checks.release_checks(daily, ref.limit(0)).collect()) == 1
    assert sum(r["pass"] for r in checks.release_checks(daily, ref.union(ref)).collect()) == 1


def test_rolling_means_go_by_days(spark):
    days = [0, 1, 2, 9, 10]
    df = spark.createDataFrame([("a", DAY + dt.timedelta(days=k), float(k), None) for k in days], "k string, date date, x double, y double")
    got = {(r["date"] - DAY).days: (r["x_rolling"], r["y_rolling"]) for r in timeline.centred_means(df, ["k"], ("x", "y"), 2, 2).collect()}
    assert got == {0: (1.0, None), 1: (1.0, None), 2: (1.0, None), 9: (9.5, None), 10: (9.5, None)}


def test_effective_sample_takes_whole_pairs():
    x = np.array([0.0, 1.0, 2.0, 3.0])
    rho = trends.autocorrelation(x)
    s = 0.75 * rho[1] + 0.5 * rho[2] if rho[1] + rho[2] > 0 else 0.0
    assert trends.effective_sample_size(x) == pytest.approx(min(max(4 / (1 + 2 * s), 3), 4))


def test_trend_table_of_noise_and_line(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(k), 5.0 + 2.0 * k + float(e)) for k, e in enumerate(rng.standard_normal(40))]
    got = trends.trend_table(spark.createDataFrame(rows, "m string, x double, y double"), ["m"]).first()
    assert abs(got["theil_sen_slope"] - 20) < 1 and got["low"] < got["theil_sen_slope"] < got["high"] and got["hac_low"] < got["hac_slope"] < got["hac_high"]
    assert got["relative_slope_pct"] == pytest.approx(100 * got["theil_sen_slope"] / got["mean"]) and got["hac_p"] < 1e-6 and got["n"] == 40


def test_long_series_have_a_slope(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 0.5 + F.pmod(F.col("id"), F.lit(7))).alias("y"))
    got = trends.lines(df, ["k"]).first()
    assert got["n"] == 20_000 and got["slope"] == 0.5 and got["low"] <= 0.5 <= got["high"]
