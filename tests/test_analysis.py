"""The whole analysis on a made record of three years."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan import __main__ as cli
from gridspan.plans import analysis
from gridspan.sources import fields as src
from gridspan.sources import products

START, END = dt.date(2001, 1, 1), dt.date(2003, 12, 31)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("project"))
    src.regular_grid(spark, 4, 6, -67.5, 45.0, 30.0, 60.0, [0]).write.parquet(f"{path}/grid")
    rng = np.random.default_rng(0)
    rows = []
    for k in range((END - START).days + 1):
        v = 28 + np.sin(2 * math.pi * k / 365) + k * 1e-3 + rng.standard_normal(24)
        v[9] = 31.0
        rows.append((START + dt.timedelta(days=k), [float(x) for x in v]))
    spark.createDataFrame(rows, "date date, values array<double>").write.parquet(f"{path}/fields")
    return path


def test_whole_analysis(spark, root):
    flags = ["--project-root", root, "--start-date", str(START), "--end-date", str(END)]
    box = ["--box-lat", "-60", "60", "--box-lon", "100", "260", "--period", "early:2001:2002", "--period", "later:2010:2011"]
    flags += box
    cli.main(flags)
    annual = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/tables/annual_summary.csv")
    assert annual.count() == 9 and annual.columns[:2] == ["threshold_c", "year"]
    trend = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/tables/trend_statistics.csv")
    assert trend.count() == 18 and trend.filter("metric = 'total_area_km2' and theil_sen_slope <= 0").count() == 0
    qc = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/tables/release_checks.csv")
    assert qc.count() == 5 and qc.filter("not pass").count() == 0
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/tables/{name}.csv")
    assert {r["period"] for r in read("definition_period").collect()} == {"early"}
    assert read("stl_summary").count() == 6 and read("welch_summary").count() == 3 and read("welch_bands").count() == read("wavelet_bands").count() == 9
    assert {r["threshold_c"] for r in read("welch_summary").collect()} == {28.0, 28.5, 29.0}
    n_days = (END - START).days + 1
    assert spark.read.parquet(f"{root}/products/decomposition").count() == 3 * n_days
    assert 1 <= spark.read.parquet(f"{root}/products/snapshots").count() <= 2 and read("representative_dates").count() == 2
    record = products.read_json(spark, f"{root}/metadata.json")["record"]
    assert record["28.5"] == {"rows": n_days, "first": str(START), "last": str(END), "expected": n_days}
    listed = {r["relative_path"].split("/")[0] for r in spark.read.option("header", True).csv(f"{root}/manifest.csv").collect()}
    assert {"annual_summary.csv", "detached_summary.csv", "definition_trends.csv", "monthly_climatology.csv"} <= listed
    cli.main([*flags, "--no-raw-maps"])  # all that needs fields is stored
    cli.main([*flags, "--refresh-provenance-only"])
    cli.main([*flags, "--derive-detachment-only"])
    with pytest.raises(RuntimeError, match="not as expected"):
        cli.main([*flags, "--refresh-provenance-only", "--thresholds", "28", "29"])
    with pytest.raises(RuntimeError, match="may not be read"):
        cli.main([*flags, "--no-raw-maps", "--rebuild-daily"])
    with pytest.raises(ValueError, match="after its end"):
        analysis.Settings("2002-01-02", "2002-01-01")


def test_a_lost_year_is_built_again(spark, root):
    p = analysis.Project(spark, root, analysis.Settings(str(START), str(END)))
    before = p.daily()
    n = before.count()
    kept = before.filter("year <> 2002 or day(date) > 3").select("*")
    kept.write.partitionBy("year").parquet(f"{root}/short")
    assert products.incomplete_years(spark.read.parquet(f"{root}/short"), spark, str(START), str(END)) == [2002]
    assert n == 3 * 1095
    few = analysis.Project(spark, root, analysis.Settings(str(START), str(END), (28.0, 40.0)))
    with pytest.raises(ValueError, match="no component: 2001-01-01 at 40"):
        few.daily(rebuild=True)


def test_query_by_name(spark, capsys, tmp_path):
    cli.main(["--query", "list"])
    assert "lcc_daily" in capsys.readouterr().out
    cli.main(["--query", "annual_means", "--data", "/root/testdata/sf0.001", "--output", f"{tmp_path}/o"])
    assert spark.read.parquet(f"{tmp_path}/o").filter(F.col("n_days") < 365).count() == 0


def test_values_of_the_comparison():
    s = cli.settings(cli.arguments([]))
    assert (s.box_lat, s.box_lon, s.box_threshold) == ((-20.0, 20.0), (120.0, 210.0), 28.0)
    assert [p[1:] for p in s.periods] == [(1982, 1991), (1982, 2025)] and (s.start, s.end) == ("1981-09-01", "2026-07-29")
    assert cli.settings(cli.arguments(["--no-periods"])).periods == ()
    assert cli.settings(cli.arguments(["--period", "a:b:1990:1991"])).periods == (("a:b", 1990, 1991),)
    with pytest.raises(ValueError, match="has no cells"):
        analysis.Settings("2001-01-01", "2001-01-02", box_lat=(5.0, -5.0))
    with pytest.raises(ValueError, match="ends before"):
        analysis.Settings("2001-01-01", "2001-01-02", periods=(("x", 2002, 2001),))
    with pytest.raises(SystemExit):
        cli.arguments(["--period", "1990"])


def test_years_reach_the_scan_as_ranges(spark, root):
    p = analysis.Project(spark, root, analysis.Settings(str(START), str(END)))
    plan = p.of_years([2001, 2003])._jdf.queryExecution().executedPlan().toString()
    assert "year(" not in plan and p.of_years([2001, 2003]).count() == 730
