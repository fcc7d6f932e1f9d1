"""Stored tables: what is seen when a job is cut off, and years whose input has changed."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gridspan.sources import products, versions


def test_a_job_that_is_cut_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    assert versions.read(spark, path) is None
    assert versions.publish(spark.range(3), path).count() == 3

    def cut(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "swap", cut)
        with pytest.raises(KeyboardInterrupt):
            versions.publish(spark.range(9), path)
    assert versions.read(spark, path).count() == 3 and len(os.listdir(path)) >= 3
    assert versions.publish(spark.range(5), path).count() == 5
    assert sorted(n[:2] for n in os.listdir(path) if not n.startswith(".")) == ["cu", "v-"]


def rows(spark, years, value):
    start, end = dt.date(min(years), 1, 1), dt.date(max(years), 12, 31)
    days = [start + dt.timedelta(days=k) for k in range((end - start).days + 1)]
    return spark.createDataFrame([(d, value) for d in days if d.year in years], "date date, v int")


def test_years_are_replaced_together(spark, tmp_path, monkeypatch):
    path, asked = f"{tmp_path}/y", []

    def build(value):
        return lambda years: (asked.append((value, years)), rows(spark, years, value))[1]

    span = ("2001-01-01", "2003-12-31")
    assert products.yearly(spark, path, build(1), *span).count() == 1095
    assert products.yearly(spark, path, build(2), *span).filter("v = 1").count() == 1095 and len(asked) == 1
    old = {2001: "a", 2002: "b", 2003: "c"}
    assert products.yearly(spark, path, build(3), *span, digests=old).filter("v = 3").count() == 1095
    got = products.yearly(spark, path, build(4), *span, digests=old | {2002: "changed"})
    assert asked[-1] == (4, [2002])
    assert {(r["year"], r["v"]): r["n"] for r in got.groupBy("year", "v").agg(F.count("*").alias("n")).collect()} == {(2001, 3): 365, (2002, 4): 365, (2003, 3): 365}
    with monkeypatch.context() as m:
        m.setattr(versions, "swap", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError, match="cut off"):
            products.yearly(spark, path, build(5), *span, rebuild=True)
    assert products.yearly(spark, path, build(6), *span, digests=old | {2002: "changed"}).filter("v = 4").count() == 365 and asked[-1][0] == 5


def test_digests_follow_values_and_not_order(spark):
    f = spark.createDataFrame([(dt.date(2001, 1, k), [float(k), None]) for k in range(1, 20)] + [(dt.date(2002, 1, 1), [0.0, 1.0])], "date date, values array<double>")
    one = products.year_digests(f)
    assert one == products.year_digests(f.repartition(4, "values")) and set(one) == {2001, 2002}
    other = products.year_digests(f.withColumn("values", F.when(F.dayofmonth("date") == 3, F.array(F.lit(9.0), F.lit(None).cast("double"))).otherwise(F.col("values"))))
    assert other[2002] == one[2002] and other[2001] != one[2001]


def test_csv_stays_until_the_new_one_is_whole(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    products.write_csv(spark.createDataFrame([(1,)], "k int"), path)
    with pytest.raises(Exception):
        products.write_csv(spark.createDataFrame([(1,)], "k int").withColumn("k", F.raise_error(F.lit("broken")).cast("int")), path)
    assert products.read_csv(spark, path, "k int").first()["k"] == 1
    products.write_csv(spark.createDataFrame([(2,)], "k int"), path)
    assert products.read_csv(spark, path, "k int").first()["k"] == 2 and not [n for n in os.listdir(tmp_path) if n.endswith(".old")]
