"""Fields from array files: bytes that the tests write themselves, against the arrays that they hold."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.plans import analysis
from gridspan.sources import arrays
from gridspan.sources import fields as src

DAY = dt.date(1999, 12, 20)


def classic(path, values, version=1, growing=True, kind=">i2", extra=True, units="days since 1999-12-20 12:00:00", level=True):
    """A classic file: time, lat, lon and the field, optionally with a second growing variable beside it."""
    n, n_lat, n_lon = values.shape
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    wide = ">q" if version == 5 else ">i"
    num = lambda x: struct.pack(wide, x)
    name = lambda s: num(len(s)) + pad(s.encode())
    text = lambda k, s: name(k) + struct.pack(">i", 2) + num(len(s)) + pad(s.encode())
    code = {">i2": 3, ">f4": 5, ">f8": 6}[kind]
    number = lambda k, c, f, v: name(k) + struct.pack(">i", c) + num(1) + pad(struct.pack(f, v))
    dims = [("time", 0 if growing else n), ("zlev", 1), ("lat", n_lat), ("lon", n_lon)]
    field = [0, 1, 2, 3] if level else [0, 2, 3]
    scaled = kind == ">i2"
    own = [number("scale_factor", 6, ">d", 0.01), number("add_offset", 6, ">d", 20.0), number("_FillValue", 3, ">h", -999)] if scaled else [number("missing_value", code, kind.replace("f4", "f").replace("f8", "d"), -9e9)]
    raw = np.where(np.isnan(values), -999 if scaled else -9e9, np.round((values - 20) * 100) if scaled else values).astype(kind)
    variables = [("time", [0], [text("units", units)], 6, np.arange(n).astype(">f8")), ("lat", [2], [], 5, np.zeros(n_lat, ">f4")), ("SST", field, own, code, raw)]
    if extra:
        variables.append(("other", [0], [], 3, np.arange(n).astype(">i2")))
    sizes = []
    for _, d, _, _, data in variables:
        exact = (data[0].nbytes if n else 0) if growing and d[0] == 0 else data.nbytes
        sizes.append(-(-exact // 4) * 4)
    tag = lambda t, items: struct.pack(">i", t if items else 0) + num(len(items)) + b"".join(items)

    def header(begins):
        off = (lambda x: struct.pack(">i", x)) if version == 1 else (lambda x: struct.pack(">q", x))
        parts = [name(v) + num(len(d)) + b"".join(num(x) for x in d) + tag(0x0C, a) + struct.pack(">i", c) + num(s) + off(b) for (v, d, a, c, _), s, b in zip(variables, sizes, begins)]
        return b"CDF" + bytes([version]) + num(n if growing else 0) + tag(0x0A, [name(k) + num(v) for k, v in dims]) + tag(0x0C, [text("title", "made")]) + tag(0x0B, parts)

    at, begins = len(header([0] * len(variables))), []
    fixed = [not (growing and d[0] == 0) for _, d, _, _, _ in variables]
    for f, s in zip(fixed, sizes):
        begins.append(at if f else None)
        at += s if f else 0
    for k, f in enumerate(fixed):
        if not f:
            begins[k] = at
            at += sizes[k]
    body = b"".join(pad(v[4].tobytes()) for v, f in zip(variables, fixed) if f)
    for step in range(n if growing else 0):
        body += b"".join(pad(v[4][step : step + 1].tobytes()) for v, f in zip(variables, fixed) if not f)
    path.write_bytes(header(begins) + body)


def values(n=70, seed=0):
    v = np.round(20 + np.random.default_rng(seed).random((n, 3, 4)) * 9, 2)
    v[3, 1, 2] = v[5, 0, 0] = np.nan
    return v


def rows(df):
    return {r["date"]: [np.nan if x is None else x for x in r["values"]] for r in df.collect()}


def equal(df, v, start=DAY):
    got = rows(df)
    assert sorted(got) == [start + dt.timedelta(days=k) for k in range(len(v))]
    for k in range(len(v)):
        np.testing.assert_allclose(got[start + dt.timedelta(days=k)], v[k].ravel(), atol=1e-6)


@pytest.mark.parametrize("version,growing,kind,extra,level", [(1, True, ">i2", True, True), (2, True, ">f4", True, False), (5, True, ">f8", True, True), (1, False, ">f8", True, True), (2, False, ">i2", False, False)])
def test_classic_files(spark, tmp_path, version, growing, kind, extra, level):
    classic(tmp_path / "a.nc", values(), version, growing, kind, extra, level=level)
    df = arrays.register(spark).read.format(arrays.FORMAT).option("path", str(tmp_path / "a.nc")).load()
    assert df.rdd.getNumPartitions() == 3
    equal(df, values())


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_array_files_and_archives(spark, tmp_path, save):
    arrays.register(spark)
    np.save(tmp_path / "a.npy", values().astype("<f4"))
    save(tmp_path / "b.npz", lat=np.zeros(3), analysed_sst=values()[:, None])
    for name in ("a.npy", "b.npz"):
        equal(spark.read.format(arrays.FORMAT).option("path", f"file://{tmp_path}/{name}").option("start_date", str(DAY)).load(), values())


def test_dates_reach_the_plan(spark, tmp_path):
    arrays.register(spark)
    for k in range(3):
        np.save(tmp_path / f"{k}.npy", values(40, k))
    one = spark.read.format(arrays.FORMAT).option("path", str(tmp_path)).option("start_date", str(DAY)).option("block_days", 10)
    df = one.load().filter(F.col("date").between(DAY + dt.timedelta(days=12), DAY + dt.timedelta(days=15)))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 12
    assert one.load().filter(F.col("date").isin(DAY, DAY + dt.timedelta(days=39))).rdd.getNumPartitions() == 6
    assert one.load().filter(F.col("date") < DAY).count() == 0 and one.load().count() == 120


def test_a_folder_of_files_equals_the_stored_form(spark, tmp_path):
    arrays.register(spark)
    classic(tmp_path / "y1.nc", values(12))
    classic(tmp_path / "y2.nc", values(20, 1), units="hours since 2000-01-01")
    df = spark.read.format(arrays.FORMAT).option("path", str(tmp_path)).load()
    assert df.count() == 32 and df.filter("date = '2000-01-01'").count() == 20
    df.write.parquet(f"{tmp_path}/stored")
    assert rows(spark.read.parquet(f"{tmp_path}/stored")).keys() == rows(df).keys()


def test_faults_are_named(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.zeros((3, 4)))
    with pytest.raises(ValueError, match="no fields by time"):
        arrays.layout_of(str(tmp_path / "flat.npy"), start="2000-01-01")
    np.save(tmp_path / "levels.npy", np.zeros((3, 2, 4, 5)))
    with pytest.raises(ValueError, match="no fields by time"):
        arrays.layout_of(str(tmp_path / "levels.npy"), start="2000-01-01")
    np.save(tmp_path / "a.npy", values())
    with pytest.raises(ValueError, match="start_date"):
        arrays.layout_of(str(tmp_path / "a.npy"))
    np.savez(tmp_path / "b.npz", other=values())
    with pytest.raises(KeyError, match="none of sst"):
        arrays.layout_of(str(tmp_path / "b.npz"), start="2000-01-01")
    (tmp_path / "c.nc").write_bytes(b"\x89HDF")
    with pytest.raises(ValueError, match="no classic NetCDF"):
        arrays.layout_of(str(tmp_path / "c.nc"))
    classic(tmp_path / "d.nc", values(), units="months since 1990-01-01")
    with pytest.raises(ValueError, match="are not read"):
        arrays.layout_of(str(tmp_path / "d.nc"))
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        arrays.files_of(str(tmp_path / "none"))


def test_a_project_of_array_files(spark, tmp_path):
    src.regular_grid(spark, 3, 4, -60.0, 60.0, 45.0, 90.0).write.parquet(f"{tmp_path}/grid")
    (tmp_path / "arrays").mkdir()
    classic(tmp_path / "arrays" / "1999.nc", values(12))
    classic(tmp_path / "arrays" / "2000.nc", values(31, 1), units="days since 2000-01-01")
    p = analysis.Project(spark, str(tmp_path), analysis.Settings("1999-12-22", "2000-01-20", (22.0, 24.0), box_threshold=22.0))
    assert p.fields().count() == 30 and p.of_years([2000]).count() == 20
    daily = p.daily()
    assert daily.count() == 60 and daily.filter("largest_component_area_km2 <= 0").count() == 0
