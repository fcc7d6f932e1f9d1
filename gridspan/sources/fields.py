"""Gridded daily fields: sources, grids and the long form."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, finite
from ..session import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; the package goes to the workers with it."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def resolve_column(df: DataFrame, candidates: Iterable[str], kind: str) -> str:
    """The first candidate that the table has, whatever its case."""
    by_name = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in by_name:
            return by_name[c.lower()]
    raise KeyError(f"no {kind} column among {df.columns}")


def regular_grid(spark: SparkSession, n_lat: int, n_lon: int, lat0: float, dlat: float, lon0: float, dlon: float, masked: Iterable[int] = ()) -> DataFrame:
    """(cell_id, i, j, lat, lon, in_mask, area_km2, bx, by, bz) of a regular grid, row by row from the south.

    Cell edges are midpoints, extrapolated at the ends and clipped at the
    poles; areas are exact on the sphere. A grid has some million cells at
    most, whatever the length of the record, so it may be broadcast.
    """
    g = spark.range(n_lat * n_lon).select(F.col("id").cast("int").alias("cell_id"))
    g = g.withColumn("i", F.floor(F.col("cell_id") / n_lon).cast("int")).withColumn("j", F.pmod("cell_id", F.lit(n_lon)).cast("int"))
    g = g.withColumn("lat", F.lit(lat0) + F.lit(dlat) * F.col("i")).withColumn("lon", F.pmod(F.lit(lon0) + F.lit(dlon) * F.col("j"), F.lit(360.0)))
    north, south = F.least(F.col("lat") + dlat / 2, F.lit(90.0)), F.greatest(F.col("lat") - dlat / 2, F.lit(-90.0))
    la, lo = F.radians("lat"), F.radians("lon")
    return g.select(
        "*",
        (~F.col("cell_id").isin(list(masked))).alias("in_mask"),
        (F.lit(EARTH_RADIUS_KM**2) * (F.sin(F.radians(north)) - F.sin(F.radians(south))) * F.radians(F.lit(dlon))).alias("area_km2"),
        (F.cos(la) * F.cos(lo)).alias("bx"),
        (F.cos(la) * F.sin(lo)).alias("by"),
        F.sin(la).alias("bz"),
    )


def axis_edges(axis: DataFrame, value: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """(value, low, high) of an axis of at least two distinct values; the axis is a small dimension table."""
    w = Window.orderBy(value)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    low, high = F.coalesce((v + before) / 2, v - (after - v) / 2), F.coalesce((v + after) / 2, v + (v - before) / 2)
    if clip:
        low, high = F.greatest(low, F.lit(clip[0])), F.least(high, F.lit(clip[1]))
    return axis.select(v, low.alias("low"), high.alias("high"))


def fields(df: DataFrame, date: Column, values: str) -> DataFrame:
    """(date, values array<double>): a row for each field, NaN and infinity as null."""
    return df.select(date.alias("date"), F.transform(F.col(values), lambda x: finite(x.cast("double"))).alias("values"))


def time_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; the comparison reaches the Parquet scan."""
    return df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def cells(f: DataFrame, grid: DataFrame) -> DataFrame:
    """The long form: a row for each field and cell, with the grid's columns."""
    long = f.select("date", F.posexplode("values").alias("cell_id", "sst"))
    return long.join(F.broadcast(grid), "cell_id")


#: Cells of a grid at most: what every task holds of it, and what is broadcast.
MAX_CELLS = 1 << 24


@dataclass(frozen=True)
class GridArrays:
    """A grid as tasks hold it: by cell, areas, unit vectors and positions; the mask by row and column."""

    mask: np.ndarray
    area: np.ndarray
    vectors: np.ndarray
    lat: np.ndarray
    lon: np.ndarray


def grid_arrays(grid: DataFrame) -> GridArrays:
    """The grid (cell_id, i, j, lat, lon, in_mask, area_km2, bx, by, bz) on the driver: a dimension whose size does not depend on the record."""
    columns = ["cell_id", "i", "j", "lat", "lon", "in_mask", "area_km2", "bx", "by", "bz"]
    g = grid.select(columns).limit(MAX_CELLS + 1).toPandas().sort_values("cell_id")
    n_lat, n_lon = int(g["i"].max()) + 1, int(g["j"].max()) + 1
    if len(g) > MAX_CELLS or len(g) != n_lat * n_lon or (g["cell_id"].to_numpy() != np.arange(len(g))).any():
        raise ValueError(f"{len(g)} cells do not make a grid of {n_lat} x {n_lon}, or are more than {MAX_CELLS}")
    return GridArrays(g["in_mask"].to_numpy(bool).reshape(n_lat, n_lon), g["area_km2"].to_numpy(), g[["bx", "by", "bz"]].to_numpy().T.copy(), g["lat"].to_numpy(), g["lon"].to_numpy())


def field_values(column: pa.Array, n_cells: int) -> np.ndarray:
    """Values by field and cell, NaN where null. A field of another size is an error."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if (n != n_cells).any():
        raise ValueError(f"a field has {n[n != n_cells][0]} cells where the grid has {n_cells}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_cells)


def masked(f: DataFrame, grid: GridArrays) -> DataFrame:
    """The fields with null outside the mask; a field of another shape is an error."""
    outside = pa.array(~grid.mask.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = field_values(b.column(1), grid.mask.size)
            flat = pa.array(v.ravel(), mask=np.isnan(v.ravel()) | np.tile(outside.to_numpy(zero_copy_only=False), len(v)))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * grid.mask.size, pa.int32()), flat)], names=["date", "values"])

    return f.select("date", "values").mapInArrow(run, "date date, values array<double>")


def normalised_axes(lat: Sequence[float], lon: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lat, lon, order): ascending axes with longitudes in [0, 360), and the old cell of each new one. Repeated values are an error."""
    lat, lon = np.asarray(lat, float), np.mod(np.asarray(lon, float), 360.0)
    for name, axis in (("latitude", lat), ("longitude", lon)):
        if len(np.unique(axis)) != len(axis):
            raise ValueError(f"a {name} is repeated")
    i, j = np.argsort(lat), np.argsort(lon)
    return lat[i], lon[j], (i[:, None] * len(lon) + j[None, :]).ravel()


def reordered(f: DataFrame, order: np.ndarray) -> DataFrame:
    """The fields with their cells in another order, that of ``normalised_axes``; done where the field is, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = field_values(b.column(1), len(order))[:, order]
            flat = pa.array(v.ravel(), mask=np.isnan(v.ravel()))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(order), pa.int32()), flat)], names=["date", "values"])

    return f.select("date", "values").mapInArrow(run, "date date, values array<double>")


def require_conformity(lat: Sequence[float], lon: Sequence[float], grid: GridArrays, tolerance: float = 1e-8) -> None:
    """An error unless a file's axes are the grid's: fields are never interpolated."""
    n_lat, n_lon = grid.mask.shape
    for name, got, want in (("latitudes", lat, grid.lat.reshape(n_lat, n_lon)[:, 0]), ("longitudes", lon, grid.lon.reshape(n_lat, n_lon)[0])):
        got = np.asarray(got, float)
        if got.shape != want.shape or not (np.abs(got - want) <= tolerance).all():
            raise ValueError(f"the {name} are not those of the grid")


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """``column`` without an outer array of one element, as of a level or a member; more elements are an error."""
    one = F.when(F.size(column) == 1, F.element_at(column, 1)).otherwise(F.raise_error(F.lit(f"{column} has several levels")))
    return df.withColumn(column, one)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A stored grid; absent tables and columns are errors, and a mask is never rebuilt."""
    grid = ship(spark).read.parquet(path)
    lacking = {"cell_id", "i", "j", "lat", "lon", "in_mask", "area_km2", "bx", "by", "bz"} - set(grid.columns)
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(sorted(lacking))}")
    return grid


def read_years(spark: SparkSession, pattern: str, first: int, last: int) -> DataFrame:
    """The yearly tables of a span, ``{year}`` in ``pattern`` standing for the year; every missing year is named in the error."""
    paths = {y: pattern.format(year=y) for y in range(first, last + 1)}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    lacking = [str(y) for y, p in paths.items() if not (q := hadoop(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)]
    if lacking:
        raise FileNotFoundError(f"no table for {', '.join(lacking)}")
    return ship(spark).read.parquet(*paths.values())


def on_dates(f: DataFrame, dates: Sequence[str]) -> DataFrame:
    """The rows of a few dates, all of which must be there; the dates reach the Parquet scan."""
    wanted = sorted({str(x) for x in dates})
    found = f.filter(F.col("date").isin([F.lit(x).cast("date") for x in wanted]))
    n = found.select("date").distinct().count()
    if n != len(wanted):
        raise ValueError(f"of {len(wanted)} dates only {n} are there")
    return found
