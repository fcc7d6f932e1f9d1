"""Eight-neighbour connected components of thresholded fields on a grid that is periodic in longitude.

A field is a row, so labelling needs no shuffle: tasks label whole batches of
fields at once, every cell taking the least label of its neighbours and then
its label's label until nothing changes. A component's label is its least cell.
What follows is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import centroid, great_circle_km, signed_longitude_difference
from ..sources.fields import GridArrays, field_values


def label_fields(member: np.ndarray) -> np.ndarray:
    """Labels of boolean fields (field, row, column): the least cell number of the component, or -1."""
    b, n_lat, n_lon = member.shape
    none = n_lat * n_lon
    cell = np.arange(none, dtype=np.int64).reshape(n_lat, n_lon)
    label = np.where(member, cell, none)
    while True:
        side = np.minimum(np.minimum(np.roll(label, 1, axis=2), np.roll(label, -1, axis=2)), label)
        near = side.copy()
        near[:, 1:] = np.minimum(near[:, 1:], side[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], side[:, 1:])
        near = np.where(member, near, none)
        flat = np.concatenate([near.reshape(b, -1), np.full((b, 1), none)], axis=1)
        jumped = np.take_along_axis(flat, flat, axis=1)[:, :none].reshape(label.shape)
        if (jumped == label).all():
            return np.where(member, label, -1)
        label = jumped


def labelled(batches: Iterator[pa.RecordBatch], mask: np.ndarray, thresholds: tuple[float, ...]) -> Iterator[tuple[pa.RecordBatch, float, np.ndarray]]:
    """(rows, threshold, labels by field and cell) of fields (date, values) with value >= threshold inside the mask."""
    for b in batches:
        step = max(1, (1 << 22) // mask.size)
        for lo in range(0, b.num_rows, step):
            part = b.slice(lo, step)
            values = field_values(part.column(1), mask.size).reshape(-1, *mask.shape)
            for t in thresholds:
                with np.errstate(invalid="ignore"):
                    yield part, t, label_fields((values >= t) & mask).reshape(part.num_rows, -1)


def largest_labels(label: np.ndarray, area: np.ndarray) -> np.ndarray:
    """The label with the largest area (to the square metre) in each field, of equal ones the least; -1 in an empty field."""
    n = label.shape[1]
    total = np.zeros((len(label), n))
    at = label >= 0
    field, cell = np.nonzero(at)
    np.add.at(total, (field, label[at]), area[cell])
    return np.where(at.any(axis=1), np.argmax(np.round(total, 3), axis=1), -1)


def label_components(fields: DataFrame, grid: GridArrays, thresholds: tuple[float, ...]) -> DataFrame:
    """Sparse members (date, threshold_c, cell_id, component_id, largest) of cells with value >= threshold inside the mask.

    ``largest`` tells the members of the field's largest component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t, label in labelled(batches, grid.mask, thresholds):
            field, cell = np.nonzero(label >= 0)
            found = label[field, cell]
            top = found == largest_labels(label, grid.area)[field]
            yield pa.record_batch(
                [part.column(0).take(pa.array(field)), pa.array(np.full(len(field), t)), pa.array(cell.astype(np.int32)), pa.array(found.astype(np.int32)), pa.array(top)],
                names=["date", "threshold_c", "cell_id", "component_id", "largest"],
            )

    return fields.select("date", "values").mapInArrow(run, "date date, threshold_c double, cell_id int, component_id int, largest boolean")


def component_table(fields: DataFrame, grid: GridArrays, thresholds: tuple[float, ...]) -> DataFrame:
    """(date, threshold_c, component_id, number, n_cells, area_km2, x, y, z, largest) of each component, without a shuffle.

    ``number`` counts a field's components from 1 in the order of their least cells.
    """
    weights = (grid.area, *(grid.area * v for v in grid.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t, label in labelled(batches, grid.mask, thresholds):
            field, cell = np.nonzero(label >= 0)
            key, code = np.unique(field * grid.mask.size + label[field, cell], return_inverse=True)
            of, root = key // grid.mask.size, key % grid.mask.size
            sums = [np.bincount(code, weights=w[cell], minlength=len(key)).astype(float) for w in weights]  # whole numbers if there is nothing to count
            number = np.arange(len(key)) - np.searchsorted(of, of) + 1
            top = root == largest_labels(label, grid.area)[of]
            ints = [pa.array(x.astype(np.int32)) for x in (root, number)]
            yield pa.record_batch(
                [part.column(0).take(pa.array(of)), pa.array(np.full(len(key), t)), *ints, pa.array(np.bincount(code, minlength=len(key))), *(pa.array(x) for x in sums), pa.array(top)],
                names=["date", "threshold_c", "component_id", "number", "n_cells", "area_km2", "x", "y", "z", "largest"],
            )

    return fields.select("date", "values").mapInArrow(run, "date date, threshold_c double, component_id int, number int, n_cells long, area_km2 double, x double, y double, z double, largest boolean")


def component_areas(members: DataFrame, grid: DataFrame) -> DataFrame:
    """Area and cell count of each component from its members; combined before the shuffle. The grid is some million cells at most, so it is broadcast."""
    m = members.join(F.broadcast(grid.select("cell_id", "area_km2")), "cell_id")
    return m.groupBy("date", "threshold_c", "component_id").agg(F.sum("area_km2").alias("area_km2"), F.count(F.lit(1)).alias("n_cells"))


def daily_diagnostics(components: DataFrame) -> DataFrame:
    """A row for each date and threshold that has a component: areas, fractions, centroids and their distance."""
    g = components.groupBy("date", "threshold_c").agg(
        F.count(F.lit(1)).alias("component_count"),
        F.sum("area_km2").alias("total_area_km2"),
        F.sum("x").alias("fx"),
        F.sum("y").alias("fy"),
        F.sum("z").alias("fz"),
        *(F.max(F.when(F.col("largest"), F.col(c))).alias(f"top_{c}") for c in ("area_km2", "x", "y", "z")),
    )
    full, top = centroid(F.col("fx"), F.col("fy"), F.col("fz")), centroid(F.col("top_x"), F.col("top_y"), F.col("top_z"))
    fraction = F.try_divide(F.col("top_area_km2"), F.col("total_area_km2"))
    g = g.select(
        "date",
        F.year("date").alias("year"),
        "threshold_c",
        F.lit("8-neighbour periodic").alias("connectivity"),
        F.col("component_count").cast("int"),
        "total_area_km2",
        F.col("top_area_km2").alias("largest_component_area_km2"),
        fraction.alias("largest_component_area_fraction"),
        (F.col("total_area_km2") - F.col("top_area_km2")).alias("secondary_area_km2"),
        (1 - fraction).alias("fragmentation_index"),
        full[0].alias("full_centroid_lon_360"),
        full[1].alias("full_centroid_lat"),
        top[0].alias("largest_centroid_lon_360"),
        top[1].alias("largest_centroid_lat"),
    )
    return g.withColumns(
        {
            "delta_lon_deg": signed_longitude_difference(F.col("largest_centroid_lon_360"), F.col("full_centroid_lon_360")),
            "delta_lat_deg": F.col("largest_centroid_lat") - F.col("full_centroid_lat"),
            "centroid_distance_km": great_circle_km(F.col("full_centroid_lon_360"), F.col("full_centroid_lat"), F.col("largest_centroid_lon_360"), F.col("largest_centroid_lat")),
        }
    )


def days_without_component(fields: DataFrame, components: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(date, threshold_c) of the fields in which no cell reaches the threshold."""
    every = fields.select("date", F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold_c"))
    return every.join(components.select("date", "threshold_c").distinct(), ["date", "threshold_c"], "left_anti")


def require_components(fields: DataFrame, components: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """``components`` itself, or an error that names the first days without one."""
    empty = days_without_component(fields, components, thresholds).orderBy("date", "threshold_c").limit(10).collect()
    if empty:
        raise ValueError("no component: " + ", ".join(f"{r['date']} at {r['threshold_c']:g}" for r in empty))
    return components
