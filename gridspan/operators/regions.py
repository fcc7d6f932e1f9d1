"""Comparison of region definitions: mask, largest component, fixed box with a strict or an inclusive threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fields import GridArrays, field_values
from .labelling import label_fields, largest_labels

SLACK = 1e-10
NAMES = ("canonical", "lcc", "box_strict", "box_inclusive")


def in_box(grid: GridArrays, lat: tuple[float, float], lon: tuple[float, float]) -> np.ndarray:
    """Cells of a box, its borders included."""
    between = lambda x, ends: (x >= ends[0] - SLACK) & (x <= ends[1] + SLACK)
    return between(grid.lat, lat) & between(grid.lon, lon)


def definition_daily(fields: DataFrame, grid: GridArrays, threshold: float, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Area, integral and mean of each definition and the overlap of largest component and strict box, a row a date.

    Definitions are the mask with values from the threshold, its largest
    component, and a box with values above or from the threshold, whatever the
    mask. A field is labelled and summed where it is read: no cell leaves its
    task and nothing is shuffled. Fields without a value give no row.
    """
    box = in_box(grid, lat, lon)
    schema = "date date, " + ", ".join(f"{d}_area_km2 double, {d}_sst_area_integral double" for d in NAMES) + ", intersection_area_km2 double, union_area_km2 double, lcc_outside_box_area_km2 double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, (1 << 22) // grid.mask.size)
            for lo in range(0, b.num_rows, step):
                v = field_values(b.column(1).slice(lo, step), grid.mask.size)
                some = ~np.isnan(v).all(axis=1)
                v = v[some]
                with np.errstate(invalid="ignore"):
                    least, above = v >= threshold, v > threshold
                label = label_fields((least & grid.mask.ravel()).reshape(-1, *grid.mask.shape)).reshape(len(v), -1)
                lcc = (label >= 0) & (label == largest_labels(label, grid.area)[:, None])
                flags = {"canonical": label >= 0, "lcc": lcc, "box_strict": above & box, "box_inclusive": least & box}
                weighted = np.where(np.isnan(v), 0.0, v) * grid.area
                cols = [b.column(0).slice(lo, step).filter(pa.array(some))]
                for f in flags.values():
                    cols += [pa.array(f @ grid.area), pa.array((f * weighted).sum(axis=1), mask=~f.any(axis=1))]
                strict = flags["box_strict"]
                cols += [pa.array(f @ grid.area) for f in (lcc & strict, lcc | strict, lcc & ~strict)]
                yield pa.record_batch(cols, names=[x.split(" ")[0] for x in schema.split(", ")])

    out = fields.select("date", "values").mapInArrow(run, schema)
    means = {f"{d}_mean_sst": F.try_divide(f"{d}_sst_area_integral", f"{d}_area_km2") for d in NAMES}
    return out.withColumns(means | {"area_jaccard": F.try_divide("intersection_area_km2", "union_area_km2")})


def unpivot_definitions(daily: DataFrame) -> DataFrame:
    """(date, definition, area_km2, integral, mean_sst)."""
    rows = F.array(*(F.struct(F.lit(d).alias("definition"), F.col(f"{d}_area_km2").alias("area_km2"), F.col(f"{d}_sst_area_integral").alias("integral"), F.col(f"{d}_mean_sst").alias("mean_sst")) for d in NAMES))
    return daily.select("date", F.inline(rows))


def definition_summary(tidy: DataFrame, by: list[str]) -> DataFrame:
    """Means of daily values and the ratio of sums, by definition and ``by``."""
    return tidy.groupBy("definition", *by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("area_km2").alias("mean_daily_area_km2"),
        F.median("area_km2").alias("median_daily_area_km2"),
        F.avg("mean_sst").alias("mean_daily_mean_sst"),
        F.try_divide(F.sum("integral"), F.sum("area_km2")).alias("area_time_weighted_mean_sst"),
    )


def direct_comparison(daily: DataFrame, by: list[str]) -> DataFrame:
    """Daily differences of largest component and strict box and their overlap, by ``by``; the column ``definition`` names the row."""
    d = F.col("lcc_area_km2") - F.col("box_strict_area_km2")
    return daily.groupBy(*by).agg(
        F.lit("lcc_minus_box_strict").alias("definition"), F.count(F.lit(1)).alias("n_days"), F.avg(d).alias("mean_daily_difference_km2"), F.median(d).alias("median_daily_difference_km2"),
        (F.try_divide(F.avg(d), F.avg("box_strict_area_km2")) * 100).alias("mean_relative_difference_pct"), F.avg("area_jaccard").alias("mean_area_jaccard"), F.avg("intersection_area_km2").alias("mean_intersection_area_km2"), F.avg("lcc_outside_box_area_km2").alias("mean_lcc_outside_box_area_km2"),
    )


def period_summary(daily: DataFrame, periods: list[tuple[str, int, int]]) -> DataFrame:
    """The definitions' summary and their direct comparison, for the periods (name, first year, last year) that the record covers; periods may overlap."""
    p = daily.sparkSession.createDataFrame(periods, "period string, first_year int, last_year int")
    within = F.year("date").between(F.col("first_year"), F.col("last_year"))
    span = daily.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"))
    p = p.crossJoin(span).filter("first_year >= a and last_year <= b").select("period", "first_year", "last_year")  # a handful of periods
    tidy = unpivot_definitions(daily).join(F.broadcast(p), within)
    return definition_summary(tidy, ["period"]).unionByName(direct_comparison(daily.join(F.broadcast(p), within), ["period"]), allowMissingColumns=True)
