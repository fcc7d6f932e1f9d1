"""Occurrence, persistence and detachment of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fields import GridArrays, field_values
from .labelling import labelled, largest_labels


def longest_runs(members: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Longest run of consecutive dates of each key (gaps and islands over members only)."""
    w = Window.partitionBy(*keys).orderBy(date)
    days = members.select(*keys, date).distinct()
    island = days.withColumn("island", F.date_diff(F.col(date), F.lit("1970-01-01").cast("date")) - F.row_number().over(w))
    return island.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").cast("int").alias("longest_run"))


#: A stretch of consecutive days of a cell: counts, the run that begins with it, the run that ends with it and the longest in it.
STRETCH = "threshold_c double, cell_id int, first_day int, days int, n_valid long, n_canonical long, n_lcc long, prefix int, suffix int, best int"


class _Stretch:
    """What a task counts of consecutive days, for every cell inside the mask and every threshold; row 0 of ``valid`` needs no threshold."""

    def __init__(self, day: int, n_thresholds: int, n_cells: int):
        self.first = self.last = day
        self.valid = np.zeros(n_cells, np.int64)
        self.canonical, self.lcc = (np.zeros((n_thresholds, n_cells), np.int64) for _ in range(2))
        self.prefix, self.suffix, self.best = (np.zeros((n_thresholds, n_cells), np.int32) for _ in range(3))

    def add(self, day: int, k: int, member: np.ndarray, top: np.ndarray) -> None:
        """A day at threshold ``k``."""
        self.last = day
        self.canonical[k] += member
        self.lcc[k] += top
        run = self.suffix[k]
        run += 1
        run[~top] = 0
        np.maximum(self.best[k], run, out=self.best[k])
        whole = run == day - self.first + 1
        self.prefix[k][whole] = run[whole]

    def rows(self, cells: np.ndarray, thresholds: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
        """Cells that have a value, and for each threshold those that are ever a member; the others add nothing."""
        names = [x.split(" ")[0] for x in STRETCH.split(", ")]
        for k in range(-1, len(thresholds)):
            at = np.flatnonzero(self.valid if k < 0 else self.canonical[k])
            n, none = len(at), np.zeros(len(at), np.int64)
            counts = [self.valid[at], none, none] if k < 0 else [none, self.canonical[k][at], self.lcc[k][at]]
            runs = [none.astype(np.int32)] * 3 if k < 0 else [x[k][at] for x in (self.prefix, self.suffix, self.best)]
            head = [pa.nulls(n, pa.float64()) if k < 0 else pa.array(np.full(n, thresholds[k])), pa.array(cells[at].astype(np.int32)), pa.array(np.full(n, self.first, np.int32)), pa.array(np.full(n, self.last - self.first + 1, np.int32))]
            yield pa.record_batch([*head, *map(pa.array, counts), *map(pa.array, runs)], names=names)


def stretches(fields: DataFrame, grid: GridArrays, thresholds: tuple[float, ...]) -> DataFrame:
    """``STRETCH`` rows of every cell for every stretch of consecutive days that a task reads; a null threshold has the valid days.

    Fields are labelled once. A task sorts the days it reads and counts on while
    they follow each other, so the rows grow with cells and tasks, not with days.
    """
    inside = np.flatnonzero(grid.mask.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            step = max(1, (1 << 22) // grid.mask.size)
            for part in (b.slice(lo, step) for lo in range(0, b.num_rows, step)):
                days = part.column(0).cast(pa.int32()).to_numpy()
                valid = ~np.isnan(field_values(part.column(1), grid.mask.size)[:, inside])
                found = []
                for _, _, label in labelled(iter([part]), grid.mask, thresholds):
                    top = label == largest_labels(label, grid.area)[:, None]
                    found.append(((label >= 0)[:, inside], (top & (label >= 0))[:, inside]))
                for row, day in enumerate(days.tolist()):
                    if now is not None and day != now.last + 1:
                        yield from now.rows(inside, thresholds)
                        now = None
                    now = now or _Stretch(day, len(thresholds), len(inside))
                    now.valid += valid[row]
                    now.last = day
                    for k, (member, top) in enumerate(found):
                        now.add(day, k, member[row], top[row])
        if now is not None:
            yield from now.rows(inside, thresholds)

    return fields.select("date", "values").filter("date is not null").sortWithinPartitions("date").mapInArrow(run, STRETCH)


def merged_runs(parts: Column) -> Column:
    """The longest run of an array of stretches (first_day, days, prefix, suffix, best): in order of days, a run goes on where a stretch begins the day after the one before. A day in two stretches is an error."""
    start = F.struct(F.lit(None).cast("int").alias("after"), F.lit(0).alias("run"), F.lit(0).alias("longest"))

    def step(state: Column, x: Column) -> Column:
        twice = F.when(x["first_day"] < state["after"], F.raise_error(F.lit("a day occurs twice in the record")).cast("int")).otherwise(x["first_day"])
        before = F.when(twice == state["after"], state["run"]).otherwise(F.lit(0))
        run = F.when(x["prefix"] == x["days"], before + x["days"]).otherwise(x["suffix"])
        return F.struct((x["first_day"] + x["days"]).alias("after"), run.alias("run"), F.greatest(state["longest"], x["best"], before + x["prefix"]).alias("longest"))

    return F.aggregate(F.array_sort(parts), start, step, lambda state: state["longest"])


def cell_statistics(fields: DataFrame, grid: GridArrays, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold_c, cell_id, n_valid, n_canonical, n_lcc, longest_run) for every valid cell; zero where it never occurs.

    One pass over the fields; what is shuffled is a row for each cell and stretch of days.
    """
    s = stretches(fields, grid, thresholds)
    k = ["threshold_c", "cell_id"]
    part = F.when(F.col("threshold_c").isNotNull(), F.struct("first_day", "days", "prefix", "suffix", "best"))
    found = s.groupBy(*k).agg(*(F.sum(c).alias(c) for c in ("n_valid", "n_canonical", "n_lcc")), merged_runs(F.collect_list(part)).alias("longest_run"))
    # a row for each cell, taken apart by threshold; a threshold at which nothing occurs has zeros
    own = F.map_from_entries(F.collect_list(F.when(F.col("threshold_c").isNotNull(), F.struct("threshold_c", F.struct("n_canonical", "n_lcc", "longest_run")))))
    cells = found.groupBy("cell_id").agg(F.sum("n_valid").alias("n_valid"), own.alias("own")).filter("n_valid > 0")
    rows = cells.select("cell_id", "n_valid", "own", F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold_c"))
    at = F.try_element_at("own", F.col("threshold_c"))
    return rows.select(*k, "n_valid", *(F.coalesce(at[c], F.lit(0)).cast(kind).alias(c) for c, kind in (("n_canonical", "long"), ("n_lcc", "long"), ("longest_run", "int"))))


def cell_percentages(stats: DataFrame) -> DataFrame:
    """(threshold_c, cell_id, canonical_pct, lcc_pct, detached_pct, mostly_lcc): shares of the valid days."""
    pct = lambda c: F.try_divide(c * 100.0, F.col("n_valid"))
    lcc = pct(F.col("n_lcc"))
    return stats.select("threshold_c", "cell_id", pct(F.col("n_canonical")).alias("canonical_pct"), lcc.alias("lcc_pct"), pct(F.col("n_canonical") - F.col("n_lcc")).alias("detached_pct"), (lcc >= 50.0).alias("mostly_lcc"))


def run_scale(stats: DataFrame, share: float = 0.99) -> DataFrame:
    """(threshold_c, positive_cells, scale): a high percentile of the longest runs of the cells that have any."""
    return stats.filter("longest_run > 0").groupBy("threshold_c").agg(F.count(F.lit(1)).alias("positive_cells"), F.percentile("longest_run", F.lit(share)).alias("scale"))


def _weighted(x: Column, area: Column) -> Column:
    return F.sum(x * area) / F.sum(area)


def occurrence_summary(stats: DataFrame, grid: DataFrame) -> DataFrame:
    s = stats.join(F.broadcast(grid.select("cell_id", "area_km2")), "cell_id").withColumn("f", F.try_divide("n_lcc", "n_valid"))
    run = F.when(F.col("longest_run") > 0, F.col("longest_run"))
    return s.groupBy("threshold_c").agg(
        F.count(F.lit(1)).alias("valid_grid_cells"),
        _weighted(F.col("f"), F.col("area_km2")).alias("area_weighted_mean_occurrence_fraction"),
        *(F.count_if(F.col("f") >= c).alias(f"grid_cells_occurrence_ge_{n}") for c, n in ((0.1, "0p10"), (0.5, "0p50"), (0.9, "0p90"))),
        F.median(run).alias("median_longest_run_days_positive_cells"),
        F.percentile(run, F.lit(0.95)).alias("p95_longest_run_days_positive_cells"),
        F.max("longest_run").alias("maximum_longest_run_days"),
    )


def detached_summary(stats: DataFrame, grid: DataFrame, cutoffs: tuple[float, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """How often cells are members outside the largest component. Fewer members than largest-component days is an error."""
    s = stats.join(F.broadcast(grid.select("cell_id", "area_km2")), "cell_id").withColumn("gap", F.col("n_canonical") - F.col("n_lcc"))
    s = s.withColumn("gap", F.when(F.col("gap") >= 0, F.col("gap")).otherwise(F.raise_error(F.lit("a cell is in the largest component more often than a member")).cast("long")))
    pct = F.try_divide(F.col("gap") * 100.0, F.col("n_valid"))
    area = F.col("area_km2")
    return s.withColumn("pct", pct).groupBy("threshold_c").agg(
        _weighted(F.col("pct"), area).alias("area_weighted_mean_detached_pct"),
        (F.try_divide(F.sum(F.col("gap") * area), F.sum(F.col("n_canonical") * area)) * 100).alias("detached_area_time_pct"),
        F.max("pct").alias("maximum_detached_pct"),
        F.max_by("cell_id", F.struct("pct", -F.col("cell_id"))).alias("maximum_cell_id"),
        *(F.sum(F.when(F.col("pct") >= c, area).otherwise(0.0)).alias(f"area_km2_ge_{c}") for c in cutoffs),
        *(F.count_if(F.col("pct") >= c).alias(f"cells_ge_{c}") for c in cutoffs),
    )
