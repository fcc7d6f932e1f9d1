"""The whole analysis of a stored record, from daily fields to tables, checks and a manifest.

A project folder holds ``grid`` and ``fields`` (date, values) as Parquet, or
instead of the latter a folder ``arrays`` of array files. The
daily tables are stored by year, so a run that was cut off goes on where it
stood; tables of cells are stored once. What is derived from them is small and
written as CSV below ``tables``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, decomposition, labelling, occurrence, regions, spectral, timeline, trends, wavelet
from ..sources import arrays
from ..sources import fields as src
from ..sources import products

VERSION = "2"
# The historical box in degrees north and east, its threshold, the periods of the comparison,
# the bands of periods in days (they overlap and are not summed), Welch's segment and overlap in days.
BOX_LAT, BOX_LON, BOX_THRESHOLD = (-20.0, 20.0), (120.0, 210.0), 28.0
PERIODS = (("1982-1991", 1982, 1991), ("1982-2025", 1982, 2025))
BANDS = (("annual_strict", 336.0, 378.0), ("quasi_biennial", 550.0, 1096.0), ("interannual_broad", 805.0, 2922.0))
SEGMENT, OVERLAP = 2920, 1460
AREA = "largest_component_area_km2"
METRICS = ("total_area_km2", "largest_component_area_km2", "secondary_area_km2", "largest_component_area_fraction", "fragmentation_index", "component_count")
DISTANCE = "centroid_distance_km"
#: Tables without which a run is not whole.
REQUIRED = ("record_check", "annual_summary", "trend_statistics", "monthly_climatology", "occurrence_summary", "detached_summary", "stl_summary", "welch_summary", "welch_bands", "wavelet_bands", "definition_annual", "definition_trends", "release_checks")
CELL_COLUMNS = ("threshold_c", "cell_id", "n_valid", "n_canonical", "n_lcc", "longest_run")


@dataclass(frozen=True)
class Settings:
    """What a run depends on; it is stored with the results and compared with them later."""

    start: str
    end: str
    thresholds: tuple[float, ...] = (28.0, 28.5, 29.0)
    box_lat: tuple[float, float] = BOX_LAT
    box_lon: tuple[float, float] = BOX_LON
    box_threshold: float = BOX_THRESHOLD
    periods: tuple[tuple[str, int, int], ...] = PERIODS
    bands: tuple[tuple[str, float, float], ...] = BANDS
    segment: int = SEGMENT
    overlap: int = OVERLAP

    def __post_init__(self) -> None:
        if self.box_lat[0] > self.box_lat[1] or self.box_lon[0] > self.box_lon[1]:
            raise ValueError(f"the box {self.box_lat} x {self.box_lon} has no cells")
        if any(first > last for _, first, last in self.periods):
            raise ValueError("a period ends before it begins")
        if self.start > self.end:
            raise ValueError(f"the record would start on {self.start}, after its end on {self.end}")


@dataclass
class Project:
    spark: SparkSession
    root: str
    settings: Settings
    no_fields: bool = False
    check_inputs: bool = False

    def __post_init__(self) -> None:
        self.grid_table = src.read_grid(self.spark, f"{self.root}/grid")
        self.grid = src.grid_arrays(self.grid_table)

    def fields(self) -> DataFrame:
        if self.no_fields:
            raise RuntimeError("a table has to be built, but the fields may not be read")
        if products.exists(self.spark, f"{self.root}/fields"):
            stored = self.spark.read.parquet(f"{self.root}/fields")
        else:  # array files as they come; dates of files without a time axis begin with the record
            stored = arrays.register(self.spark).read.format(arrays.FORMAT).option("path", f"{self.root}/arrays").option("start_date", self.settings.start).load()
        return src.time_range(stored, self.settings.start, self.settings.end)

    def of_years(self, years: list[int]) -> DataFrame:
        """The fields of some years; each run of years is a range of dates, which reaches the scan."""
        own, spans = sorted(years), []
        for y in own:
            if spans and spans[-1][1] == y - 1:
                spans[-1][1] = y
            else:
                spans.append([y, y])
        wanted = F.lit(False)
        for a, b in spans:
            wanted = wanted | F.col("date").between(F.lit(f"{a:04d}-01-01").cast("date"), F.lit(f"{b:04d}-12-31").cast("date"))
        return self.fields().filter(wanted)

    def digests(self) -> dict[int, str] | None:
        """Digests of each year's fields, where stored years are to be held against them: one more pass over the fields."""
        return products.year_digests(self.fields()) if self.check_inputs else None

    def daily(self, rebuild: bool = False) -> DataFrame:
        """Diagnostics by date and threshold; a day without a component at any threshold is an error."""
        s = self.settings

        def build(years: list[int]) -> DataFrame:
            return labelling.daily_diagnostics(labelling.component_table(self.of_years(years), self.grid, s.thresholds))

        table = products.yearly(self.spark, f"{self.root}/daily", build, s.start, s.end, rebuild, self.digests())
        labelling.require_components(table.select("date").distinct(), table, s.thresholds)  # of what was stored: fields are labelled once
        return checks.require_thresholds(table, s.thresholds)

    def definitions(self, rebuild: bool = False) -> DataFrame:
        s = self.settings
        return products.yearly(self.spark, f"{self.root}/definitions", lambda years: regions.definition_daily(self.of_years(years), self.grid, s.box_threshold, s.box_lat, s.box_lon), s.start, s.end, rebuild, self.digests())

    def cells(self, rebuild: bool = False) -> DataFrame:
        def build() -> DataFrame:
            return occurrence.cell_statistics(self.fields(), self.grid, self.settings.thresholds)

        return products.load_or_build(self.spark, f"{self.root}/cells", build, CELL_COLUMNS, rebuild)

    def store(self, name: str, table: DataFrame) -> DataFrame:
        """A product that is no small table, as Parquet below ``products``, read again from there."""
        path = f"{self.root}/products/{name}"
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def write(self, name: str, table: DataFrame, order: list[str]) -> None:
        products.write_csv(table.orderBy(*order), f"{self.root}/tables/{name}.csv")


def long(table: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """(keys, metric, value) rows."""
    return table.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))


def trend_rows(annual: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """A trend row for each key and metric of annual means; slopes by decade."""
    xy = long(annual, [*keys, "year"], metrics).select(*keys, "metric", F.col("year").cast("double").alias("x"), F.col("value").alias("y"))
    return trends.trend_table(xy, [*keys, "metric"], 10.0)


def detached(p: Project, rebuild: bool = False) -> None:
    """The tables of cells outside the largest component, from stored counts."""
    p.write("detached_summary", occurrence.detached_summary(p.cells(rebuild), p.grid_table), ["threshold_c"])


def components(p: Project, rebuild_daily: bool = False, rebuild_cells: bool = False) -> None:
    """The tables of the largest component and its years, months and cells."""
    daily, key = p.daily(rebuild_daily), ["threshold_c"]
    complete = checks.record_check(daily, key, p.settings.start, p.settings.end, [*METRICS])
    p.write("record_check", complete, key)
    if complete.filter("not complete").head(1):
        raise ValueError("the daily record is not complete: see tables/record_check.csv")
    annual = timeline.annual_metrics(daily, key, (*METRICS, DISTANCE))
    p.write("annual_summary", annual, ["threshold_c", "year"])
    p.write("trend_statistics", trend_rows(annual, key, METRICS), ["threshold_c", "metric"])
    p.write("monthly_climatology", timeline.monthly_metrics(daily, key, (*METRICS[:4], METRICS[5])), ["threshold_c", "month"])
    p.write("occurrence_summary", occurrence.occurrence_summary(p.cells(rebuild_cells), p.grid_table), key)
    detached(p)


def variability(p: Project) -> None:
    """Decomposition, spectra and wavelets of the largest component's daily area, a series for each threshold.

    The days of the decomposition, the spectrum and the wavelet's scales are
    stored as Parquet below ``products``; their summaries are tables.
    """
    s, key = p.settings, ["threshold_c"]
    series = p.daily().select("threshold_c", "date", F.col(AREA).alias("value"))
    parts = p.store("decomposition", decomposition.stl_components(series, key))
    p.write("stl_summary", decomposition.stl_summary(parts, key), ["threshold_c", "metric"])
    days, statistics = spectral.series_statistics(series, key)
    spectrum = p.store("spectrum", spectral.spectrum_of(days, statistics, key, s.segment, s.overlap))
    p.write("welch_summary", spectral.welch_summary(series, key, s.segment, s.overlap), key)
    p.write("welch_bands", spectral.band_variance(spectrum, statistics.select("threshold_c", "variance"), key, list(s.bands)), ["threshold_c", "minimum_period_days"])
    power = p.store("wavelet", wavelet.wavelet_power(series, key))
    p.write("wavelet_bands", wavelet.wavelet_bands(power, key, list(s.bands)), ["threshold_c", "minimum_period_days"])


def snapshots(p: Project) -> None:
    """The fields of the days that stand for the record at the first threshold: the largest component's share nearest its median, and at its least."""
    share = p.daily().filter(F.col("threshold_c") == p.settings.thresholds[0]).select("date", F.col("largest_component_area_fraction").alias("share"))
    middle = share.agg(F.median("share").alias("m"))  # one row
    near = F.struct(F.abs(F.col("share") - F.col("m")), "date")
    days = share.crossJoin(F.broadcast(middle)).agg(F.min_by("date", near).alias("median"), F.min_by("date", F.struct("share", "date")).alias("minimum")).first()
    chosen = p.spark.createDataFrame([("median", days["median"]), ("minimum", days["minimum"])], "stands_for string, date date")
    p.write("representative_dates", chosen, ["stands_for"])
    p.store("snapshots", src.on_dates(p.fields(), [days["median"], days["minimum"]]))


def comparison(p: Project, rebuild: bool = False, reference: bool = True) -> None:
    """The tables of the definitions, and the checks that let a release pass."""
    daily = p.definitions(rebuild)
    tidy = regions.unpivot_definitions(daily).withColumn("year", F.year("date"))
    annual = regions.definition_summary(tidy, ["year"])
    p.write("definition_annual", annual, ["definition", "year"])
    if p.settings.periods:  # those that the record covers
        p.write("definition_period", regions.period_summary(daily, list(p.settings.periods)), ["period", "definition"])
    p.write("definition_trends", trend_rows(annual, ["definition"], ("mean_daily_area_km2", "area_time_weighted_mean_sst")), ["definition", "metric"])
    other = p.daily().filter(F.col("threshold_c") == p.settings.box_threshold) if reference else daily.select("date", F.col("canonical_area_km2").alias("total_area_km2"), F.col("lcc_area_km2").alias("largest_component_area_km2"))
    p.write("release_checks", checks.require_passed(checks.release_checks(daily, other)), ["test"])


def provenance(p: Project, refresh: bool = False) -> None:
    """The metadata and the checksums of the tables; ``refresh`` first holds what is stored against the settings.

    Metadata: the settings, the rows and span of each threshold, and the files
    of the tables. A record with other rows or another span than the settings
    say is an error.
    """
    meta, settings = f"{p.root}/metadata.json", asdict(p.settings) | {"version": VERSION}
    plain = lambda x: [plain(y) for y in x] if isinstance(x, tuple) else x
    expect = {k: plain(v) for k, v in settings.items()}
    if refresh:
        products.read_json(p.spark, meta, expect)
        lacking = [n for n in REQUIRED if not products.exists(p.spark, f"{p.root}/tables/{n}.csv")]
        if lacking:
            raise FileNotFoundError(f"no table {', '.join(lacking)}")
    daily = checks.require_thresholds(p.daily(), p.settings.thresholds)
    span = F.date_diff(F.lit(p.settings.end).cast("date"), F.lit(p.settings.start).cast("date")) + 1
    record = {f"{r['threshold_c']:g}": {"rows": r["n"], "first": str(r["a"]), "last": str(r["b"]), "expected": r["expected"]} for r in daily.groupBy("threshold_c").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"), F.first(span).alias("expected")).collect()}  # a row a threshold
    wrong = [t for t, r in record.items() if r["rows"] != r["expected"] or (r["first"], r["last"]) != (p.settings.start, p.settings.end)]
    if wrong:
        raise ValueError(f"the record at {', '.join(sorted(wrong))} has not the rows or the span of the settings: {record}")
    checksums = products.manifest(p.spark, f"{p.root}/tables").orderBy("relative_path")
    products.write_json(p.spark, expect | {"record": record}, meta)
    products.write_csv(checksums, f"{p.root}/manifest.csv")
