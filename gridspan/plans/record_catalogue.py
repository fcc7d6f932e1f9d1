"""Registered queries on the daily record of components: tables of cells, years, months and days, products and release checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import threshold_code
from ..operators import checks, labelling, occurrence, spectral, tiles, timeline, trends
from ..sources import fields as src
from ..sources import products
from . import catalogue as base
from . import series_catalogue as series

METRICS = ("total_area_km2", "largest_component_area_km2", "secondary_area_km2", "largest_component_area_fraction", "fragmentation_index", "component_count", "centroid_distance_km")
MONTHLY = ("largest_component_area_km2", "total_area_km2", "secondary_area_km2", "largest_component_area_fraction", "component_count")
ROLLING = ("largest_component_area_km2", "largest_component_area_fraction", "secondary_area_km2", "component_count", "fragmentation_index")
TILE = 3
DATES = ("1982-01-10", "1982-12-31")
PLACES = {"total_area_km2": 1, "largest_component_area_km2": 1, "secondary_area_km2": 1, "largest_component_area_fraction": 6, "fragmentation_index": 6, "component_count": 6, "centroid_distance_km": 1}


def component_numbers(spark: SparkSession, d: str) -> DataFrame:
    return base._components(spark, d).select("date", "threshold_c", "component_id", "number")


def tiled_components(spark: SparkSession, d: str) -> DataFrame:
    """The components of fields that are stored in tiles of 3 x 3 cells, joined across their borders."""
    axes = tiles.regular_axes(base.N_LAT, base.N_LON, -35.0, 10.0, 22.5, 45.0)
    f = tiles.tiled(src.masked(base._fields(spark, d), base._arrays(spark)), axes.shape, TILE)
    out = tiles.component_table(f, axes, TILE, base.THRESHOLDS)
    return base._rounded(out.select("date", "threshold_c", "component_id", "number", "n_cells", "area_km2", "largest"), {"area_km2": 2})


def lcc_periodic_seam(spark: SparkSession, d: str) -> DataFrame:
    """Components with cells on both sides of the seam of longitudes."""
    m = base._members(spark, d)
    column = F.pmod("cell_id", F.lit(base.N_LON))
    g = m.groupBy("date", "threshold_c", "component_id").agg(F.count(F.lit(1)).alias("n_cells"), F.max((column == 0).cast("int")).alias("west"), F.max((column == base.N_LON - 1).cast("int")).alias("east"))
    return g.filter("west = 1 and east = 1").select("date", "threshold_c", "component_id", "n_cells")


def lcc_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Where vector sums are too weak to have a direction, values are null."""
    c = base._components(spark, d)
    strong = c.groupBy("date", "threshold_c").agg((F.hypot(F.sum("x"), F.sum("y")) > 1e4).alias("strong"), F.max(F.when(F.col("largest"), F.hypot("x", "y") > 1e4)).alias("strong_top"))
    out = labelling.daily_diagnostics(c).join(strong, ["date", "threshold_c"])
    both = F.col("strong") & F.col("strong_top")
    names = {"full_centroid_lon_360": F.col("strong"), "largest_centroid_lon_360": F.col("strong_top"), "delta_lon_deg": both, "delta_lat_deg": both}
    turn = {"full_centroid_lon_360": 0.0, "largest_centroid_lon_360": 0.0, "delta_lon_deg": 180.0}  # what is rounded to a full turn begins anew
    value = lambda n: F.pmod(F.round(n, 3) + turn[n], F.lit(360.0)) - turn[n] if n in turn else F.round(n, 3) + 0.0
    return out.select("date", "threshold_c", *(F.round(F.when(ok, value(n)), 3).alias(n) for n, ok in names.items()))


def cell_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return base._stats(spark, d).select("threshold_c", "cell_id", "longest_run")


def cell_percentages(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(occurrence.cell_percentages(base._stats(spark, d)).drop("detached_pct"), {"canonical_pct": 6, "lcc_pct": 6})


def detached_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(occurrence.cell_percentages(base._stats(spark, d)).select("threshold_c", "cell_id", "detached_pct", "lcc_pct"), {"detached_pct": 6, "lcc_pct": 6})


def run_scale(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(occurrence.run_scale(base._stats(spark, d)), {"scale": 6})


def _complete(spark: SparkSession, d: str) -> DataFrame:
    return timeline.annual_metrics(base._daily(spark, d), ["threshold_c"], METRICS)


def annual_metrics(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(_complete(spark, d), PLACES)


def monthly_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = timeline.monthly_metrics(base._daily(spark, d), ["threshold_c"], MONTHLY)
    return base._rounded(out, {f"{m}_{s}": min(PLACES[m], 4) for m in MONTHLY for s in ("mean", "std")})


def metric_rolling_means(spark: SparkSession, d: str) -> DataFrame:
    out = timeline.centred_means(base._daily(spark, d), ["threshold_c"], ROLLING)
    return base._rounded(out.select("date", "threshold_c", *(f"{m}_rolling" for m in ROLLING)), {f"{m}_rolling": min(PLACES[m], 4) for m in ROLLING})


def trend_table(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means stand in for the annual ones, as the tables hold few years; slopes are by month."""
    out = trends.trend_table(base._monthly(spark, d), ["priority"], 1.0)
    keep = {"mean": 2, "theil_sen_slope": 4, "low": 4, "high": 4, "intercept": 1, "effective_sample_size_residual": 4, "effective_degrees_of_freedom": 4, "hac_slope": 4, "hac_se": 4, "hac_t": 4, "relative_slope_pct": 6, "hac_low": 1, "hac_high": 1, "hac_p": 6}
    return base._rounded(out.select("priority", "n", "hac_maxlags", *keep), keep)


#: Metrics of the record whose trends are registered, and the unit that they are counted in.
TRENDS = {"largest_component_area_km2": 1e6, "largest_component_area_fraction": 1.0, "component_count": 1.0}


def _record_months(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means (threshold_c, metric, x, y) of the record's metrics, as the tables hold few years."""
    daily = base._daily(spark, d)
    month = (F.year("date") * 12 + F.month("date")).cast("double")
    means = daily.groupBy("threshold_c", month.alias("x")).agg(*(F.avg(F.col(m) / u).alias(m) for m, u in TRENDS.items()))
    return means.select("threshold_c", "x", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in TRENDS))))


def record_trends(spark: SparkSession, d: str) -> DataFrame:
    """A trend row for each threshold and metric of the record."""
    out = trends.trend_table(_record_months(spark, d), ["threshold_c", "metric"], 10.0)
    keep = {c: 5 for c in ("mean", "theil_sen_slope", "low", "high", "effective_sample_size_residual", "effective_degrees_of_freedom", "hac_slope", "hac_se", "hac_t", "hac_p")} | {"hac_low": 4, "hac_high": 4}
    return base._rounded(out.select("threshold_c", "metric", "n", "hac_maxlags", *keep), keep)


def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """The record's monthly means with the line of their trend row."""
    m = _record_months(spark, d)
    t = trends.lines(m, ["threshold_c", "metric"]).select("threshold_c", "metric", "slope", "intercept")
    return m.join(t, ["threshold_c", "metric"]).select("threshold_c", "metric", "x", F.round("y", 6).alias("y"), F.round(F.col("intercept") + F.col("slope") * F.col("x"), 4).alias("fitted"))


def fitted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each series with the line of its trend row, looked up by key."""
    m = base._monthly(spark, d)
    t = trends.theil_sen(m, ["priority"])  # a row a series
    out = m.join(F.broadcast(t), "priority").select("priority", "x", F.round("y", 2).alias("y"), F.round(F.col("intercept") + F.col("slope") * F.col("x"), 2).alias("fitted"))
    return out


def days_without_component(spark: SparkSession, d: str) -> DataFrame:
    return labelling.days_without_component(base._fields(spark, d), base._components(spark, d), base.THRESHOLDS)


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(src.cells(src.on_dates(base._fields(spark, d), DATES), base._grid(spark)).select("date", "cell_id", "sst"), {"sst": 6})


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the representative dates with their grid."""
    r = base.representative_dates(spark, d).select(F.explode(F.array_distinct(F.array("median_date", "minimum_date"))).alias("date"))
    out = src.cells(base._fields(spark, d).join(F.broadcast(r), "date", "left_semi"), base._grid(spark))
    return base._rounded(out.select("date", "cell_id", "lat", "lon", "in_mask", "area_km2", "sst"), {"area_km2": 3, "sst": 6})


def field_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Fields stored from north to south and from 180 W, brought back to the grid's order."""
    lat, lon, order = src.normalised_axes([35.0 - 10.0 * i for i in range(base.N_LAT)], [-157.5 + 45.0 * j for j in range(base.N_LON)])
    src.require_conformity(lat, lon, base._arrays(spark))
    e = src.read_table(spark, d, "embeddings")
    f = src.fields(e, F.date_add(F.lit("1982-01-01").cast("date"), F.col("vec_id").cast("int")), "embedding")
    return base._rounded(src.cells(src.reordered(f, order), base._grid(spark)).select("date", "cell_id", "lat", "lon", "sst"), {"sst": 6})


def masked_fields(spark: SparkSession, d: str) -> DataFrame:
    f = src.masked(base._fields(spark, d), base._arrays(spark))
    return base._rounded(f.select("date", F.size(F.filter("values", lambda x: x.isNotNull())).alias("n_values"), F.aggregate("values", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total")), {"total": 4})


def release_checks(spark: SparkSession, d: str) -> DataFrame:
    """The five tests of a release; the components' own daily table is the external reference."""
    daily = base._definitions(spark, d)
    first = base._daily(spark, d).filter(F.col("threshold_c") == base.BOX_THRESHOLD).select("date", "total_area_km2", "largest_component_area_km2")
    out = checks.release_checks(daily.filter(F.col("canonical_area_km2") > 0), first)
    return base._rounded(out, {"value": 3, "tolerance": 3})


def grids_agree(spark: SparkSession, d: str) -> DataFrame:
    """The record's cells against a copy with a wrong mask cell, a shifted latitude and a cell missing."""
    g = base._seen_grid(spark, d).select("cell_id", "lat", "lon", "in_mask")
    other = g.filter("cell_id <> 9").withColumn("in_mask", F.when(F.col("cell_id") == 20, ~F.col("in_mask")).otherwise(F.col("in_mask"))).withColumn("lat", F.col("lat") + F.when(F.col("cell_id") == 7, F.lit(0.25)).otherwise(F.lit(0.0)))
    return checks.grids_agree(g, other)


def grid_faults(spark: SparkSession, d: str) -> DataFrame:
    """The checks of a grid on the record's cells with faults: a row of equal latitude, an area of zero, a cell missing."""
    g = base._seen_grid(spark, d).filter("cell_id <> 63").withColumn("lat", F.when(F.col("i") == 4, F.lit(-5.0)).otherwise(F.col("lat"))).withColumn("area_km2", F.when(F.col("cell_id") == 5, F.lit(0.0)).otherwise(F.col("area_km2")))
    return checks.grid_check(g, base.N_LAT, base.N_LON)


def thresholds_present(spark: SparkSession, d: str) -> DataFrame:
    return checks.thresholds_present(base._daily(spark, d), (*base.THRESHOLDS, 0.9))


def product_wide(spark: SparkSession, d: str) -> DataFrame:
    """A column for each threshold and statistic, named by the threshold's code."""
    return products.flattened(base._stats(spark, d), ["cell_id"], base.THRESHOLDS, ("n_lcc", "longest_run"))


def product_long(spark: SparkSession, d: str) -> DataFrame:
    """The wide product taken apart again by its column names."""
    return products.unflattened(product_wide(spark, d), ["cell_id"], base.THRESHOLDS)


def threshold_codes(spark: SparkSession, d: str) -> DataFrame:
    return base._daily(spark, d).groupBy("threshold_c").agg(F.count(F.lit(1)).alias("n_days")).select("threshold_c", threshold_code(F.col("threshold_c")).alias("code"), "n_days")


def ar1_background(spark: SparkSession, d: str) -> DataFrame:
    """Density and red-noise background, with the period in years and the density's logarithm above a floor."""
    w = spectral.welch_spectrum(series._series(spark, d), series.KEY, series.SEGMENT, series.OVERLAP)
    w = w.select("series", "k", F.round(F.col("period_days") / 365.25, 8).alias("period_years"), "psd", "background")
    v = lambda c: F.round(F.log10(F.greatest(F.col(c), F.lit(1e-6))), 5)
    return w.select("series", "k", "period_years", v("psd").alias("log_psd"), v("background").alias("log_background"))


QUERIES = {f.__name__: base._dated(f) for f in (
    component_numbers, tiled_components, lcc_periodic_seam, lcc_centroids, cell_longest_run, cell_percentages, detached_occurrence, run_scale, annual_metrics, monthly_metrics, metric_rolling_means, trend_table,
    record_trends, record_lines, fitted_lines, days_without_component, point_lookup, snapshot, field_normalised, masked_fields, release_checks, grids_agree, grid_faults, thresholds_present, product_wide, product_long, threshold_codes, ar1_background,
)}

_DAY = base._MEMBERS + """,
ce AS (SELECT *, degrees(atan2(fy, fx)) AS flon, degrees(atan2(fz, sqrt(fx * fx + fy * fy))) AS flat, degrees(atan2(ty, tx)) AS tlon, degrees(atan2(tz, sqrt(tx * tx + ty * ty))) AS tlat FROM day),
dm AS (SELECT date, threshold_c, total AS total_area_km2, big AS largest_component_area_km2, total - big AS secondary_area_km2, big / total AS largest_component_area_fraction, 1 - big / total AS fragmentation_index, n AS component_count,
  2 * 6371.0088 * asin(sqrt(least(1, greatest(0, sin(radians(tlat - flat) / 2) ^ 2 + cos(radians(flat)) * cos(radians(tlat)) * sin(radians(tlon - flon) / 2) ^ 2)))) AS centroid_distance_km FROM ce)"""
_FAULTY = base._CELLS + ", h AS (SELECT cell_id, i, j, CASE WHEN i = 4 THEN -5.0::DOUBLE ELSE lat END AS lat, lon, CASE WHEN cell_id = 5 THEN 0.0::DOUBLE ELSE area_km2 END AS area_km2 FROM seen WHERE cell_id <> 63)"
_WIDE = ", ".join(f"CAST(max({c}) FILTER (threshold_c = {t}) AS {'INTEGER' if c == 'longest_run' else 'BIGINT'}) AS t0p{code}__{c}" for t, code in ((0.05, "05"), (0.1, "1"), (0.15, "15")) for c in ("n_lcc", "longest_run"))
_CELLS_T = 200_000  # of the angle over which t's density is summed up
_LAGS, _LAGS_C = (f"CAST(greatest(1, floor(4 * ({n} / 100) ^ (2 / 9))) AS INTEGER)" for n in ("n", "c.n"))

ORACLES = {
    "component_numbers": f"WITH RECURSIVE {base._MEMBERS} SELECT CAST(date AS VARCHAR) AS date, threshold_c, component_id, CAST(dense_rank() OVER (PARTITION BY date, threshold_c ORDER BY component_id) AS INTEGER) AS number FROM comp",
    "tiled_components": f"""WITH RECURSIVE {base._MEMBERS} SELECT CAST(comp.date AS VARCHAR) AS date, comp.threshold_c, CAST(comp.component_id AS BIGINT) AS component_id, CAST(dense_rank() OVER (PARTITION BY comp.date, comp.threshold_c ORDER BY comp.component_id) AS INTEGER) AS number,
        comp.n_cells, round(comp.area_km2, 2) AS area_km2, comp.component_id = top.component_id AS largest FROM comp JOIN top ON top.date = comp.date AND top.threshold_c = comp.threshold_c""",
    "lcc_periodic_seam": f"WITH RECURSIVE {base._MEMBERS} SELECT CAST(date AS VARCHAR) AS date, threshold_c, component_id, count(*) AS n_cells FROM lab JOIN g USING (cell_id) GROUP BY date, threshold_c, component_id HAVING max(CASE WHEN j = 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN j = 7 THEN 1 ELSE 0 END) = 1",
    "lcc_centroids": f"""WITH RECURSIVE {_DAY}, q AS (SELECT date, threshold_c, sqrt(fx * fx + fy * fy) > 1e4 AS sf, sqrt(tx * tx + ty * ty) > 1e4 AS st, (flon + 360) % 360 AS fl, (tlon + 360) % 360 AS tl, tlat - flat AS dl FROM ce)
        SELECT CAST(date AS VARCHAR) AS date, threshold_c, CASE WHEN sf THEN round((round(fl, 3) + 360) % 360, 3) END AS full_centroid_lon_360, CASE WHEN st THEN round((round(tl, 3) + 360) % 360, 3) END AS largest_centroid_lon_360,
        CASE WHEN sf AND st THEN round((round((tl - fl + 540) % 360 - 180, 3) + 540) % 360 - 180, 3) END AS delta_lon_deg, CASE WHEN sf AND st THEN round(dl, 3) + 0.0 END AS delta_lat_deg FROM q""",
    "cell_longest_run": f"WITH RECURSIVE {base._STATS} SELECT threshold_c, cell_id, longest_run FROM st",
    "cell_percentages": f"WITH RECURSIVE {base._STATS} SELECT threshold_c, cell_id, round(100.0::DOUBLE * n_canonical / n_valid, 6) AS canonical_pct, round(100.0::DOUBLE * n_lcc / n_valid, 6) AS lcc_pct, 100.0::DOUBLE * n_lcc / n_valid >= 50 AS mostly_lcc FROM st",
    "detached_occurrence": f"WITH RECURSIVE {base._STATS} SELECT threshold_c, cell_id, round(100.0::DOUBLE * (n_canonical - n_lcc) / n_valid, 6) AS detached_pct, round(100.0::DOUBLE * n_lcc / n_valid, 6) AS lcc_pct FROM st",
    "run_scale": f"WITH RECURSIVE {base._STATS} SELECT threshold_c, count(*) AS positive_cells, round(quantile_cont(CAST(longest_run AS DOUBLE), 0.99), 6) AS scale FROM st WHERE longest_run > 0 GROUP BY threshold_c",
    "annual_metrics": f"WITH RECURSIVE {_DAY}, y AS (SELECT threshold_c, CAST(year(date) AS INTEGER) AS year, count(*) AS n_days, {', '.join(f'round(avg({m}), {PLACES[m]}) AS {m}' for m in METRICS)} FROM dm GROUP BY 1, 2) SELECT *, CAST(make_date(year, 7, 1) AS VARCHAR) AS date FROM y WHERE n_days = {base._LEAP}",
    "monthly_metrics": f"WITH RECURSIVE {_DAY} SELECT threshold_c, CAST(month(date) AS INTEGER) AS month, {', '.join(f'round(avg({m}), {min(PLACES[m], 4)}) AS {m}_mean, round(stddev_samp({m}), {min(PLACES[m], 4)}) AS {m}_std' for m in MONTHLY)} FROM dm GROUP BY 1, 2",
    "metric_rolling_means": f"WITH RECURSIVE {_DAY} SELECT CAST(date AS VARCHAR) AS date, threshold_c, {', '.join(f'CASE WHEN count({m}) OVER w >= 183 THEN round(avg({m}) OVER w, {min(PLACES[m], 4)}) END AS {m}_rolling' for m in ROLLING)} FROM dm WINDOW w AS (PARTITION BY threshold_c ORDER BY date RANGE BETWEEN INTERVAL 182 DAY PRECEDING AND INTERVAL 182 DAY FOLLOWING)",
    "trend_table": f"""WITH {base._MONTHLY}, sl AS (SELECT a.priority, (b.y - a.y) / (b.x - a.x) AS slope FROM mo a JOIN mo b ON a.priority = b.priority AND a.x < b.x),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY slope) AS r, count(*) OVER (PARTITION BY priority) AS nt FROM sl),
        ties AS (SELECT priority, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT priority, x AS v, 0 AS s, count(*) AS k FROM mo GROUP BY ALL UNION ALL SELECT priority, y, 1, count(*) FROM mo GROUP BY ALL) GROUP BY priority),
        sg AS (SELECT priority, sqrt((count(*) * (count(*) - 1) * (2 * count(*) + 5) - any_value(tied)) / 18.0::DOUBLE) * {trends.Z95}::DOUBLE AS zs FROM mo JOIN ties USING (priority) GROUP BY priority),
        ts AS (SELECT priority, median(slope) AS slope, max(slope) FILTER (r = greatest(round_even((nt - zs) / 2, 0), 1)) AS low, max(slope) FILTER (r = least(round_even((nt + zs) / 2, 0), nt - 1) + 1) AS high FROM ranked JOIN sg USING (priority) GROUP BY priority),
        me AS (SELECT priority, avg(y) AS mean, median(y) - any_value(slope) * median(x) AS ic, any_value(slope) AS ts, any_value(low) AS low, any_value(high) AS high, avg(x) AS xm, count(*) AS n FROM mo JOIN ts USING (priority) GROUP BY priority),
        p AS (SELECT mo.priority, x - xm AS u, y, y - ic - ts * x AS tr, n, row_number() OVER (PARTITION BY mo.priority ORDER BY x) AS t FROM mo JOIN me USING (priority)),
        ols AS (SELECT priority, sum(u * y) / sum(u * u) AS b, avg(y) AS a, sum(u * u) AS sxx FROM p GROUP BY priority),
        sc AS (SELECT priority, t, n, u * (y - a - b * u) AS s FROM p JOIN ols USING (priority)),
        hac AS (SELECT c.priority, sum(CASE WHEN c.t = e.t THEN c.s * e.s ELSE 2 * (1 - (e.t - c.t) / ({_LAGS_C} + 1)) * c.s * e.s END) * any_value(c.n) / (any_value(c.n) - 2) AS v FROM sc c JOIN sc e ON c.priority = e.priority AND e.t BETWEEN c.t AND c.t + {_LAGS_C} GROUP BY c.priority),
        z AS (SELECT priority, n, t, tr - avg(tr) OVER (PARTITION BY priority) AS z FROM p),
        r AS (SELECT a.priority, a.n, b.t - a.t AS lag, sum(a.z * b.z) / any_value(a.n - (b.t - a.t)) AS v FROM z a JOIN z b ON a.priority = b.priority AND b.t >= a.t GROUP BY ALL),
        rho AS (SELECT r.priority, r.n, r.lag, r.v / o.v AS rho FROM r JOIN r o ON o.priority = r.priority AND o.lag = 0),
        pr AS (SELECT priority, (lag + 1) // 2 AS m, sum(rho) AS pair, sum((1 - lag / n) * rho) AS w FROM rho WHERE lag > 0 GROUP BY ALL HAVING count(*) = 2),
        bad AS (SELECT priority, min(m) AS m FROM pr WHERE pair <= 0 GROUP BY priority),
        ne AS (SELECT me.priority, least(greatest(n / (1 + 2 * coalesce((SELECT sum(w) FROM pr LEFT JOIN bad USING (priority) WHERE pr.priority = me.priority AND (bad.m IS NULL OR pr.m < bad.m)), 0)), 3), n) AS ne FROM me),
        st AS (SELECT priority, greatest(ne - 2, 1) AS df, b / (sqrt(v) / sxx) AS t FROM ols JOIN hac USING (priority) JOIN ne USING (priority)),
        dens AS (SELECT priority, df, abs(t) AS t, i, cos((i + 0.5) * pi() / 2 / {_CELLS_T}) ^ (df - 1) AS d FROM st, range({_CELLS_T}) q(i)),
        tail AS (SELECT priority, df, t, i, d / sum(d) OVER (PARTITION BY priority) AS d, 1 - sum(d) OVER (PARTITION BY priority ORDER BY i) / sum(d) OVER (PARTITION BY priority) AS beyond FROM dens),
        pq AS (SELECT priority, sum(d * greatest(0, least(1, i + 1 - atan(t / sqrt(df)) * 2 / pi() * {_CELLS_T}))) AS p, min(CASE WHEN beyond <= 0.05 AND beyond + d > 0.05 THEN sqrt(df) * tan((i + 1 - (0.05 - beyond) / d) * pi() / 2 / {_CELLS_T}) END) AS q FROM tail GROUP BY priority)
        SELECT priority, CAST(n AS INTEGER) AS n, {_LAGS} AS hac_maxlags, round(b - q * sqrt(v) / sxx, 1) AS hac_low, round(b + q * sqrt(v) / sxx, 1) AS hac_high, round(p, 6) AS hac_p, round(mean, 2) AS mean, round(ts, 4) AS theil_sen_slope, round(low, 4) AS low, round(high, 4) AS high, round(ic, 1) AS intercept, round(ne, 4) AS effective_sample_size_residual,
        round(greatest(ne - 2, 1), 4) AS effective_degrees_of_freedom, round(b, 4) AS hac_slope, round(sqrt(v) / sxx, 4) AS hac_se, round(b / (sqrt(v) / sxx), 4) AS hac_t, round(100 * ts / mean, 6) AS relative_slope_pct
        FROM me JOIN ols USING (priority) JOIN hac USING (priority) JOIN ne USING (priority) JOIN pq USING (priority)""",
    "fitted_lines": f"""WITH {base._MONTHLY}, sl AS (SELECT a.priority, median((b.y - a.y) / (b.x - a.x)) AS slope FROM mo a JOIN mo b ON a.priority = b.priority AND a.x < b.x GROUP BY 1),
        ic AS (SELECT priority, any_value(slope) AS slope, median(y) - any_value(slope) * median(x) AS ic FROM mo JOIN sl USING (priority) GROUP BY priority) SELECT priority, x, round(y, 2) AS y, round(ic + slope * x, 2) AS fitted FROM mo JOIN ic USING (priority)""",
    "days_without_component": f"WITH {base._CELLS} SELECT CAST(date AS VARCHAR) AS date, threshold_c FROM c, th GROUP BY date, threshold_c HAVING count(*) FILTER (in_mask AND sst >= threshold_c) = 0",
    "point_lookup": f"WITH {base._CELLS} SELECT CAST(date AS VARCHAR) AS date, cell_id, round(sst, 6) AS sst FROM c WHERE CAST(date AS VARCHAR) IN {DATES}",
    "snapshot": f"""WITH RECURSIVE {base._MEMBERS}, t AS (SELECT date, round(big / total, 6) AS f FROM day WHERE threshold_c = 0.05), q AS (SELECT median(f) AS m FROM t), r AS (SELECT first(date ORDER BY round(abs(f - m), 6), date) AS a, first(date ORDER BY f, date) AS b FROM t, q)
        SELECT CAST(date AS VARCHAR) AS date, cell_id, lat, lon, in_mask, round(area_km2, 3) AS area_km2, round(sst, 6) AS sst FROM c, r WHERE date IN (a, b)""",
    "field_normalised": f"""WITH {base._GRID} SELECT CAST(CAST(DATE '1982-01-01' + CAST(vec_id AS INTEGER) AS DATE) AS VARCHAR) AS date, g.cell_id, lat, lon, round(CASE WHEN isfinite(x) THEN x END, 6) AS sst
        FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) JOIN g ON p = 8 * (7 - i) + (j + 4) % 8""",
    "masked_fields": f"WITH {base._CELLS} SELECT CAST(date AS VARCHAR) AS date, CAST(count(sst) FILTER (in_mask) AS INTEGER) AS n_values, round(coalesce(sum(sst) FILTER (in_mask), 0), 4) AS total FROM c GROUP BY date",
    "release_checks": f"""WITH RECURSIVE {base._FLAGS}, k AS (SELECT dd.*, total, big FROM dd JOIN day ON day.date = dd.date AND threshold_c = 0.05 WHERE canonical_area_km2 > 0),
        o AS (SELECT CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS DOUBLE) AS a, max(lcc_area_km2 - canonical_area_km2) AS b, max(box_strict_area_km2 - box_inclusive_area_km2) AS c, max(abs(canonical_area_km2 - total)) AS d, max(abs(lcc_area_km2 - big)) AS e,
          0.01 + 1e-11 * max(greatest(canonical_area_km2, total)) AS td, 0.01 + 1e-11 * max(greatest(lcc_area_km2, big)) AS te FROM k)
        SELECT test, round(v, 3) AS value, round(t, 3) AS tolerance, v <= t AS pass FROM (SELECT 'daily_record_complete' AS test, a AS v, 0.0::DOUBLE AS t FROM o UNION ALL SELECT 'lcc_within_canonical', greatest(b, 0), 0.0001 FROM o UNION ALL SELECT 'strict_within_inclusive', greatest(c, 0), 0.0001 FROM o UNION ALL SELECT 'canonical_area_vs_reference', d, td FROM o UNION ALL SELECT 'lcc_area_vs_reference', e, te FROM o)""",
    "grids_agree": f"""WITH {base._CELLS}, o AS (SELECT cell_id, CASE WHEN cell_id = 7 THEN lat + 0.25 ELSE lat END AS lat, lon, CASE WHEN cell_id = 20 THEN NOT in_mask ELSE in_mask END AS in_mask FROM seen WHERE cell_id <> 9),
        q AS (SELECT count(*) FILTER (g.cell_id IS NULL OR o.cell_id IS NULL) AS c, count(*) FILTER (g.in_mask IS DISTINCT FROM o.in_mask AND g.cell_id IS NOT NULL AND o.cell_id IS NOT NULL) AS m, max(abs(g.lat - o.lat)) AS la, max(abs(g.lon - o.lon)) AS lo FROM seen g FULL JOIN o USING (cell_id))
        SELECT test, value, tolerance, value <= tolerance AS pass FROM (SELECT 'cells_on_both_sides' AS test, CAST(c AS DOUBLE) AS value, 0.0::DOUBLE AS tolerance FROM q UNION ALL SELECT 'mask_equal', CAST(m AS DOUBLE), 0.0 FROM q UNION ALL SELECT 'lat_equal', la, 1e-8 FROM q UNION ALL SELECT 'lon_equal', lo, 1e-8 FROM q)""",
    "grid_faults": f"WITH {_FAULTY} {series._GRID_TESTS.format(t='h')}",
    "thresholds_present": f"WITH RECURSIVE {base._MEMBERS}, e(threshold_c) AS (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.9::DOUBLE)) SELECT threshold_c, count(date) AS n_rows, count(date) > 0 AS present FROM e LEFT JOIN day USING (threshold_c) GROUP BY threshold_c",
    "product_wide": f"WITH RECURSIVE {base._STATS} SELECT cell_id, {_WIDE} FROM st GROUP BY cell_id",
    "product_long": f"WITH RECURSIVE {base._STATS} SELECT cell_id, threshold_c, name, CAST(value AS DOUBLE) AS value FROM (SELECT cell_id, threshold_c, 'n_lcc' AS name, n_lcc AS value FROM st UNION ALL SELECT cell_id, threshold_c, 'longest_run', longest_run FROM st)",
    "threshold_codes": f"WITH RECURSIVE {base._MEMBERS} SELECT threshold_c, replace(CAST(threshold_c AS VARCHAR), '.', 'p') AS code, count(*) AS n_days FROM day GROUP BY threshold_c",
    "ar1_background": f"""WITH {series._WELCH}, ar AS (SELECT series, least(greatest(corr(b.z, a.z), -0.99), 0.99) AS r FROM z a JOIN z b USING (series) WHERE b.x = a.x + 1 GROUP BY series), sh AS (SELECT series, k, f, p, (1 - r * r) / (1 + r * r - 2 * r * cos(2 * pi() * f)) AS s FROM psd JOIN ar USING (series)),
        tz AS (SELECT series, sum((f - pf) * (s + ps) / 2) AS area FROM (SELECT series, f, s, lag(f) OVER w AS pf, lag(s) OVER w AS ps FROM sh WINDOW w AS (PARTITION BY series ORDER BY k)) GROUP BY series)
        SELECT series, k, round(1 / f / 365.25, 8) AS period_years, round(log10(greatest(p, 1e-6)), 5) AS log_psd, round(log10(greatest(s * variance / area, 1e-6)), 5) AS log_background FROM sh JOIN tz USING (series) JOIN vz USING (series)""",
}

_MONTHS = f"""WITH RECURSIVE {_DAY}, mm AS (SELECT threshold_c, CAST(year(date) * 12 + month(date) AS DOUBLE) AS x, {", ".join(f"avg({m} / {u}) AS {m}" for m, u in TRENDS.items())} FROM dm GROUP BY ALL),
mo AS ({" UNION ALL ".join(f"SELECT CAST(threshold_c AS VARCHAR) || '/{m}' AS priority, x, {m} AS y FROM mm" for m in TRENDS)})"""
_OF_KEY = "CAST(split_part(priority, '/', 1) AS DOUBLE) AS threshold_c, split_part(priority, '/', 2) AS metric"
_head, _tail = ORACLES["trend_table"].replace(f"WITH {base._MONTHLY}", _MONTHS).rsplit("SELECT priority, CAST(n AS INTEGER) AS n,", 1)
ORACLES["record_trends"] = f"""{_head}SELECT {_OF_KEY}, CAST(n AS INTEGER) AS n, {_LAGS} AS hac_maxlags, round(mean, 5) AS mean, round(10 * ts, 5) AS theil_sen_slope, round(10 * low, 5) AS low, round(10 * high, 5) AS high, round(ne, 5) AS effective_sample_size_residual, round(greatest(ne - 2, 1), 5) AS effective_degrees_of_freedom,
        round(10 * b, 5) AS hac_slope, round(10 * sqrt(v) / sxx, 5) AS hac_se, round(b / (sqrt(v) / sxx), 5) AS hac_t, round(10 * (b - q * sqrt(v) / sxx), 4) AS hac_low, round(10 * (b + q * sqrt(v) / sxx), 4) AS hac_high, round(p, 5) AS hac_p FROM me{_tail.rsplit("FROM me", 1)[1]}"""
ORACLES["record_lines"] = f"""{_MONTHS}, sl AS (SELECT a.priority, median((b.y - a.y) / (b.x - a.x)) AS slope FROM mo a JOIN mo b ON a.priority = b.priority AND a.x < b.x GROUP BY 1),
        ic AS (SELECT priority, any_value(slope) AS slope, median(y) - any_value(slope) * median(x) AS ic FROM mo JOIN sl USING (priority) GROUP BY priority) SELECT {_OF_KEY}, x, round(y, 6) AS y, round(ic + slope * x, 4) AS fitted FROM mo JOIN ic USING (priority)"""
