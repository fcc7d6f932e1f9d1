"""The registered queries over the driver's tables, with the SQL that each is held against.

``embeddings`` stands in for a record of daily fields: vector k is the field of
day k after 1982-01-01 on an 8 x 8 grid; ``orders``, ``lineitem`` and
``events`` give daily series. Values are rounded where sums of doubles depend
on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labelling, occurrence, regions, spectral, timeline, trends
from ..sources import fields as src
from ..sources import products

THRESHOLDS = (0.05, 0.10, 0.15)
BOX_LAT, BOX_LON, BOX_THRESHOLD = (-20.0, 20.0), (90.0, 270.0), 0.05
MASKED = (3, 4)
N_LAT = N_LON = 8


def _grid(spark: SparkSession) -> DataFrame:
    return src.regular_grid(spark, N_LAT, N_LON, -35.0, 10.0, 22.5, 45.0, MASKED)


def _arrays(spark: SparkSession) -> src.GridArrays:
    return src.grid_arrays(_grid(spark))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    e = src.read_table(spark, d, "embeddings")
    return src.fields(e, F.date_add(F.lit("1982-01-01").cast("date"), F.col("vec_id").cast("int")), "embedding")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return src.cells(_fields(spark, d), _grid(spark))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return labelling.label_components(_fields(spark, d), _arrays(spark), THRESHOLDS)


def _components(spark: SparkSession, d: str) -> DataFrame:
    return labelling.component_table(_fields(spark, d), _arrays(spark), THRESHOLDS)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return occurrence.cell_statistics(_fields(spark, d), _arrays(spark), THRESHOLDS)


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _series(spark: SparkSession, d: str) -> DataFrame:
    return timeline.daily_series(src.read_table(spark, d, "orders"), "o_orderdate", "o_totalprice")


def _monthly(spark: SparkSession, d: str, key: str = "o_orderpriority") -> DataFrame:
    o = src.read_table(spark, d, "orders")
    month: Column = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double")
    return o.groupBy(F.col(key).alias("priority"), month.alias("x")).agg(F.avg("o_totalprice").alias("y"))


def field_cells(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_cells(spark, d).select("date", "cell_id", "i", "j", "lat", "lon", "in_mask", "sst"), {"sst": 6})


def field_valid_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).filter("in_mask and sst is not null")
    t = spark.createDataFrame([(x,) for x in THRESHOLDS], "threshold_c double")
    return c.crossJoin(F.broadcast(t)).groupBy("date", "threshold_c").agg(F.count_if(F.col("sst") >= F.col("threshold_c")).alias("n_cells"), F.count(F.lit(1)).alias("n_valid"))


def _seen_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid's cells that the record has, with the number of their values."""
    seen = _fields(spark, d).select(F.posexplode("values").alias("cell_id", "x")).groupBy("cell_id").agg(F.count("x").alias("n_values"))
    return seen.join(F.broadcast(_grid(spark)), "cell_id")  # the grid is 8 x 8 here


def grid_cell_area(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_seen_grid(spark, d).select("cell_id", "i", "j", "lat", "lon", "in_mask", "area_km2", "n_values"), {"area_km2": 3})


def lcc_components(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_components(spark, d).select("date", "threshold_c", "component_id", "n_cells", "area_km2"), {"area_km2": 2})


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return labelling.daily_diagnostics(_components(spark, d))


def lcc_daily(spark: SparkSession, d: str) -> DataFrame:
    out = _daily(spark, d).select("date", "year", "threshold_c", "component_count", "total_area_km2", "largest_component_area_km2", "largest_component_area_fraction", "secondary_area_km2", "fragmentation_index")
    return _rounded(out, {"total_area_km2": 1, "largest_component_area_km2": 1, "secondary_area_km2": 1, "largest_component_area_fraction": 6, "fragmentation_index": 6})


def lcc_centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of weak vector sums are ill-conditioned; six decimals of the latitudes and metres of distance are kept."""
    out = _daily(spark, d).select("date", "threshold_c", "full_centroid_lat", "largest_centroid_lat", "centroid_distance_km")
    return _rounded(out, {"full_centroid_lat": 5, "largest_centroid_lat": 5, "centroid_distance_km": 2})


def cell_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


def occurrence_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(occurrence.occurrence_summary(_stats(spark, d), _grid(spark)), {"area_weighted_mean_occurrence_fraction": 6, "p95_longest_run_days_positive_cells": 6, "median_longest_run_days_positive_cells": 6})


def detached_summary(spark: SparkSession, d: str) -> DataFrame:
    out = occurrence.detached_summary(_stats(spark, d), _grid(spark))
    return _rounded(out, {c: 4 for c, t in out.dtypes if t == "double" and c != "threshold_c"})


def user_longest_active_run(spark: SparkSession, d: str) -> DataFrame:
    e = src.read_table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("date"))
    return occurrence.longest_runs(e, ["user_id"])


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    return regions.definition_daily(_fields(spark, d), _arrays(spark), BOX_THRESHOLD, BOX_LAT, BOX_LON)


def definition_daily(spark: SparkSession, d: str) -> DataFrame:
    out = _definitions(spark, d)
    return _rounded(out, {c: 1 if c.endswith("km2") else 4 for c, t in out.dtypes if t == "double"})


def definition_annual(spark: SparkSession, d: str) -> DataFrame:
    tidy = regions.unpivot_definitions(_definitions(spark, d)).withColumn("year", F.year("date"))
    out = regions.definition_summary(tidy, ["year"])
    return _rounded(out, {"mean_daily_area_km2": 1, "median_daily_area_km2": 1, "mean_daily_mean_sst": 5, "area_time_weighted_mean_sst": 5})


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_series(spark, d), {"value": 2})


def daily_spine_gaps(spark: SparkSession, d: str) -> DataFrame:
    return timeline.gaps(_series(spark, d))


def complete_years(spark: SparkSession, d: str) -> DataFrame:
    return timeline.complete_years(_series(spark, d))


def annual_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(timeline.annual_means(timeline.filled(_series(spark, d))), {"mean": 2})


def monthly_climatology(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(timeline.monthly_climatology(_series(spark, d)), {"mean": 2, "std": 2})


def rolling_centered_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(timeline.centred_mean(timeline.filled(_series(spark, d))), {"value": 2, "rolling_mean": 2})


def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trends.theil_sen(_monthly(spark, d), ["priority"]), {"slope": 4, "intercept": 2, "joint_intercept": 2})


def lag1_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trends.lag1(_monthly(spark, d), ["priority"], "x", "y"), {"lag1": 6})


def linear_detrend(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trends.detrended(_monthly(spark, d), ["priority"]), {"y": 2, "residual": 2})


def hac_trend(spark: SparkSession, d: str) -> DataFrame:
    out = trends.hac_trend(_monthly(spark, d), ["priority"])
    return out


def _keyed_series(spark: SparkSession, d: str) -> DataFrame:
    """A daily series (series, date, value) for each priority, on the days of all orders."""
    o = src.read_table(spark, d, "orders").withColumnRenamed("o_orderpriority", "series")
    return timeline.filled(timeline.daily_series(o, "o_orderdate", "o_totalprice", ["series"]), ["series"])


def _welch(spark: SparkSession, d: str) -> DataFrame:
    return spectral.welch_spectrum(_keyed_series(spark, d), ["series"], 256, 128)


def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    return _welch(spark, d)


def dominant_period(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(spectral.dominant_period(_welch(spark, d), ["series"]), {"dominant_period_days": 6})


def representative_dates(spark: SparkSession, d: str) -> DataFrame:
    """The dates nearest the median and at the minimum of the largest component's share; the earliest of equal ones."""
    f = F.round("largest_component_area_fraction", 6)
    t = _daily(spark, d).filter(F.col("threshold_c") == THRESHOLDS[0]).select("date", f.alias("f"))
    m = t.agg(F.median("f").alias("m"))
    return t.crossJoin(F.broadcast(m)).agg(F.min_by("date", F.struct(F.round(F.abs(F.col("f") - F.col("m")), 6), "date")).alias("median_date"), F.min_by("date", F.struct("f", "date")).alias("minimum_date"))


def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    """(test, value, tolerance, pass): the checks that gate a release."""
    daily = _definitions(spark, d)
    one = daily.agg(
        F.max(F.col("lcc_area_km2") - F.col("canonical_area_km2")).alias("a"), F.max(F.col("box_strict_area_km2") - F.col("box_inclusive_area_km2")).alias("b"),
        (F.date_diff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date")).cast("double").alias("c"),
    )
    rows = F.array(*(F.struct(F.lit(t).alias("test"), F.round(F.greatest(F.col(c), F.lit(0.0)), 4).alias("value"), F.lit(tol).alias("tolerance"), (F.col(c) <= tol).alias("pass")) for t, c, tol in (("lcc_within_canonical", "a", 1e-4), ("strict_within_inclusive", "b", 1e-4), ("missing_days", "c", 0.0))))
    return one.select(F.inline(rows))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, bytes, sha256) of all files of a folder."""
    return products.manifest(spark, d).orderBy("relative_path")


def _dated(query):
    """Dates as ISO strings, as the record's tables hold them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = query(spark, d)
        return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, t in out.dtypes if t == "date"})

    return run


QUERIES = {f.__name__: _dated(f) for f in (
    field_cells, field_valid_threshold, grid_cell_area, lcc_components, lcc_daily, lcc_centroid_distance, cell_occurrence, occurrence_summary, detached_summary,
    user_longest_active_run, definition_daily, definition_annual, daily_series, daily_spine_gaps, complete_years, annual_means, monthly_climatology,
    rolling_centered_mean, theil_sen, lag1_autocorrelation, linear_detrend, hac_trend, welch_psd, dominant_period, representative_dates, qc_summary, manifest,
)}

_GRID = """
g AS (SELECT cell_id, i, j, lat, lon, cell_id NOT IN (3, 4) AS in_mask, area_km2, cos(radians(lat)) * cos(radians(lon)) AS bx, cos(radians(lat)) * sin(radians(lon)) AS by_, sin(radians(lat)) AS bz FROM (
  SELECT CAST(k AS INTEGER) AS cell_id, CAST(k // 8 AS INTEGER) AS i, CAST(k % 8 AS INTEGER) AS j, -35.0::DOUBLE + 10.0 * (k // 8) AS lat, 22.5::DOUBLE + 45.0 * (k % 8) AS lon,
    6371.0088::DOUBLE ^ 2 * (sin(radians(-30.0::DOUBLE + 10.0 * (k // 8))) - sin(radians(-40.0::DOUBLE + 10.0 * (k // 8)))) * radians(45.0::DOUBLE) AS area_km2 FROM range(64) r(k)))"""
_CELLS = _GRID + """,
c AS (SELECT CAST(DATE '1982-01-01' + CAST(vec_id AS INTEGER) AS DATE) AS date, g.*, CASE WHEN isfinite(x) THEN x END AS sst
  FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS cell_id FROM embeddings WHERE len(embedding) = 64) JOIN g USING (cell_id)),
th(threshold_c) AS (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.15::DOUBLE)),
seen AS (SELECT cell_id, any_value(i) AS i, any_value(j) AS j, any_value(lat) AS lat, any_value(lon) AS lon, any_value(in_mask) AS in_mask, any_value(area_km2) AS area_km2, count(sst) AS n_values FROM c GROUP BY cell_id)"""
_MEMBERS = _CELLS + """,
m AS (SELECT date, threshold_c, cell_id, i, j FROM c, th WHERE in_mask AND sst >= threshold_c),
edges AS (SELECT a.date, a.threshold_c, a.cell_id AS a, b.cell_id AS b FROM m a JOIN m b ON a.date = b.date AND a.threshold_c = b.threshold_c AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) IN (0, 1, 7)),
reach(date, threshold_c, cell_id, root) AS (SELECT date, threshold_c, cell_id, cell_id FROM m UNION SELECT e.date, e.threshold_c, e.b, r.root FROM reach r JOIN edges e ON e.date = r.date AND e.threshold_c = r.threshold_c AND e.a = r.cell_id WHERE e.b >= r.root),
lab AS (SELECT date, threshold_c, cell_id, min(root) AS component_id FROM reach GROUP BY ALL),
comp AS (SELECT date, threshold_c, component_id, count(*) AS n_cells, sum(area_km2) AS area_km2, sum(area_km2 * bx) AS x, sum(area_km2 * by_) AS y, sum(area_km2 * bz) AS z FROM lab JOIN g USING (cell_id) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, threshold_c ORDER BY round(area_km2, 3) DESC, component_id) AS r FROM comp) WHERE r = 1),
lcc AS (SELECT lab.* FROM lab JOIN top USING (date, threshold_c, component_id)),
day AS (SELECT date, threshold_c, count(*) AS n, sum(comp.area_km2) AS total, any_value(top.area_km2) AS big, sum(comp.x) AS fx, sum(comp.y) AS fy, sum(comp.z) AS fz, any_value(top.x) AS tx, any_value(top.y) AS ty, any_value(top.z) AS tz FROM comp JOIN top USING (date, threshold_c) GROUP BY ALL)"""
_STATS = _MEMBERS + """,
v AS (SELECT cell_id, count(*) AS n_valid FROM c WHERE in_mask AND sst IS NOT NULL GROUP BY ALL),
runs AS (SELECT threshold_c, cell_id, CAST(max(n) AS INTEGER) AS longest_run FROM (SELECT threshold_c, cell_id, count(*) AS n FROM (SELECT threshold_c, cell_id, date, date_diff('day', DATE '1970-01-01', date) - row_number() OVER (PARTITION BY threshold_c, cell_id ORDER BY date) AS island FROM lcc) GROUP BY threshold_c, cell_id, island) GROUP BY ALL),
st AS (SELECT th.threshold_c, v.cell_id, n_valid, coalesce(a.n, 0) AS n_canonical, coalesce(b.n, 0) AS n_lcc, coalesce(longest_run, 0) AS longest_run, area_km2 FROM v JOIN g USING (cell_id) CROSS JOIN th
  LEFT JOIN (SELECT threshold_c, cell_id, count(*) AS n FROM lab GROUP BY ALL) a ON a.threshold_c = th.threshold_c AND a.cell_id = v.cell_id
  LEFT JOIN (SELECT threshold_c, cell_id, count(*) AS n FROM lcc GROUP BY ALL) b ON b.threshold_c = th.threshold_c AND b.cell_id = v.cell_id
  LEFT JOIN runs ON runs.threshold_c = th.threshold_c AND runs.cell_id = v.cell_id)"""
_DEFS = ("canonical", "lcc", "box_strict", "box_inclusive")
_FLAGS = _MEMBERS + """,
f AS (SELECT c.date, sst, area_km2, in_mask AND sst >= 0.05 AS canonical, l.cell_id IS NOT NULL AS lcc, lat BETWEEN -20 AND 20 AND lon BETWEEN 90 AND 270 AND sst > 0.05 AS box_strict, lat BETWEEN -20 AND 20 AND lon BETWEEN 90 AND 270 AND sst >= 0.05 AS box_inclusive
  FROM c LEFT JOIN (SELECT date, cell_id FROM lcc WHERE threshold_c = 0.05) l ON l.date = c.date AND l.cell_id = c.cell_id WHERE sst IS NOT NULL),
dd AS (SELECT date, """ + ", ".join(f"sum(CASE WHEN {d} THEN area_km2 ELSE 0 END) AS {d}_area_km2, sum(CASE WHEN {d} THEN area_km2 * sst END) AS {d}_sst_area_integral" for d in _DEFS) + """,
  sum(CASE WHEN lcc AND box_strict THEN area_km2 ELSE 0 END) AS intersection_area_km2, sum(CASE WHEN lcc OR box_strict THEN area_km2 ELSE 0 END) AS union_area_km2, sum(CASE WHEN lcc AND NOT box_strict THEN area_km2 ELSE 0 END) AS lcc_outside_box_area_km2 FROM f GROUP BY date)"""
_SERIES = """s AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
span AS (SELECT CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM s),
fl AS (SELECT date, coalesce(value, 0) AS value FROM span LEFT JOIN s USING (date))"""
_MONTHLY = "mo AS (SELECT o_orderpriority AS priority, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"
_LEAP = "CASE WHEN day(last_day(make_date(year, 2, 1))) = 29 THEN 366 ELSE 365 END"
_CUTS = (1, 5, 10, 25, 50)

ORACLES = {
    "field_cells": f"WITH {_CELLS} SELECT date, cell_id, i, j, lat, lon, in_mask, round(sst, 6) AS sst FROM c",
    "field_valid_threshold": f"WITH {_CELLS} SELECT date, threshold_c, count(*) FILTER (sst >= threshold_c) AS n_cells, count(*) AS n_valid FROM c, th WHERE in_mask AND sst IS NOT NULL GROUP BY ALL",
    "grid_cell_area": f"WITH {_CELLS} SELECT cell_id, i, j, lat, lon, in_mask, round(area_km2, 3) AS area_km2, n_values FROM seen",
    "lcc_components": f"WITH RECURSIVE {_MEMBERS} SELECT date, threshold_c, component_id, n_cells, round(area_km2, 2) AS area_km2 FROM comp",
    "lcc_daily": f"""WITH RECURSIVE {_MEMBERS} SELECT date, CAST(year(date) AS INTEGER) AS year, threshold_c, CAST(n AS INTEGER) AS component_count, round(total, 1) AS total_area_km2, round(big, 1) AS largest_component_area_km2,
        round(big / total, 6) AS largest_component_area_fraction, round(total - big, 1) AS secondary_area_km2, round(1 - big / total, 6) AS fragmentation_index FROM day""",
    "lcc_centroid_distance": f"""WITH RECURSIVE {_MEMBERS}, ce AS (SELECT date, threshold_c, degrees(atan2(fy, fx)) AS flon, degrees(atan2(fz, sqrt(fx * fx + fy * fy))) AS flat, degrees(atan2(ty, tx)) AS tlon, degrees(atan2(tz, sqrt(tx * tx + ty * ty))) AS tlat FROM day)
        SELECT date, threshold_c, round(flat, 5) AS full_centroid_lat, round(tlat, 5) AS largest_centroid_lat,
        round(2 * 6371.0088 * asin(sqrt(least(1, greatest(0, sin(radians(tlat - flat) / 2) ^ 2 + cos(radians(flat)) * cos(radians(tlat)) * sin(radians(tlon - flon) / 2) ^ 2)))), 2) AS centroid_distance_km FROM ce""",
    "cell_occurrence": f"WITH RECURSIVE {_STATS} SELECT threshold_c, cell_id, n_valid, n_canonical, n_lcc, longest_run FROM st",
    "occurrence_summary": f"""WITH RECURSIVE {_STATS} SELECT threshold_c, count(*) AS valid_grid_cells, round(sum(n_lcc / n_valid * area_km2) / sum(area_km2), 6) AS area_weighted_mean_occurrence_fraction,
        count(*) FILTER (n_lcc / n_valid >= 0.1) AS grid_cells_occurrence_ge_0p10, count(*) FILTER (n_lcc / n_valid >= 0.5) AS grid_cells_occurrence_ge_0p50, count(*) FILTER (n_lcc / n_valid >= 0.9) AS grid_cells_occurrence_ge_0p90,
        round(CAST(median(longest_run) FILTER (longest_run > 0) AS DOUBLE), 6) AS median_longest_run_days_positive_cells, round(quantile_cont(CAST(longest_run AS DOUBLE), 0.95) FILTER (longest_run > 0), 6) AS p95_longest_run_days_positive_cells, max(longest_run) AS maximum_longest_run_days FROM st GROUP BY threshold_c""",
    "detached_summary": f"""WITH RECURSIVE {_STATS}, q AS (SELECT *, n_canonical - n_lcc AS gap, 100.0::DOUBLE * (n_canonical - n_lcc) / n_valid AS pct FROM st)
        SELECT threshold_c, round(sum(pct * area_km2) / sum(area_km2), 4) AS area_weighted_mean_detached_pct, round(100 * sum(gap * area_km2) / sum(n_canonical * area_km2), 4) AS detached_area_time_pct, round(max(pct), 4) AS maximum_detached_pct,
        first(cell_id ORDER BY pct DESC, cell_id) AS maximum_cell_id, """ + ", ".join(f"round(sum(CASE WHEN pct >= {c} THEN area_km2 ELSE 0 END), 4) AS area_km2_ge_{c}, count(*) FILTER (pct >= {c}) AS cells_ge_{c}" for c in _CUTS) + " FROM q GROUP BY threshold_c",
    "user_longest_active_run": "WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events), b AS (SELECT user_id, date_diff('day', DATE '1970-01-01', date) - row_number() OVER (PARTITION BY user_id ORDER BY date) AS island FROM a) SELECT user_id, CAST(max(n) AS INTEGER) AS longest_run FROM (SELECT user_id, island, count(*) AS n FROM b GROUP BY ALL) GROUP BY user_id",
    "definition_daily": f"WITH RECURSIVE {_FLAGS} SELECT date, " + ", ".join(f"round({d}_area_km2, 1) AS {d}_area_km2, round({d}_sst_area_integral, 4) AS {d}_sst_area_integral, round({d}_sst_area_integral / nullif({d}_area_km2, 0), 4) AS {d}_mean_sst" for d in _DEFS) + ", round(intersection_area_km2, 1) AS intersection_area_km2, round(union_area_km2, 1) AS union_area_km2, round(intersection_area_km2 / nullif(union_area_km2, 0), 4) AS area_jaccard, round(lcc_outside_box_area_km2, 1) AS lcc_outside_box_area_km2 FROM dd",
    "definition_annual": f"WITH RECURSIVE {_FLAGS}, t AS (" + " UNION ALL ".join(f"SELECT date, '{d}' AS definition, {d}_area_km2 AS a, {d}_sst_area_integral AS s FROM dd" for d in _DEFS) + ") SELECT definition, CAST(year(date) AS INTEGER) AS year, count(*) AS n_days, round(avg(a), 1) AS mean_daily_area_km2, round(median(a), 1) AS median_daily_area_km2, round(avg(s / nullif(a, 0)), 5) AS mean_daily_mean_sst, round(sum(s) / sum(a), 5) AS area_time_weighted_mean_sst FROM t GROUP BY definition, year(date)",
    "daily_series": f"WITH {_SERIES} SELECT date, round(value, 2) AS value FROM s",
    "daily_spine_gaps": f"WITH {_SERIES} SELECT date FROM span ANTI JOIN s USING (date)",
    "complete_years": f"WITH {_SERIES}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT date) AS n_days FROM s GROUP BY 1) SELECT year, n_days, n_days = {_LEAP} AS complete FROM y",
    "annual_means": f"WITH {_SERIES}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, avg(value) AS mean, count(*) AS n_days FROM fl GROUP BY 1) SELECT year, round(mean, 2) AS mean, n_days FROM y WHERE n_days = {_LEAP}",
    "monthly_climatology": f"WITH {_SERIES} SELECT CAST(month(date) AS INTEGER) AS month, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, count(*) AS n_days FROM s GROUP BY 1",
    "rolling_centered_mean": f"WITH {_SERIES} SELECT date, round(value, 2) AS value, CASE WHEN count(*) OVER w >= 183 THEN round(avg(value) OVER w, 2) END AS rolling_mean FROM fl WINDOW w AS (ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)",
    "theil_sen": f"""WITH {_MONTHLY}, sl AS (SELECT a.priority, median((b.y - a.y) / (b.x - a.x)) AS slope FROM mo a JOIN mo b ON a.priority = b.priority AND a.x < b.x GROUP BY 1)
        SELECT priority, count(*) AS n, round(any_value(slope), 4) AS slope, round(median(y) - any_value(slope) * median(x), 2) AS intercept, round(median(y - slope * x), 2) AS joint_intercept FROM mo JOIN sl USING (priority) GROUP BY priority""",
    "lag1_autocorrelation": f"WITH {_MONTHLY}, l AS (SELECT priority, y, lag(y) OVER (PARTITION BY priority ORDER BY x) AS b FROM mo) SELECT priority, round(least(greatest(corr(y, b), -0.99), 0.99), 6) AS lag1 FROM l GROUP BY priority",
    "linear_detrend": f"WITH {_MONTHLY}, r AS (SELECT priority, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic FROM mo GROUP BY 1) SELECT priority, x, round(y, 2) AS y, round(y - sl * x - ic, 2) AS residual FROM mo JOIN r USING (priority)",
    "representative_dates": f"WITH RECURSIVE {_MEMBERS}, t AS (SELECT date, round(big / total, 6) AS f FROM day WHERE threshold_c = 0.05), q AS (SELECT median(f) AS m FROM t) SELECT first(date ORDER BY round(abs(f - m), 6), date) AS median_date, first(date ORDER BY f, date) AS minimum_date FROM t, q",
    "qc_summary": f"""WITH RECURSIVE {_FLAGS}, o AS (SELECT max(lcc_area_km2 - canonical_area_km2) AS a, max(box_strict_area_km2 - box_inclusive_area_km2) AS b, CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS DOUBLE) AS c FROM dd)
        SELECT 'lcc_within_canonical' AS test, round(greatest(a, 0), 4) AS value, 0.0001::DOUBLE AS tolerance, a <= 0.0001 AS pass FROM o UNION ALL SELECT 'strict_within_inclusive', round(greatest(b, 0), 4), 0.0001::DOUBLE, b <= 0.0001 FROM o UNION ALL SELECT 'missing_days', greatest(c, 0), 0.0::DOUBLE, c <= 0 FROM o""",
}

for _name, _dates in {
    **dict.fromkeys(("field_cells", "field_valid_threshold", "lcc_components", "lcc_daily", "lcc_centroid_distance", "definition_daily", "daily_series", "daily_spine_gaps", "rolling_centered_mean"), ("date",)),
    "representative_dates": ("median_date", "minimum_date"),
}.items():
    ORACLES[_name] = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _dates) + f") FROM ({ORACLES[_name]})"
