"""Registered queries on trends, spectra, decompositions, periods and checks, with their SQL.

They use the same stand-ins as ``catalogue``: ``orders`` as a daily series and
monthly means by priority, ``embeddings`` as daily fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, decomposition, labelling, quantiles, regions, spectral, timeline, trends, wavelet
from ..sources import fields as src
from . import catalogue as base

BANDS = [("weeks", 5.0, 9.0), ("month", 25.0, 35.0), ("season", 60.0, 130.0)]
PERIODS = [("first", 1982, 1982), ("two years", 1982, 1983), ("later", 1990, 1999)]
SEGMENT, OVERLAP = 256, 128
KEY = ["series"]
SHARES = (0.01, 0.5, 0.95)


def _series(spark: SparkSession, d: str) -> DataFrame:
    return base._keyed_series(spark, d)


def theil_sen_ci(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(trends.theil_sen_interval(base._monthly(spark, d), ["priority"]), {"slope": 4, "low": 4, "high": 4})


def acf(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(trends.autocorrelations(base._monthly(spark, d), ["priority"]), {"rho": 6})


def effective_sample_size(spark: SparkSession, d: str) -> DataFrame:
    return base._rounded(trends.effective_sizes(base._monthly(spark, d), ["priority"]), {"effective_sample_size": 4, "df": 4})


def welch_bands(spark: SparkSession, d: str) -> DataFrame:
    days, statistics = spectral.series_statistics(_series(spark, d), KEY)
    out = spectral.band_variance(spectral.spectrum_of(days, statistics, KEY, SEGMENT, OVERLAP), statistics.select(*KEY, "variance"), KEY, BANDS)
    return base._rounded(out.drop("integrated_variance"), {"fraction_of_detrended_variance_pct": 4})


def welch_summary(spark: SparkSession, d: str) -> DataFrame:
    out = spectral.welch_summary(_series(spark, d), KEY, SEGMENT, OVERLAP)
    return out.select("series", "n_days", F.round("lag1", 6).alias("lag1"), "welch_segment_days", "overlap_days", F.round("effective_welch_dof", 6).alias("effective_welch_dof"), F.round("dominant_period_days", 6).alias("dominant_period_days"), F.format_string("%.6e", "detrended_variance").cast("double").alias("detrended_variance"))


def wavelet_power(spark: SparkSession, d: str) -> DataFrame:
    out = wavelet.wavelet_power(_series(spark, d), KEY)
    floor = F.log10(F.greatest("global_power", F.lit(1e-6)))
    return out.select("series", "k", "scale", "period_days", "n", "lag1", "sig95", "global_power", "global_sig95", floor.alias("log_global_power"))


def wavelet_coi(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients inside the cone of influence at every scale."""
    c = wavelet.coefficients(wavelet.wavelet_power(_series(spark, d), KEY), KEY)
    return c.groupBy("series", "k").agg(F.count_if("inside").alias("n_inside"), F.count(F.lit(1)).alias("n"))


def wavelet_bands(spark: SparkSession, d: str) -> DataFrame:
    return wavelet.wavelet_bands(wavelet.wavelet_power(_series(spark, d), KEY), KEY, BANDS)


def _stl(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.stl_components(_series(spark, d), KEY)


def stl_components(spark: SparkSession, d: str) -> DataFrame:
    return _stl(spark, d)


def stl_amplitude(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.annual_amplitude(_stl(spark, d), KEY)


def stl_summary(spark: SparkSession, d: str) -> DataFrame:
    return decomposition.stl_summary(_stl(spark, d), KEY)


def definition_overlap(spark: SparkSession, d: str) -> DataFrame:
    out = base._definitions(spark, d).select("date", "intersection_area_km2", "union_area_km2", "lcc_outside_box_area_km2", "area_jaccard")
    return base._rounded(out, {"intersection_area_km2": 1, "union_area_km2": 1, "lcc_outside_box_area_km2": 1, "area_jaccard": 6})


def definition_period(spark: SparkSession, d: str) -> DataFrame:
    out = regions.period_summary(base._definitions(spark, d), PERIODS)
    return base._rounded(out, {c: 1 if c.endswith("km2") else 5 for c, t in out.dtypes if t == "double"})


def record_check(spark: SparkSession, d: str) -> DataFrame:
    e = src.read_table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("date"), "value")
    daily = e.groupBy("event_type", "date").agg(F.sum("value").alias("value"))
    return checks.record_check(daily, ["event_type"], values=["value"])


def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the prices of the items by return flag: three groups that hold all rows."""
    out = quantiles.quantiles(src.read_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", SHARES)
    return base._rounded(out, {"quantile": 4})


def null_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nulls, NaN among them, of each column of the events and of a day's sums by type, where a type has no value on a day."""
    e = src.read_table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("date"), "value", F.when(F.col("value") > 50, F.col("value")).alias("large"))
    daily = e.groupBy("event_type", "date").agg(F.sum("value").alias("value"), F.sum("large").alias("large"))
    return checks.null_counts(daily, ["event_type"], ["date", "value", "large"])


def grid_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.grid_check(base._seen_grid(spark, d), base.N_LAT, base.N_LON)


def reference_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The largest component's area from the components against the same from its cells."""
    by = ["date", "threshold_c"]
    top = base._components(spark, d).filter("largest").select(*by, F.col("area_km2").alias("area"))
    cells = labelling.component_areas(base._members(spark, d).filter("largest"), base._grid(spark)).select(*by, F.col("area_km2").alias("area"))
    qc = checks.reconcile(top, cells, by, "area", "lcc_area_two_ways", 1e-4, 1e-11)
    return qc.select("test", F.round("value", 2).alias("value"), F.round("tolerance", 3).alias("tolerance"), "pass")


QUERIES = {f.__name__: base._dated(f) for f in (
    theil_sen_ci, acf, effective_sample_size, welch_bands, welch_summary, wavelet_power, wavelet_coi, wavelet_bands, stl_components, stl_amplitude, stl_summary,
    definition_overlap, definition_period, record_check, exact_quantiles, null_counts, grid_check, reference_reconcile,
)}

_RHO = base._MONTHLY + """,
c AS (SELECT priority, y - avg(y) OVER (PARTITION BY priority) AS z, row_number() OVER (PARTITION BY priority ORDER BY x) AS t, count(*) OVER (PARTITION BY priority) AS n FROM mo),
r AS (SELECT a.priority, a.n, CAST(b.t - a.t AS INTEGER) AS lag, sum(a.z * b.z) / any_value(a.n - (b.t - a.t)) AS v FROM c a JOIN c b ON a.priority = b.priority AND b.t >= a.t GROUP BY ALL),
rho AS (SELECT r.priority, r.n, r.lag, coalesce(r.v / nullif(o.v, 0), 0) AS rho FROM r JOIN r o ON o.priority = r.priority AND o.lag = 0)"""
_KEYED = """s AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
fl AS (SELECT series, date, coalesce(value, 0) AS value FROM (SELECT DISTINCT series FROM s) CROSS JOIN (SELECT CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM s) LEFT JOIN s USING (series, date))"""
_WELCH = _KEYED + f""",
tt AS (SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS DOUBLE) AS x, value AS y, count(*) OVER (PARTITION BY series) AS n FROM fl),
ln AS (SELECT series, regr_intercept(y, x) AS ic, regr_slope(y, x) AS sl FROM tt GROUP BY series),
z AS (SELECT series, CAST(x AS BIGINT) AS x, n, y - ic - sl * x AS z FROM tt JOIN ln USING (series)),
seg AS (SELECT series, s, j, z.z * (0.5 - 0.5 * cos(2 * pi() * j / {SEGMENT})) AS v FROM (SELECT unnest(range(0, (SELECT max(n) FROM z) - {SEGMENT} + 1, {SEGMENT - OVERLAP})) AS s), range({SEGMENT}) q(j) JOIN z ON z.x = s + j),
ft AS (SELECT series, s, k, sum(v * cos(2 * pi() * j * k / {SEGMENT})) AS re, sum(v * sin(2 * pi() * j * k / {SEGMENT})) AS im FROM seg, range(1, {SEGMENT // 2 + 1}) f(k) GROUP BY series, s, k),
psd AS (SELECT series, CAST(k AS INTEGER) AS k, k / {SEGMENT}.0::DOUBLE AS f, avg(re * re + im * im) / (SELECT sum((0.5 - 0.5 * cos(2 * pi() * j / {SEGMENT})) ^ 2) FROM range({SEGMENT}) w(j)) * (CASE WHEN k < {SEGMENT // 2} THEN 2 ELSE 1 END) AS p FROM ft GROUP BY series, k),
vz AS (SELECT series, var_samp(z) AS variance FROM z GROUP BY series)"""
_BAND_ROWS = ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in BANDS)
_PERIOD_ROWS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in PERIODS)
_LAMBDA = f"{wavelet.LAMBDA!r}::DOUBLE"

_GRID_TESTS = """SELECT test, value, 0.0::DOUBLE AS tolerance, value <= 0 AS pass FROM (
        SELECT 'lat_ascending' AS test, CAST(count(*) FILTER (step <= 0 OR spread > 1e-8) AS DOUBLE) AS value FROM (SELECT x - lag(x) OVER (ORDER BY i) AS step, spread FROM (SELECT i, min(lat) AS x, max(lat) - min(lat) AS spread FROM {t} GROUP BY i))
        UNION ALL SELECT 'lon_ascending', CAST(count(*) FILTER (step <= 0 OR spread > 1e-8) AS DOUBLE) FROM (SELECT x - lag(x) OVER (ORDER BY j) AS step, spread FROM (SELECT j, min(lon) AS x, max(lon) - min(lon) AS spread FROM {t} GROUP BY j))
        UNION ALL SELECT 'cells_present', CAST(abs(count(DISTINCT cell_id) - 64) AS DOUBLE) FROM {t} UNION ALL SELECT 'areas_positive', CAST(count(*) FILTER (area_km2 IS NULL OR NOT area_km2 > 0) AS DOUBLE) FROM {t})"""

ORACLES = {
    "theil_sen_ci": f"""WITH {base._MONTHLY}, sl AS (SELECT a.priority, (b.y - a.y) / (b.x - a.x) AS slope FROM mo a JOIN mo b ON a.priority = b.priority AND a.x < b.x),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY slope) AS r, count(*) OVER (PARTITION BY priority) AS nt FROM sl),
        ties AS (SELECT priority, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT priority, x AS v, 0 AS s, count(*) AS k FROM mo GROUP BY ALL UNION ALL SELECT priority, y, 1, count(*) FROM mo GROUP BY ALL) GROUP BY priority),
        sg AS (SELECT priority, count(*) AS n, sqrt((count(*) * (count(*) - 1) * (2 * count(*) + 5) - any_value(tied)) / 18.0::DOUBLE) * {trends.Z95}::DOUBLE AS zs FROM mo JOIN ties USING (priority) GROUP BY priority)
        SELECT priority, any_value(n) AS n, round(median(slope), 4) AS slope, round(max(slope) FILTER (r = greatest(round_even((nt - zs) / 2, 0), 1)), 4) AS low,
        round(max(slope) FILTER (r = least(round_even((nt + zs) / 2, 0), nt - 1) + 1), 4) AS high FROM ranked JOIN sg USING (priority) GROUP BY priority""",
    "acf": f"WITH {_RHO} SELECT priority, lag, round(rho, 6) AS rho FROM rho",
    "effective_sample_size": f"""WITH {_RHO}, pr AS (SELECT priority, n, (lag + 1) // 2 AS m, sum(rho) AS pair, sum((1 - lag / n) * rho) AS w FROM rho WHERE lag > 0 GROUP BY ALL HAVING count(*) = 2),
        bad AS (SELECT priority, min(m) AS m FROM pr WHERE pair <= 0 GROUP BY priority),
        e AS (SELECT mo.priority, count(*) AS n, coalesce((SELECT sum(w) FROM pr LEFT JOIN bad USING (priority) WHERE pr.priority = mo.priority AND (bad.m IS NULL OR pr.m < bad.m)), 0) AS s FROM mo GROUP BY mo.priority),
        f AS (SELECT priority, n, least(greatest(n / (1 + 2 * s), 3), n) AS v FROM e)
        SELECT priority, CAST(n AS INTEGER) AS n, round(v, 4) AS effective_sample_size, round(greatest(v - 2, 1), 4) AS df FROM f""",
    "welch_bands": f"""WITH {_WELCH}, b(band, lo, hi) AS (VALUES {_BAND_ROWS})
        SELECT series, band, any_value(lo) AS minimum_period_days, any_value(hi) AS maximum_period_days, count(*) AS n_frequencies,
        round(100 * sum(p / {SEGMENT}.0::DOUBLE) / any_value(variance), 4) AS fraction_of_detrended_variance_pct FROM b JOIN psd ON f BETWEEN 1 / hi AND 1 / lo JOIN vz USING (series) GROUP BY series, band""",
    "welch_summary": f"""WITH {_WELCH}, nn AS (SELECT series, any_value(n) AS n FROM z GROUP BY series), ar AS (SELECT series, least(greatest(corr(b.z, a.z), -0.99), 0.99) AS r FROM z a JOIN z b USING (series) WHERE b.x = a.x + 1 GROUP BY series),
        sh AS (SELECT m, (sum((0.5 - 0.5 * cos(2 * pi() * j / {SEGMENT})) * (0.5 - 0.5 * cos(2 * pi() * (j + m * {SEGMENT - OVERLAP}) / {SEGMENT}))) / (0.375 * {SEGMENT})) ^ 2 AS w FROM range(1, {-(-SEGMENT // (SEGMENT - OVERLAP))}) q(m), range({SEGMENT}) t(j) WHERE j + m * {SEGMENT - OVERLAP} < {SEGMENT} GROUP BY m),
        df AS (SELECT series, 2 * ks / (1 + 2 * (SELECT coalesce(sum((1 - m / ks) * w), 0) FROM sh WHERE m < ks)) AS dof FROM (SELECT series, 1 + (n - {SEGMENT}) // {SEGMENT - OVERLAP} AS ks FROM nn)),
        dp AS (SELECT series, first(1 / f ORDER BY p DESC, k) AS d FROM psd GROUP BY series)
        SELECT series, CAST(n AS INTEGER) AS n_days, round(r, 6) AS lag1, {SEGMENT} AS welch_segment_days, {OVERLAP} AS overlap_days, round(dof, 6) AS effective_welch_dof, round(d, 6) AS dominant_period_days, CAST(printf('%.6e', variance) AS DOUBLE) AS detrended_variance
        FROM nn JOIN ar USING (series) JOIN df USING (series) JOIN dp USING (series) JOIN vz USING (series)""",
    "wavelet_coi": f"""WITH {_KEYED}, sz AS (SELECT series, count(*) AS n FROM fl GROUP BY series), ks AS (SELECT series, n, unnest(range(CAST(floor(log2(n / 2) * 12) AS BIGINT) + 1)) AS k FROM sz), pl AS (SELECT series, n, k, {_LAMBDA} * 2 * 2 ^ (k / 12) AS period, unnest(range(n)) AS t FROM ks)
        SELECT series, CAST(k AS INTEGER) AS k, count(*) FILTER (period <= {_LAMBDA} / sqrt(2) * (n / 2 - abs(t - (n - 1) / 2))) AS n_inside, count(*) AS n FROM pl GROUP BY series, k""",
    "definition_overlap": f"WITH RECURSIVE {base._FLAGS} SELECT CAST(date AS VARCHAR) AS date, round(intersection_area_km2, 1) AS intersection_area_km2, round(union_area_km2, 1) AS union_area_km2, round(lcc_outside_box_area_km2, 1) AS lcc_outside_box_area_km2, round(intersection_area_km2 / nullif(union_area_km2, 0), 6) AS area_jaccard FROM dd",
    "definition_period": f"""WITH RECURSIVE {base._FLAGS}, p AS (SELECT * FROM (VALUES {_PERIOD_ROWS}) v(period, a, b) WHERE a >= (SELECT min(year(date)) FROM dd) AND b <= (SELECT max(year(date)) FROM dd)),
        t AS ({" UNION ALL ".join(f"SELECT date, '{d}' AS definition, {d}_area_km2 AS a, {d}_sst_area_integral AS s FROM dd" for d in base._DEFS)}),
        o AS (SELECT *, lcc_area_km2 - box_strict_area_km2 AS diff FROM dd)
        SELECT definition, period, count(*) AS n_days, round(avg(t.a), 1) AS mean_daily_area_km2, round(median(t.a), 1) AS median_daily_area_km2, round(avg(s / nullif(t.a, 0)), 5) AS mean_daily_mean_sst, round(sum(s) / nullif(sum(t.a), 0), 5) AS area_time_weighted_mean_sst,
          CAST(NULL AS DOUBLE) AS mean_daily_difference_km2, CAST(NULL AS DOUBLE) AS median_daily_difference_km2, CAST(NULL AS DOUBLE) AS mean_relative_difference_pct, CAST(NULL AS DOUBLE) AS mean_area_jaccard, CAST(NULL AS DOUBLE) AS mean_intersection_area_km2, CAST(NULL AS DOUBLE) AS mean_lcc_outside_box_area_km2
          FROM t JOIN p ON year(date) BETWEEN p.a AND p.b GROUP BY definition, period
        UNION ALL SELECT 'lcc_minus_box_strict', period, count(*), NULL, NULL, NULL, NULL, round(avg(diff), 1), round(median(diff), 1), round(100 * avg(diff) / nullif(avg(box_strict_area_km2), 0), 5), round(avg(intersection_area_km2 / nullif(union_area_km2, 0)), 5), round(avg(intersection_area_km2), 1), round(avg(lcc_outside_box_area_km2), 1)
          FROM o JOIN p ON year(date) BETWEEN p.a AND p.b GROUP BY period""",
    "record_check": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY ALL), s AS (SELECT CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS e FROM d)
        SELECT event_type, any_value(e) AS n_expected, any_value(e) - count(DISTINCT date) AS n_missing, count(*) FILTER (date IS NULL) AS n_outside, count(date) - count(DISTINCT date) AS n_repeated, count(*) FILTER (value IS NULL) AS n_null,
        any_value(e) = count(DISTINCT date) AND count(*) = count(value) AND count(date) = count(DISTINCT date) AND count(*) = count(date) AS complete FROM d, s GROUP BY event_type""",
    "exact_quantiles": " UNION ALL ".join(f"SELECT l_returnflag, {q}::DOUBLE AS share, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, {q}), 4) AS quantile FROM lineitem GROUP BY l_returnflag" for q in SHARES),
    "null_counts": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(value) AS value, sum(value) FILTER (value > 50) AS large FROM events GROUP BY ALL),
        l AS (SELECT event_type, 'date' AS field, date IS NULL AS x FROM d UNION ALL SELECT event_type, 'value', value IS NULL OR isnan(value) FROM d UNION ALL SELECT event_type, 'large', large IS NULL OR isnan(large) FROM d)
        SELECT event_type, field, count(*) AS n_rows, count(*) FILTER (x) AS n_null FROM l GROUP BY ALL""",
    "grid_check": f"WITH {base._CELLS} {_GRID_TESTS.format(t='seen')}",
    "dominant_period": f"WITH {_WELCH} SELECT series, round(first(1 / f ORDER BY p DESC, k), 6) AS dominant_period_days FROM psd GROUP BY series",
    "reference_reconcile": f"""WITH RECURSIVE {base._MEMBERS}, w AS (SELECT l.date, l.threshold_c, sum(g.area_km2) AS a FROM lcc l JOIN g USING (cell_id) GROUP BY ALL)
        SELECT 'lcc_area_two_ways' AS test, round(max(abs(top.area_km2 - w.a)), 2) AS value, round(0.0001 + 1e-11 * max(w.a), 3) AS tolerance, max(abs(top.area_km2 - w.a)) <= 0.0001 + 1e-11 * max(w.a) AS pass FROM top JOIN w USING (date, threshold_c)""",
}
