"""Command line: the analysis of a project folder, or one registered query over a folder of tables."""

from __future__ import annotations

import argparse

from .plans import analysis, catalogue, record_catalogue, series_catalogue
from .session import local_session


def period(text: str) -> tuple[str, int, int]:
    try:
        name, first, last = text.rsplit(":", 2)
        return name, int(first), int(last)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not NAME:FIRST:LAST") from None


def settings(a: argparse.Namespace) -> analysis.Settings:
    periods = () if a.no_periods else tuple(a.period) if a.period else analysis.PERIODS
    threshold = min(a.thresholds) if a.box_threshold is None else a.box_threshold
    return analysis.Settings(a.start_date, a.end_date, tuple(a.thresholds), tuple(a.box_lat), tuple(a.box_lon), threshold, periods)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gridspan", description=__doc__)
    p.add_argument("--project-root", help="folder with grid and fields; results go below it")
    p.add_argument("--query", help="run this query instead, or 'list' for all names")
    p.add_argument("--data", help="folder of the query's tables")
    p.add_argument("--output", help="where the query's rows go, as Parquet")
    p.add_argument("--start-date", default="1981-09-01")
    p.add_argument("--end-date", default="2026-07-29")
    p.add_argument("--thresholds", type=float, nargs="+", default=[28.0, 28.5, 29.0])
    p.add_argument("--box-lat", type=float, nargs=2, default=analysis.BOX_LAT, metavar=("SOUTH", "NORTH"), help="latitudes of the box that the largest component is compared with")
    p.add_argument("--box-lon", type=float, nargs=2, default=analysis.BOX_LON, metavar=("WEST", "EAST"), help="longitudes of the box, degrees east from 0 to 360")
    p.add_argument("--box-threshold", type=float, help="threshold of the box; the first of --thresholds unless given")
    p.add_argument("--period", action="append", type=period, metavar="NAME:FIRST:LAST", help="years whose definitions are summed up; may be repeated")
    p.add_argument("--no-periods", action="store_true", help="no table of periods")
    p.add_argument("--rebuild-daily", action="store_true", help="do not use stored daily tables")
    p.add_argument("--rebuild-spatial", action="store_true", help="do not use the stored tables of cells")
    p.add_argument("--check-inputs", action="store_true", help="build years anew whose fields have changed since they were stored")
    p.add_argument("--no-raw-maps", action="store_true", help="fail rather than read fields")
    p.add_argument("--refresh-provenance-only", action="store_true", help="check stored results, write metadata and manifest")
    p.add_argument("--derive-detachment-only", action="store_true", help="only the tables of detached cells, from stored counts")
    p.add_argument("--no-qc-reference", action="store_true", help="do not hold the definitions against the components' table")
    p.add_argument("--log-level", default="WARNING", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    queries = catalogue.QUERIES | series_catalogue.QUERIES | record_catalogue.QUERIES
    if a.query == "list":
        print("\n".join(sorted(queries)))
        return
    spark = local_session()
    spark.sparkContext.setLogLevel(a.log_level.replace("WARNING", "WARN"))
    if a.query:
        out = queries[a.query](spark, a.data)
        out.write.mode("overwrite").parquet(a.output) if a.output else out.show(50, truncate=False)
        return
    p = analysis.Project(spark, a.project_root, settings(a), a.no_raw_maps, a.check_inputs)
    if a.refresh_provenance_only:
        analysis.provenance(p, refresh=True)
    elif a.derive_detachment_only:
        analysis.detached(p)
    else:
        analysis.components(p, a.rebuild_daily, a.rebuild_spatial)
        analysis.variability(p)
        if not a.no_raw_maps:
            analysis.snapshots(p)
        analysis.comparison(p, a.rebuild_daily, not a.no_qc_reference)
        analysis.provenance(p)


if __name__ == "__main__":
    main()
