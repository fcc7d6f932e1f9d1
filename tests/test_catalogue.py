"""Registered queries against their SQL on the small tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from gridspan.plans import catalogue, record_catalogue, series_catalogue

QUERIES = catalogue.QUERIES | series_catalogue.QUERIES | record_catalogue.QUERIES
ORACLES = catalogue.ORACLES | series_catalogue.ORACLES | record_catalogue.ORACLES
DIR = "/root/testdata/sf0.001"


def rows(cursor_rows):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.isoformat() if isinstance(v, datetime.date) else v

    return sorted((tuple(plain(v) for v in r) for r in cursor_rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    out = rows(got.select(names).collect())
    if name in ORACLES:
        assert out == rows(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall())
    else:
        assert out
