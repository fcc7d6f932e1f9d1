"""The registered queries against their SQL on the smallest tables, and those without SQL by their digests."""

import hashlib
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

from gridspan.llm import bpe, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want, key=str) and want


def test_bpe_query_has_the_library_s_digests(spark, con):
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    ids = [e.ids for e in lib.encode_batch([t for _, t in rows], add_special_tokens=False)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(x), sha(",".join(map(str, x))), sha(back)) for (i, _), x, back in zip(rows, ids, lib.decode_batch(ids, skip_special_tokens=False))}
    got = queries.QUERIES["op2_bpe"](spark, DIR).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


@pytest.mark.parametrize("name,table,key", [("op3_quality", "documents", "doc_id"), ("op5_token_counts", "documents", "doc_id"), ("op10_language_id", "documents", "doc_id")])
def test_every_row_has_a_result(spark, con, name, table, key):
    want = sorted(con.execute(f"SELECT {key} FROM {table}").fetchall())
    assert sorted((r[key],) for r in queries.QUERIES[name](spark, DIR).select(key).collect()) == want
