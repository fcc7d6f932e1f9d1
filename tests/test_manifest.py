"""Checksums of all files of a folder against hashlib."""

import hashlib

import pytest

from gridspan.plans import catalogue
from gridspan.sources import products

FILES = {"nation.parquet": b"n", "orders.parquet/part-0.parquet": b"0123456789" * 400_000, "orders.parquet/_SUCCESS": b"", "deep/er/a b%20ü.txt": b"x\r\n", ".hidden": b"\xff\x00"}


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty").mkdir()
    return tmp_path


def checksums(df):
    return sorted(tuple(r) for r in df.select("relative_path", "bytes", "sha256").collect())


WANT = sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in FILES.items())


def test_manifest_has_all_files(spark, folder):
    assert checksums(catalogue.QUERIES["manifest"](spark, str(folder))) == WANT
    assert checksums(products.manifest(spark, f"file://{folder}/")) == WANT
    assert checksums(products.manifest(spark, f"{folder}/empty")) == []


@pytest.mark.parametrize("whole", [products.WHOLE, 2])
def test_manifest_of_a_store_that_only_spark_reads(spark, folder, monkeypatch, whole):
    monkeypatch.setattr(products, "WHOLE", whole)
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.m{whole}.link./in", f"file://{folder}")
    assert checksums(products.manifest(spark, f"viewfs://m{whole}/in")) == WANT
    assert checksums(products.manifest(spark, f"viewfs://m{whole}/in/empty")) == []
