"""Stored tables of which a reader sees the old or the new version and nothing between.

A table is a folder with folders of its own for each version and one small
document, ``current.json``, that names those in use. A version is written whole
beside the others; then a new document takes the old one's place by one rename.
A job that is cut off at any point leaves the old table, and folders that
nothing names are removed by the next one that gets through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

CURRENT = "current.json"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> dict | None:
    """The document of a stored table; None where there is no table."""
    p, fs = _hadoop(spark, f"{path}/{CURRENT}")
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def swap(spark: SparkSession, path: str, document: dict) -> None:
    """Put ``document`` in the place of the one in use, by a rename that replaces it."""
    jvm = spark._jvm
    aside, fs = _hadoop(spark, f"{path}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(document, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = fs.makeQualified(_hadoop(spark, f"{path}/{CURRENT}")[0])
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), target, how)


def _clear(spark: SparkSession, path: str, keep: Iterable[str]) -> None:
    """Remove the folders of ``path`` that the document in use does not name."""
    p, fs = _hadoop(spark, path)
    names = set(keep)
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name != CURRENT and name not in names:
            fs.delete(status.getPath(), True)


def publish(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the new version of the table at ``path``, read again."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    swap(spark, path, {"folder": name})
    _clear(spark, path, [name])
    return spark.read.parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The version in use; None where there is no table."""
    found = current(spark, path)
    return spark.read.parquet(f"{path}/{found['folder']}") if found else None


class Years:
    """A table stored by year: the document names each year's folder and the digest of what it was made from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.years: dict[int, dict] = {int(y): v for y, v in (current(spark, path) or {}).get("years", {}).items()}

    def table(self, years: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of the years, with a column ``year``; None where none of them is stored."""
        own = sorted({f"{self.path}/{v['folder']}" for y, v in self.years.items() if years is None or y in set(years)})
        return self.spark.read.parquet(*own) if own else None

    def replace(self, build: Callable[[list[int]], DataFrame], years: list[int], digests: dict[int, str]) -> None:
        """Build years and put them in the place of those in use; ``build`` gives rows with a column ``year``."""
        name = f"b-{uuid.uuid4().hex}"
        build(years).withColumnRenamed("year", "_year_of_folder").selectExpr("*", "_year_of_folder AS year").write.partitionBy("_year_of_folder").parquet(f"{self.path}/{name}")
        self.years |= {y: {"folder": f"{name}/_year_of_folder={y}", "digest": digests.get(y)} for y in years}
        _, fs = _hadoop(self.spark, self.path)
        self.years = {y: v for y, v in self.years.items() if fs.exists(_hadoop(self.spark, f"{self.path}/{v['folder']}")[0])}  # a year without rows has none
        swap(self.spark, self.path, {"years": {str(y): v for y, v in self.years.items()}})
        _clear(self.spark, self.path, {v["folder"].split("/")[0] for v in self.years.values()})
