"""Products of a run: small tables as CSV, metadata as JSON, a yearly checkpoint, fallback inputs, checksums."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_of, threshold_of
from ..session import ship
from . import versions

PIECE = 1 << 20
#: Bytes of a file that a task may hold whole, where a store gives no pieces.
WHOLE = 256 << 20
#: Tasks of a manifest at most.
TASKS = 10_000
CHECKSUMS = "relative_path string, bytes long, sha256 string"


def write_csv(df: DataFrame, path: str, digits: int = 10) -> None:
    """A small table with a header, in one file; doubles with ``digits`` significant digits.

    It is written beside ``path`` and put in its place when it is whole; what was
    there before stays until then.
    """
    out = df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), None).otherwise(F.format_string(f"%.{digits - 1}e", c)).cast("double") for c, t in df.dtypes if t == "double"})
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    out.coalesce(1).write.option("header", True).csv(aside)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    before = hadoop(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(hadoop(path)) and fs.rename(hadoop(path), before)
    if not fs.rename(hadoop(aside), hadoop(path)):
        if had:
            fs.rename(before, hadoop(path))
        raise OSError(f"{aside} could not be moved to {path}")
    if had:
        fs.delete(before, True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One document, written where Spark writes."""
    spark.createDataFrame([(json.dumps(value, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\x1e")


def read_json(spark: SparkSession, path: str, expect: dict | None = None) -> dict:
    """The document, or an error if a field is not as expected (a version, thresholds)."""
    value = json.loads(spark.read.text(path, wholetext=True).first()["value"].strip("\x1e"))
    wrong = [k for k, v in (expect or {}).items() if value.get(k) != v]
    if wrong:
        raise RuntimeError(f"{path}: {', '.join(sorted(wrong))} not as expected")
    return value


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def incomplete_years(done: DataFrame | None, spark: SparkSession, start: str, end: str) -> list[int]:
    """Years of the span whose stored dates are not exactly those expected."""
    want = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    want = want.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    if done is not None:
        have = done.groupBy("year").agg(F.count_distinct("date").alias("m"), F.min("date").alias("c"), F.max("date").alias("d"))
        want = want.join(have, "year", "left").filter("m is null or m <> n or a <> c or b <> d")
    return sorted(r["year"] for r in want.select("year").collect())  # a row a year


def yearly(spark: SparkSession, path: str, build: Callable[[list[int]], DataFrame], start: str, end: str, rebuild: bool = False, digests: dict[int, str] | None = None) -> DataFrame:
    """A daily table stored by year; ``build(years)`` is called for the years that are absent or incomplete, or whose input has another digest than when they were made.

    Only those years are written, beside the ones in use, and take their place
    by one rename, so a job that was cut off goes on where it stood and readers
    never see half a year.
    """
    stored, want = versions.Years(spark, path), digests or {}
    done = None if rebuild else stored.table()
    todo = set(incomplete_years(done, spark, start, end))
    if digests is not None:
        todo |= {y for y in range(int(start[:4]), int(end[:4]) + 1) if stored.years.get(y, {}).get("digest") != want.get(y)}
    if todo:
        stored.replace(lambda years: build(years).withColumn("year", F.year("date")), sorted(todo), want)
    return stored.table().filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def year_digests(fields: DataFrame) -> dict[int, str]:
    """A digest of the rows (date, values) of each year that does not depend on their order: one pass, a row for each year comes to the driver."""
    mark = F.xxhash64("date", "values").cast("decimal(20,0)")
    rows = fields.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("s"), F.bit_xor(F.xxhash64("values", "date")).alias("x"))
    return {r["year"]: f"{r['n']}:{r['s']}:{r['x']}" for r in rows.collect()}


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], required: Iterable[str] = (), rebuild: bool = False) -> DataFrame:
    """A stored table, built anew if it is absent, lacks a required column or ``rebuild`` is set; the old one stays in use until the new one is whole."""
    found = None if rebuild else versions.read(spark, path)
    if found is not None and set(required) <= set(found.columns):
        return found
    return versions.publish(build(), path)


def flattened(df: DataFrame, keys: list[str], thresholds: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, t<code>__<name> ...): a column for each threshold and value of rows (keys, threshold_c, names). A threshold without rows is an error."""
    lacking = set(thresholds) - {r["threshold_c"] for r in df.select("threshold_c").distinct().collect()}  # a row a threshold
    if lacking:
        raise ValueError("no rows at " + ", ".join(f"{t:g}" for t in sorted(lacking)))
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col("threshold_c") == t, F.col(n))).alias(f"t{code_of(t)}__{n}") for t in thresholds for n in names))


def unflattened(df: DataFrame, keys: list[str], thresholds: Sequence[float]) -> DataFrame:
    """(keys, threshold_c, name, value) of the columns t<code>__<name>. A threshold without columns is an error."""
    parts = [(c, threshold_of(c.split("__", 1)[0][1:]), c.split("__", 1)[1]) for c in df.columns if "__" in c and c not in keys]
    lacking = set(thresholds) - {t for _, t, _ in parts}
    if lacking:
        raise ValueError("no columns at " + ", ".join(f"{t:g}" for t in sorted(lacking)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold_c"), F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for c, t, n in parts))
    return df.select(*keys, F.inline(rows))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h, n = hashlib.sha256(), 0
            with open(path, "rb") as f:
                while piece := f.read(PIECE):
                    h.update(piece)
                    n += len(piece)
            yield pa.record_batch([pa.array([name]), pa.array([n]), pa.array([h.hexdigest()])], names=["relative_path", "bytes", "sha256"])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, bytes, sha256) of every file below a folder, hidden ones too.

    Where the folder has a path of its own on every machine (``file:``), tasks
    read files in pieces of 1 MiB. Python cannot open other stores: there tasks
    take files of up to ``WHOLE`` bytes as ``binaryFile`` rows, and the driver's
    JVM streams longer ones and those that Spark's readers leave out (names with
    _ or . in front) in pieces. The .crc files of Hadoop's own local file system
    are not listed. An empty folder gives no rows.
    """
    ship(spark)
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    found, it = [], fs.listFiles(base, True)
    while it.hasNext():
        status = it.next()
        path = status.getPath()
        found.append((status.getLen(), path.toString(), path.toUri().getPath(), path))
    if fs.getUri().getScheme() == "file":
        found.sort(key=lambda x: (-x[0], x[2]))
        n = max(1, min(len(found), TASKS))
        rows = [(x[2], x[2].removeprefix(root)) for k in range(n) for x in found[k::n]]  # each task gets long and short files
        if not rows:
            return spark.createDataFrame([], CHECKSUMS)
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "path string, name string").mapInArrow(_hashed, CHECKSUMS)

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= WHOLE)
    seen = {r["path"] for r in whole.select("path").collect()}

    def stream(x: tuple) -> tuple[str, int, str]:
        digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(x[3]), out, PIECE, True)
        return x[2].removeprefix(root), x[0], bytes(digest.digest()).hex()

    with ThreadPoolExecutor(4) as pool:
        rest = list(pool.map(stream, (x for x in found if x[1] not in seen)))
    head = fs.makeQualified(base).toString().rstrip("/") + "/"
    out = whole.select(F.substr("path", F.lit(len(head) + 1)).alias("relative_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return out.unionByName(spark.createDataFrame(rest, CHECKSUMS)) if rest else out
