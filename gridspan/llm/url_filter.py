"""URL filters by a sorted digest array.

The rules' keys (``host + path``) are hashed with 64-bit xxhash, sorted and
written as one binary file: the sorted digests, the offsets of the full
strings, the actions and the strings. The file travels with
``SparkContext.addFile``; every task memory-maps it, so tasks on one machine
share its pages and its size is bounded by disk rather than by heap. A url's
candidate keys (each suffix of its host at a dot, times each prefix of its
path that has the length of some rule's path) are probed together with one
vectorised binary search, and every digest hit is confirmed against the stored
string, so a collision cannot decide.

Defined results: a null url, or one without ``://``, has an empty host and
path. Where no rule fits, the verdict is ``default`` (allow). Rules of the same
key: the last given wins; null rules are ignored; with no rules every url gets
the default. Repeated urls are judged alike; columns other than the id and the
url are not read. The id may be null and is returned as it is.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ACTIONS = ("allow", "block")
#: (host, path, action) of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def write_digest_array(rules: Iterable[tuple[str, str, str]], path: str) -> list[int]:
    """Write the sorted digest array of the rules to ``path``; returns the distinct lengths of their paths."""
    keyed = {(h + p): (len(p), a) for h, p, a in rules if h is not None and p is not None}
    rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), a) for k, (_, a) in keyed.items())
    digests = np.array([r[0] for r in rows], dtype=np.uint64)
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64)
    actions = np.array([ACTIONS.index(r[2]) for r in rows], dtype=np.uint8)
    with open(path, "wb") as f:
        f.write(np.array([len(rows)], dtype=np.int64).tobytes() + digests.tobytes() + offsets.tobytes() + actions.tobytes() + b"".join(r[1] for r in rows))
    return sorted({n for n, _ in keyed.values()})


class DigestArray:
    """A memory-mapped digest array: ``find`` gives the row of each key, or -1."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view(np.int64)[0])
        self.digests = raw[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.actions = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Binary search of all keys at once; equal digests are walked until the stored string matches."""
        n = len(self.digests)
        out = np.full(len(keys), -1, dtype=np.int64)
        if not n or not keys:
            return out
        digest = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(self.digests, digest)
        for k in np.flatnonzero(self.digests[np.minimum(at, n - 1)] == digest):
            row = int(at[k])
            while row < n and self.digests[row] == digest[k]:
                if self.strings[self.offsets[row] : self.offsets[row + 1]].tobytes() == keys[k]:
                    out[k] = row
                    break
                row += 1
        return out


def _suffixes(host: str) -> list[str]:
    """The host and what follows each of its dots."""
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url by the longest rule that fits: (id, host, path, rule, verdict), a row for each input row."""
    spark = df.sparkSession
    name = f"rules-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="gridspan-"), name)
    lengths = write_digest_array(rules, local)
    spark.sparkContext.addFile(local)

    u = F.col(url_col)
    # host and path are cut natively: only ASCII letters of the host change case
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + F.lit(3), F.length(u)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    cut = df.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            keys: list[bytes] = []
            owner: list[int] = []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                if not h and not p:
                    continue
                for n in lengths:
                    if n <= len(p):
                        for s in _suffixes(h):
                            keys.append((s + p[:n]).encode())
                            owner.append(i)
            rows = array.find(keys)
            best = [-1] * len(hosts)
            size = [-1] * len(hosts)
            for k in np.flatnonzero(rows >= 0):
                if len(keys[k]) > size[owner[k]]:
                    best[owner[k]], size[owner[k]] = k, len(keys[k])
            yield pa.record_batch(
                [
                    b.column(0),
                    b.column(1),
                    b.column(2),
                    pa.array([keys[k].decode() if k >= 0 else None for k in best], pa.string()),
                    pa.array([ACTIONS[array.actions[rows[k]]] if k >= 0 else default for k in best], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    schema = f"page_id {df.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return cut.mapInArrow(judge, schema)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


SQL = {
    "op4_url_filters": """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
p AS (SELECT page_id,
        coalesce(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(substr(rest, length(host) + 1), '^[^?#]*'), '') AS path FROM h),
rules(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
        ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule AS rule, coalesce(m.action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
}
