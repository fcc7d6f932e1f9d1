"""Exact top-k inner products over norm-sorted vectors.

Components become integers ``floor(scale * x)``. One pass sums the Gram matrix
of the integer vectors; its eigenvectors are the right singular vectors of the
table and rotate every vector so that the first coordinates carry most of the
length. The vectors are dealt in ranges of their length and sorted by it, once,
so that a task processes a band of lengths in descending order. Per block and
query it adds the partial sum over the leading rotated coordinates to the
Cauchy-Schwarz bound on the rest (product of the residual lengths) and
multiplies out only pairs whose bound reaches the query's k-th best score so
far; a whole block, and all that follow it, are left out once
``|q| * max |x|`` falls below it. Bounds carry slack for rounding. Scores that
decide are exact: where lengths rule out sums beyond 2 ** 53 they are sums of
doubles, else of 64-bit integers, which are exact modulo 2 ** 64 and so for
every score within a long; a score beyond it is an error.

Queries are taken in blocks of ``QUERY_BLOCK``, so what is sent to the tasks at
once does not grow with their number; with several blocks each one's result is
written before the next is sent. Every task returns at most k rows for each
query of a block; a grouped window keeps the k best.

Defined results: vectors that are null or hold a null or a non-finite component
take no part, nor do rows with a null id. Vectors of different lengths are
multiplied as if the shorter one went on with zeros. A row is never a candidate
of its own id, so repeated rows of one id do not find each other; as candidates
of others they count once, with their best score, and of a repeated query id
the greatest vector counts. Equal scores go to the smaller id. A table without
valid vectors gives no rows. Other columns are not read, except by ``is_query``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

QUERY_BLOCK = 16384
CANDIDATE_BLOCK = 1024
LEAD = 16


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, is_query: Column) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, query) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width``, filled up with zeros."""
    n = col.value_lengths().to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width))
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, largest first; each task returns one small matrix."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), width)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "g"])

    rows = vectors.select("v").mapInArrow(gram, "k long, g double").groupBy("k").agg(F.sum("g").alias("g")).orderBy("k").collect()
    g = np.array([r["g"] for r in rows]).reshape(width, width)
    _, vec = np.linalg.eigh(g / max(1.0, np.abs(g).max(initial=0)))
    return vec[:, ::-1].copy()


def _scores(x: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if small:
        return (x @ q).astype(np.int64)
    about = x @ q
    if (np.abs(about) >= 2.0**63).any() or (np.abs(x) >= 2.0**63).any() or (np.abs(q) >= 2.0**63).any():
        raise ValueError("a component or an inner product is beyond a long")
    with np.errstate(over="ignore"):
        return x.astype(np.int64) @ q.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: score descending, then id."""
    return np.lexsort((ids, -scores))[:k]


def _best_rows(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of one row for each id: its best."""
    by = np.lexsort((-scores, ids))
    return by[np.concatenate([[True], ids[by][1:] != ids[by][:-1]])]


def search_block(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rot: np.ndarray, k: int, state: dict) -> None:
    """Fold the vectors ``x`` into ``state[i] = (ids, scores)`` of each query i."""
    order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")
    ids, x = ids[order], x[order]
    lead = min(LEAD, x.shape[1])
    qr, xr = q @ rot, x @ rot
    q_norm, x_norm = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    q_rest, x_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(xr[:, lead:], axis=1)
    floor = np.array([state[i][1][-1] if i in state and len(state[i][1]) == k else -np.inf for i in range(len(q))])
    for lo in range(0, len(x), CANDIDATE_BLOCK):
        hi = lo + CANDIDATE_BLOCK
        slack = 1e-9 * q_norm * x_norm[lo] + 1e-6
        live = np.flatnonzero(q_norm * x_norm[lo] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :lead] @ xr[lo:hi, :lead].T
        bound += q_rest[live, None] * x_rest[None, lo:hi] + slack[live, None]
        repeats = len(np.unique(ids[lo:hi])) < len(ids[lo:hi])
        for row, i in enumerate(live):
            near = np.flatnonzero(bound[row] >= floor[i])
            near = near[ids[lo:hi][near] != qid[i]]
            if not len(near):
                continue
            s = _scores(x[lo:hi][near], q[i], q_norm[i] * x_norm[lo] < 2.0**52)
            if repeats:  # before the cut, where copies would take the places of other ids
                one = _best_rows(ids[lo:hi][near], s)
                near, s = near[one], s[one]
            if len(near) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                near, s = near[s >= least], s[s >= least]
            have = state.get(i, (ids[:0], s[:0]))
            both, score = np.concatenate([have[0], ids[lo:hi][near]]), np.concatenate([have[1], s])
            if len(np.unique(both)) < len(both):  # an id of an earlier block
                one = _best_rows(both, score)
                both, score = both[one], score[one]
            at = _best(both, score, k)
            state[i] = (both[at], score[at])
            if len(at) == k:
                floor[i] = score[at][-1]


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each row for which ``is_query`` holds."""
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vec_col, scale, is_query)
    widest = vectors.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, widest)
    rot_b = spark.sparkContext.broadcast(_rotation(vectors, width))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    banded = written(vectors.withColumn("norm", norm).repartitionByRange(tasks, F.desc("norm")).sortWithinPartitions(F.desc("norm")), "vectors")
    queries = banded.filter("query").groupBy("vec_id").agg(F.max("v").alias("v"))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for block in range(n_blocks):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        ids = got.column("vec_id").to_numpy()
        data = spark.sparkContext.broadcast((ids, _matrix(got.column("v").combine_chunks(), width) if len(ids) else np.zeros((0, width))))

        def search(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            qid, q = data.value
            state: dict = {}
            for b in batches:
                if b.num_rows:
                    search_block(qid, q, b.column(0).to_numpy(), _matrix(b.column(1), width), rot_b.value, k, state)
            if state:
                yield pa.record_batch(
                    [pa.array(np.repeat(qid[list(state)], [len(s[0]) for s in state.values()])), pa.array(np.concatenate([s[0] for s in state.values()])), pa.array(np.concatenate([s[1] for s in state.values()]))],
                    names=["query_id", "vec_id", "score"],
                )

        part = banded.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")
        if n_blocks > 1:
            part = written(part, "found")
            data.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = {
    "op9_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
