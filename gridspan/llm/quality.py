"""Quality classifier: similarity-weighted votes of labelled neighbours.

A document becomes counts of its words, hashed into 2 ** ``TERM_BITS`` terms,
of character-class pairs (what follows what: letters by case, digits, spaces,
line ends and kinds of punctuation) and of a few repetition terms (words equal
to the one before, words, lines and shingles that occurred before in the
document). Logarithms of word counts, brought to length 1, and square-rooted
frequencies of the others, weighted by inverse document frequency and centred,
are projected on the leading right singular vectors of the labelled matrix: a
latent-semantic vector. The labelled vectors
are broadcast; their number is at most ``max_labelled``, whatever the input.
Every document is compared with all of them by blocked matrix products of unit
vectors, and the ``k`` nearest vote with their label, weighted by a power of
their cosine.

Labels are learned only from documents whose fold is not 0; of more than
``max_labelled`` the ones with the smallest hash of their id are taken.

Defined results: a null or blank text has no terms; its vector is that of
the empty text and it is scored like any other. Documents with a null id are
scored, learn nothing and are not held out. Repeated label rows of an id count
with the smallest label; null labels are ignored. Ties among neighbours go to
the earlier labelled row. Without any labelled row every score is 0.5. Labels,
language, source and id are no inputs of a score; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import fold, table

FOLDS = 5
MAX_LABELLED = 4000
DIMENSIONS = 32
NEIGHBOURS = 15
POWER = 4
BLOCK = 128
#: Documents whose features are made at once, at most.
ROWS = 1024

_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\v\f", ".", ",", "!?", ":;", "|", "#$%&*", "-_~", "\"'`", "()[]{}<>", "@/\\=+^"]
_CLASS = np.full(256, len(_KINDS), dtype=np.uint8)  # control bytes
_CLASS[0x80:0xC0] = len(_KINDS) + 1  # inside a character
_CLASS[0xC0:] = len(_KINDS) + 2  # first of a longer character
for _k, _chars in enumerate(_KINDS):
    _CLASS[[ord(c) for c in _chars]] = _k
N_CLASSES = len(_KINDS) + 3
N_EXTRA = 4
N_PAIRS = N_CLASSES * N_CLASSES + N_EXTRA
#: Words are hashed into 2 ** TERM_BITS terms, whose mean weight is TERM_WEIGHT.
TERM_BITS, TERM_WEIGHT = 10, 0.5
N_TERMS = 1 << TERM_BITS
N_FEATURES = N_PAIRS + N_TERMS
#: Weight of a repetition term against a class pair.
EXTRA_WEIGHT = 2.0


def _repeated(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of a document's hashes that occurred before in it."""
    count = np.bincount(doc, minlength=n_docs)
    once = np.bincount(_distinct_docs(h, doc), minlength=n_docs)
    return (count - once) / np.maximum(count, 1)


def _distinct_docs(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The document of each distinct (document, hash)."""
    _, first = T.distinct(h + T.mix(doc.astype(np.uint64) + np.uint64(1)))
    return doc[first]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of frequencies for each document."""
    n_docs = len(offsets) - 1
    whole = np.zeros((n_docs, N_FEATURES), dtype=np.float32)
    out, terms = whole[:, :N_PAIRS], whole[:, N_PAIRS:]
    if not len(data):
        return whole
    size = np.diff(offsets)
    kind = _CLASS[data].astype(np.int64)
    doc = np.repeat(np.arange(n_docs), size)
    code = doc[:-1] * (N_CLASSES * N_CLASSES) + kind[:-1] * N_CLASSES + kind[1:]
    code = code[doc[:-1] == doc[1:]]
    pairs = np.bincount(code, minlength=n_docs * N_CLASSES * N_CLASSES).reshape(n_docs, -1)
    out[:, :-N_EXTRA] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    w = T.words_of(data, offsets)
    h, d = w.hashes(), w.doc
    if len(h):
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        out[:, -4] = np.bincount(d[same], minlength=n_docs) / np.maximum(w.n_words, 1)
        out[:, -3] = _repeated(h, d, n_docs)
        slot = (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)
        terms[:] = np.log1p(np.bincount(d * N_TERMS + slot, minlength=n_docs * N_TERMS)).reshape(n_docs, -1)
        terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1)
        at = T.window_starts(w.first, 4)
        if len(at):
            out[:, -2] = _repeated(T.shingles(h, 4)[at], d[at], n_docs)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    cut[1:][data == 0x0A] = True
    bounds = np.flatnonzero(cut)
    line_doc = np.searchsorted(offsets, bounds[:-1], side="right") - 1
    out[:, -1] = _repeated(T.distinct_spans(data, bounds)[0].astype(np.uint64), line_doc, n_docs)
    out[:, -N_EXTRA:] = np.sqrt(out[:, -N_EXTRA:])
    return whole


@dataclass
class Neighbours:
    """Projection and labelled vectors."""

    weight: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, k: int = NEIGHBOURS) -> Neighbours:
        df = (x > 0).sum(axis=0)
        weight = np.log((1 + len(x)) / (1 + df)) + 1
        weight[N_PAIRS - N_EXTRA : N_PAIRS] = EXTRA_WEIGHT
        weight[N_PAIRS:] *= TERM_WEIGHT / weight[N_PAIRS:].mean()
        z = x * weight
        mean = z.mean(axis=0)
        _, _, v = np.linalg.svd(z - mean, full_matrices=False)
        self = cls(weight.astype(np.float32), mean.astype(np.float32), v[:dimensions].T.astype(np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float32), min(k, len(x)))
        self.vectors = self.project(x)
        return self

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weight - self.mean) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest, block by block."""
        out = np.empty(len(x))
        for lo in range(0, len(x), BLOCK):
            cos = self.project(x[lo : lo + BLOCK]) @ self.vectors.T
            least = np.partition(cos, len(self.labels) - self.k, axis=1)[:, len(self.labels) - self.k, None]
            equal = cos == least
            places = self.k - (cos > least).sum(axis=1, keepdims=True)  # for those as near as the last one
            near = (cos > least) | (equal & (np.cumsum(equal, axis=1) <= places))
            w = np.where(near, np.maximum(cos, 1e-6).astype(np.float64) ** POWER, 0.0)
            out[lo : lo + BLOCK] = w @ self.labels / w.sum(axis=1)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Neighbours | None:
    """Fit on at most ``max_labelled`` labelled documents outside the held-out fold."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), FOLDS) != 0))
    known = known.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("float").alias("label"))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # two steps: the sample is drawn from ids alone, then its texts are fetched
    ids = known.join(text.select("doc_id").filter("doc_id is not null"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in T.chunks(b, most=ROWS):
                x = features(data, offsets)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = text.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").mapInArrow(run, f"doc_id {text.schema['doc_id'].dataType.simpleString()}, label float, x binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()  # a row for each id
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return Neighbours.fit(np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Neighbours | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    data = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = data.value
        for b in batches:
            for lo, hi, raw, offsets in T.chunks(b, most=ROWS):
                s = m.score(features(raw, offsets)) if m else np.full(hi - lo, 0.5)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Neighbours | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that are predicted 1, all columns as they are; without a model, all documents."""
    if model is None:
        return docs
    data = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in T.chunks(b, text_col, most=ROWS):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(data.value.score(features(raw, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
