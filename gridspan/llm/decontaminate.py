"""Benchmark decontamination by spaced-seed hashing.

Words are runs of bytes outside ASCII white space and punctuation, with A-Z
lower-cased. A window is ``SPAN`` words. The ``SPAN`` places fall into four
blocks and each of six fixed masks ignores two of them, so whichever two places
of a window are substituted, one mask ignores both: windows of a benchmark item
and of a document that differ in at most ``MISSES`` places agree in at least one
masked hash. Document windows are hashed under all masks with array arithmetic,
joined with the benchmark's hashes (a bitmap first, then binary search in the
sorted hashes), and each hit is verified word by word, on the words' bytes. Verified windows of one
document, item and alignment are merged into overlaps.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words
and the documents are scanned once for each block, so what is sent does not
grow with the benchmark. No rows are shuffled.

Defined results: items of fewer than ``SPAN`` words match where all their words
stand in a row; those of fewer than ``min_words`` are too short to tell a leak
from common speech and match nothing, nor do items without words. Null texts have no words. Rows come
only for documents with a match; repeated rows give repeated matches, repeated
items are reported each. Null ids are carried. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import table

SPAN = 13
MISSES = 2
BLOCKS = ((0, 1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12))
MASKS = [tuple(p for k, b in enumerate(BLOCKS) if k not in out for p in b) for out in combinations(range(4), 2)]
BLOCK_WORDS = 500_000
#: Words of an item at least, for it to be searched.
MIN_WORDS = 8
_ODD = [np.uint64(pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64)) for k in range(SPAN)]
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*range(0x21), *b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 0x7F]] = True


def normal_words(data: np.ndarray, offsets: np.ndarray) -> T.Words:
    """Words without punctuation, lower-cased."""
    return T.words_of(np.where(_BREAK[data], np.uint8(0x20), T.lowered(data)), offsets)


def masked(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of each window's words at the mask's places."""
    n = len(h) - SPAN + 1
    out = np.zeros(n, dtype=np.uint64)
    for p in mask:
        out += h[p : p + n] * _ODD[p]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Seeds:
    """The seeds of a block of benchmark items."""

    def __init__(self, texts: list[str], min_words: int = 1):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        w = normal_words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        self.h, self.first, self.words = w.hashes(), w.first, w
        self.n_words = w.n_words
        starts = T.window_starts(w.first, SPAN)
        self.tables = []
        for mask in MASKS if len(starts) else ():
            seed = masked(self.h, mask)[starts]
            order = np.argsort(seed, kind="stable")
            self.tables.append((mask, seed[order], starts[order]))
        self.bits = np.uint64(64 - max(16, int(len(starts) * 16).bit_length()))
        self.maps = []
        for _, seed, _ in self.tables:
            bitmap = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
            bitmap[seed >> self.bits] = True
            self.maps.append(bitmap)
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []  # (words, sorted hashes, items) of the shorter items
        for n in np.unique(self.n_words[(self.n_words >= max(min_words, 1)) & (self.n_words < SPAN)]).tolist():
            items = np.flatnonzero(self.n_words == n)
            key = T.shingles(self.h, n)[self.first[items]]
            order = np.argsort(key, kind="stable")
            self.short.append((n, key[order], items[order]))

    def hits(self, w: T.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document place, benchmark place) of verified windows."""
        at: list[np.ndarray] = []
        to: list[np.ndarray] = []
        if len(h) >= SPAN and self.tables:
            valid = np.zeros(len(h), dtype=bool)
            valid[T.window_starts(w.first, SPAN)] = True
            valid = valid[: len(h) - SPAN + 1]
            for (mask, seed, starts), bitmap in zip(self.tables, self.maps):
                x = masked(h, mask)
                near = np.flatnonzero(bitmap[x >> self.bits] & valid)
                lo, hi = np.searchsorted(seed, x[near], "left"), np.searchsorted(seed, x[near], "right")
                n = hi - lo
                total = int(n.sum())
                if total:
                    at.append(np.repeat(near, n))
                    to.append(starts[np.arange(total) + np.repeat(lo - (np.cumsum(n) - n), n)])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(at).astype(np.int64) << 32 | np.concatenate(to))
        a, b = pair >> 32, pair & 0xFFFFFFFF
        same = np.zeros(len(a), dtype=np.int64)
        for p in range(SPAN):
            same += w.equal(a + p, self.words, b + p)
        ok = same >= SPAN - MISSES
        return a[ok], b[ok]

    def overlaps(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item, first word, end word, item's first word, equal words) of merged overlaps."""
        w = normal_words(data, offsets)
        h = w.hashes()
        a, b = self.hits(w, h)
        doc = np.searchsorted(w.first, a, side="right") - 1
        item = np.searchsorted(self.first, b, side="right") - 1
        out = []
        order = np.lexsort((a, a - b, item, doc))
        a, b, doc, item = a[order], b[order], doc[order], item[order]
        new = np.ones(len(a), dtype=bool)
        if len(a):
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((a - b)[1:] != (a - b)[:-1]) | (a[1:] > a[:-1] + SPAN)
        begin = np.flatnonzero(new)
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(a)]):
            s, e, shift = int(a[lo]), int(a[hi - 1]) + SPAN, int(b[lo] - a[lo])
            equal = int(w.equal(np.arange(s, e), self.words, np.arange(s + shift, e + shift)).sum())
            d, i = int(doc[lo]), int(item[lo])
            out.append((d, i, s - int(w.first[d]), e - int(w.first[d]), s + shift - int(self.first[i]), equal))
        for n, key, items in self.short:  # a length at a time, whatever the number of items
            at = T.window_starts(w.first, n)
            x = T.shingles(h, n)[at]
            lo, hi = np.searchsorted(key, x, "left"), np.searchsorted(key, x, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                s = int(at[k])
                d = int(np.searchsorted(w.first, s, side="right")) - 1
                for i in items[lo[k] : hi[k]].tolist():
                    if w.equal(np.arange(s, s + n), self.words, np.arange(self.first[i], self.first[i] + n)).all():
                        out.append((d, i, s - int(w.first[d]), s - int(w.first[d]) + n, 0, n))
        return out


SCHEMA = "start_word int, end_word int, item_start_word int, equal_words int, item_words int"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Overlaps of documents with benchmark items: (id, item id, word spans, equal words, words of the item)."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    words = items.agg(F.sum(F.octet_length("text") / 2).alias("n")).first()["n"] or 0
    n_blocks = max(1, int(-(-words // BLOCK_WORDS)))
    item_type = items.schema["item_id"].dataType
    doc_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {doc_type}, `{item_col}` {item_type.simpleString()}, {SCHEMA}"
    text = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    found = None
    for block in range(n_blocks):
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        data = spark.sparkContext.broadcast(([r["item_id"] for r in got], Seeds([r["text"] for r in got], min_words)))

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            ids, seeds = data.value
            kinds = None
            for b in batches:
                rows = []
                for lo, _, raw, offsets in T.chunks(b):
                    rows += [(lo + d, ids[i], s, e, j, n, int(seeds.n_words[i])) for d, i, s, e, j, n in seeds.overlaps(raw, offsets)]
                kinds = [b.schema.field(0).type, None, *[pa.int32()] * 5]
                if rows:
                    cols = list(zip(*rows))
                    first = b.column(0).take(pa.array(cols[0]))
                    yield pa.record_batch([first, *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:]))], names=[id_col, item_col, *(x.split(" ")[0] for x in SCHEMA.split(", "))])

        part = text.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
