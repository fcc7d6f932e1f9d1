"""Ranked lexical search over documents that recursive graph bisection has put in order.

Terms are words without ASCII punctuation, A-Z lower-cased. Scores are whole
numbers: the sum over an item's distinct terms of a weight by document
frequency times a saturated term frequency (``_weight``, ``_impacts``).

The index holds what the items can ask for, and of it everything: every
occurrence of an item's term in every whole text, and every document's length.
A task takes its documents in packs. Documents and terms of a pack form a graph,
which is bisected again and again: halves swap the documents with the highest
gains until no swap makes the gaps between a term's documents cheaper, so that
documents with the same terms come to stand together. Pieces of at most
``LEAF`` documents are the clusters, and postings are stored by cluster and term.

A search opens a pack and bounds each of its clusters for each item by the sum
of the item's terms' highest scores in the cluster. Clusters are visited from
the highest bound on, until no bound reaches the k-th score known: nothing
beyond can be among the best, so the result is exact. A first pass over the
packs visits the foremost cluster of each item only; the k-th best scores of
all packs together are the scores to reach in the second pass. Places in the
new order are mapped back to ids, which decide between equal scores.

Items are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, so
what is sent does not grow with their number, and the documents are scanned
once for each block. What tasks return are k rows of an item and pack at most,
of which Spark keeps the k best before it shuffles them.

Defined results: null texts and texts without terms are no documents of the
count and are not found; items without terms find nothing. Every row is a
document, also if it repeats an id; equal scores of equal ids have ranks of
their own. Null ids stand last among equal scores. Every row of items is an
item. Other columns are not read; an empty table finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import forget, table, written
from .decontaminate import normal_words
from .packing import pack, unpack

#: Documents of a cluster at most.
LEAF = 96
#: Rounds of swaps of a bisection at most; they end earlier when no swap gains.
ROUNDS = 12
#: Bytes of text in a pack, and in a slice of it that is worked on at once.
PACK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Bytes of the items of a block.
BLOCK_BYTES = 4 << 20
TOP = 10


class Items:
    """The terms of a block of items."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        w = normal_words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        self.ids, self.words = ids, w
        codes = w.array().dictionary_encode().indices.to_numpy().astype(np.int64)
        self.n_terms = int(codes.max(initial=-1)) + 1
        first = np.full(self.n_terms, len(codes), dtype=np.int64)
        np.minimum.at(first, codes, np.arange(len(codes)))
        h = w.hashes()[first]
        order = np.argsort(h, kind="stable")
        self.hashes, self.place, self.term = h[order], first[order], order
        both = np.unique(w.doc * max(self.n_terms, 1) + codes)
        item, term = both // max(self.n_terms, 1), both % max(self.n_terms, 1)
        self.item_terms, self.item_first = term, np.searchsorted(item, np.arange(len(texts) + 1))
        by_term = np.argsort(term, kind="stable")
        self.term_items, self.term_first = item[by_term], np.searchsorted(term[by_term], np.arange(self.n_terms + 1))
        self.weights = np.zeros(self.n_terms, np.int64)
        self.n_docs = self.n_all = 0
        self.reach = np.ones(len(texts), np.int64)  # the score that a document must have

    def postings(self, w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the items' terms in a slice, by document and term."""
        if not self.n_terms or not len(w.starts):
            return (np.zeros(0, np.int64),) * 3
        h = w.hashes()
        at = np.searchsorted(self.hashes, h)
        word = np.flatnonzero(self.hashes[np.minimum(at, self.n_terms - 1)] == h)
        doc, codes, kept = w.doc, [], []
        while len(word):  # equal hashes stand side by side; the bytes decide
            at_word = at[word]
            same = w.equal(word, self.words, self.place[at_word])
            codes.append(self.term[at_word[same]])
            kept.append(doc[word[same]])
            word = word[~same]
            at[word] += 1
            word = word[at[word] < self.n_terms]
            word = word[self.hashes[at[word]] == h[word]]
        if not codes:
            return (np.zeros(0, np.int64),) * 3
        key, n = np.unique(np.concatenate(kept) * self.n_terms + np.concatenate(codes), return_counts=True)
        return key // self.n_terms, key % self.n_terms, n


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(items: Items, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """What each posting adds to its document's score."""
    whole = n.astype(np.int64)
    if 90 * int(n.max(initial=0)) * items.n_docs >= 1 << 63:
        whole = n.astype(object)  # beyond 64 bits
    m = (10 + 90 * whole * items.n_docs // max(items.n_all, 1)).astype(np.int64)
    tf = tf.astype(np.int64)
    return items.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


def _gap_cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    return degree * np.log2(size / (degree + 1.0))


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, leaf: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order of the documents, first places of the clusters and the end), by recursive bisection of all parts of a level at once."""
    leaf = leaf or LEAF
    order, bounds = np.arange(n_docs), np.array([0, n_docs])
    while n_docs and np.diff(bounds).max() > leaf:
        sizes = np.diff(bounds)
        mids = bounds[:-1] + (sizes + 1) // 2
        part_at = np.repeat(np.arange(len(sizes)), sizes)
        part = np.empty(n_docs, np.int64)
        part[order] = part_at
        side = np.empty(n_docs, bool)
        side[order] = np.arange(n_docs) >= mids[part_at]
        key, edge = np.unique(part[doc] << 32 | term, return_inverse=True)
        of = key >> 32
        n1, n2 = (mids - bounds[:-1])[of], np.maximum((bounds[1:] - mids)[of], 1)
        for _ in range(ROUNDS):
            right = np.bincount(edge, weights=side[doc], minlength=len(key))
            left = np.bincount(edge, minlength=len(key)) - right
            now = _gap_cost(left, n1) + _gap_cost(right, n2)
            to_right = now - _gap_cost(np.maximum(left - 1, 0), n1) - _gap_cost(right + 1, n2)
            to_left = now - _gap_cost(left + 1, n1) - _gap_cost(np.maximum(right - 1, 0), n2)
            gain = np.bincount(doc, weights=np.where(side[doc], to_left[edge], to_right[edge]), minlength=n_docs)
            ranked = np.lexsort((-gain, side, part))  # as the places: each part's left half, then its right half
            over = np.flatnonzero(np.arange(n_docs) >= mids[part_at])
            partner = bounds[part_at[over]] + over - mids[part_at[over]]
            swap = gain[ranked[over]] + gain[ranked[partner]] > 1e-9
            if not swap.any():
                break
            side[ranked[over[swap]]] = False
            side[ranked[partner[swap]]] = True
        order = np.lexsort((np.arange(n_docs), side, part))
        bounds = np.unique(np.concatenate([bounds, mids]))
    return order, bounds


def _index(docs: DataFrame, sent) -> DataFrame:
    """A row for each pack: its counts, its ids in the new order and its postings."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["pack", "n_docs", "n_all", "terms", "df", "ids", "postings"]

    def close(number: int, items: Items, ids: list[pa.Array], lengths: list[np.ndarray], found: list[tuple]) -> pa.RecordBatch:
        n = np.concatenate(lengths)
        doc, term, tf = (np.concatenate(x) for x in zip(*found))
        order, bounds = bisect(doc, term, len(n))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        doc = place[doc]
        cluster = np.searchsorted(bounds, doc, side="right") - 1
        by = np.lexsort((doc, term, cluster))
        doc, term, tf, cluster = doc[by], term[by], tf[by], cluster[by]
        new = np.ones(len(by), bool)
        new[1:] = (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])
        runs = np.flatnonzero(new)
        data = pack([n[order], np.diff(bounds), cluster[runs], term[runs], np.diff(runs, append=len(by)), doc - bounds[cluster], tf])
        df = np.bincount(term, minlength=items.n_terms)
        some = np.flatnonzero(df)
        column = pa.concat_arrays(ids).take(pa.array(order))
        lists = pa.ListArray.from_arrays if not pa.types.is_large_string(column.type) else pa.LargeListArray.from_arrays
        return pa.record_batch([pa.array([number]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.array([some], pa.list_(pa.int64())), pa.array([df[some]], pa.list_(pa.int64())), lists(pa.array([0, len(column)], pa.int32()), column), pa.array([data], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, number, held = sent.value, TaskContext.get().partitionId() << 24, 0
        ids, lengths, found, n_docs = [], [], [], 0
        for b in batches:
            for lo, hi, data, offsets in T.chunks(b, size=SLICE_BYTES):
                w = normal_words(data, offsets)
                doc, term, tf = items.postings(w)
                ids.append(b.column(0).slice(lo, hi - lo))
                lengths.append(w.n_words)
                found.append(((doc + n_docs).astype(np.int32), term.astype(np.int32), tf.astype(np.int32)))
                n_docs, held = n_docs + hi - lo, held + len(data)
                if held >= PACK_BYTES:
                    yield close(number, items, ids, lengths, found)
                    ids, lengths, found, n_docs, held, number = [], [], [], 0, 0, number + 1
        if n_docs:
            yield close(number, items, ids, lengths, found)
        T.trim()

    return docs.mapInArrow(run, f"pack long, n_docs long, n_all long, terms array<long>, df array<long>, ids array<{kind}>, postings binary")


class Pack:
    """An opened pack: impacts by cluster and term, and each cluster's bounds."""

    def __init__(self, data: bytes, items: Items):
        n, sizes, cluster, term, counts, doc, tf = unpack(data)
        self.items, self.n_docs = items, len(n)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.doc = doc + np.repeat(bounds[cluster], counts)
        self.impact = _impacts(items, n, self.doc, np.repeat(term, counts), tf)
        self.key = cluster.astype(np.int64) * max(items.n_terms, 1) + term
        high = np.maximum.reduceat(self.impact, self.first[:-1]) if len(counts) else np.zeros(0, np.int64)
        n_items = len(items.ids)
        asked = np.diff(items.term_first)[term]
        at = np.repeat(items.term_first[term] - (np.cumsum(asked) - asked), asked) + np.arange(int(asked.sum()))
        cell = items.term_items[at] * len(sizes) + np.repeat(cluster.astype(np.int64), asked)
        # sums of whole numbers far below 2**53
        self.bounds = np.bincount(cell, weights=np.repeat(high, asked), minlength=n_items * len(sizes)).astype(np.int64).reshape(n_items, len(sizes))

    def visit(self, item: int, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the clusters' documents that have a term of the item."""
        items = self.items
        terms = items.item_terms[items.item_first[item] : items.item_first[item + 1]]
        want = (clusters[:, None] * items.n_terms + terms).ravel()
        run = np.searchsorted(self.key, want)
        run = run[self.key[np.minimum(run, len(self.key) - 1)] == want]
        n = self.first[run + 1] - self.first[run]
        at = np.repeat(self.first[run] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        score = np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n_docs)
        place = np.flatnonzero(score)
        return place, score[place].astype(np.int64)

    def best(self, item: int, rank: np.ndarray, k: int, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the item's k best documents here that reach the score asked for; ``rank`` orders equal scores."""
        bound, reach = self.bounds[item], max(int(self.items.reach[item]), 1)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], -reach, side="right")]
        places, scores, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 1
        while done < len(order) and bound[order[done]] >= reach:
            p, s = self.visit(item, order[done : done + step])
            ok = s >= reach
            places, scores = np.concatenate([places, p[ok]]), np.concatenate([scores, s[ok]])
            if len(places) > k:
                top = np.lexsort((rank[places], -scores))[:k]
                places, scores = places[top], scores[top]
            if len(places) == k:
                reach = max(reach, int(scores.min()))
            done, step = done + step, step * 2
            if first_only:
                break
        return places, scores


def _searched(index: DataFrame, sent, k: int, first_only: bool, id_kind: str) -> DataFrame:
    """(item, id, score): the best documents of each item in each pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column(0).slice(row, 1).flatten()
                opened = Pack(b.column(1)[row].as_py(), items)
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                item, place, score = [], [], []
                for i in range(len(items.ids)):
                    p, s = opened.best(i, rank, k, first_only)
                    if len(p):
                        item.append(np.full(len(p), i))
                        place.append(p)
                        score.append(s)
                if item:
                    yield pa.record_batch([pa.array(np.concatenate(item).astype(np.int32)), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score))], names=["item", "id", "score"])
        T.trim()

    return index.select("ids", "postings").mapInArrow(run, f"item int, id {id_kind}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _block(docs: DataFrame, items: Items, k: int, item_kind) -> DataFrame:
    """Written (item_id, rank, id, score) of a block of items."""
    sc, id_kind = docs.sparkSession.sparkContext, docs.schema["id"].dataType.simpleString()
    sent = sc.broadcast(items)
    index = written(_index(docs, sent), "index")
    sent.destroy()
    counts = index.agg(F.sum("n_docs").alias("n"), F.sum("n_all").alias("l")).first()
    items.n_docs, items.n_all = counts["n"] or 0, counts["l"] or 0
    # a row for each term of the block's items
    for r in index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).toLocalIterator():
        items.weights[r["terms"]] = _weight(items.n_docs, r["df"])
    sent = sc.broadcast(items)
    near = _top(_searched(index, sent, k, True, id_kind), k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reach"))
    for r in near.filter(F.col("n") == k).collect():
        items.reach[r["item"]] = r["reach"]
    sent.destroy()
    sent = sc.broadcast(items)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {item_kind.simpleString()}")
    out = written(_top(_searched(index, sent, k, False, id_kind), k).join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"), "ranked")
    sent.destroy()
    forget(index)
    return out


def search(df: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, id, score): the ``k`` best documents of each item."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.filter(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    kind, out = asked.schema["item_id"].dataType, None
    for k_block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k_block).collect()
        part = _block(docs, Items([r["item_id"] for r in rows], [r["text"] for r in rows]), k, kind)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op13_lexical_search": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS row, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, item_id, unnest(w) AS term FROM i),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
s AS (SELECT q.item, any_value(q.item_id) AS item_id, p.row, any_value(d.doc_id) AS doc_id, CAST(sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * d.n * z.nn) // z.l)))) AS BIGINT) AS score
      FROM q JOIN p ON p.term = q.term JOIN f ON f.term = q.term JOIN d ON d.row = p.row, z GROUP BY q.item, p.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
}
