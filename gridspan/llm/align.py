"""Alignment of the tokens of two tokenizers over the same bytes.

A byte-level BPE (A) reads space + text, a piece tokenizer (B) reads the text
and puts a space in front. Places where tokens of both end cut the bytes into
groups; every A token of a group is linked with every B token of it. The count
of a pair of ids is the number of documents in which it is linked somewhere.

A task takes its documents in packs. Both tokenizers end a token before a space
that follows something other than white space, so a text falls apart there into
units that are tokenized on their own, and a pack's distinct units only once.
DuckDB, inside the task, holds the units' tokens as two tables of intervals on
one axis of bytes: equal ends are the cuts, an ASOF join puts A's tokens and a
range join (by blocks of 32 bytes, so that it is linear) B's tokens into their
groups, window sums number the groups, and a join by group gives the linked pairs with their multiplicities. (Ids are counted
in each group before that join, so a long group costs its distinct ids.) It also
counts the documents of the pack for each pair. Spark adds up the packs' counts,
finds the highest count of each A id, and joins both back to the packs' pairs;
then a pack's documents add up what their units have. What is shuffled are a
pack's distinct pairs and its documents' unit numbers, never texts or links.

Defined results: null and empty texts, and texts whose A or B tokens do not
spell space + text byte by byte (those with U+2581, which B takes for a space),
have zeros, no groups and an empty digest. Strings of special tokens are plain
text. Every row is a document, also if it repeats an id or a text; ids are only
carried and may be null. Other columns are not read. Empty tables give none.
"""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .bpe import byte_alphabet
from .common import table, written
from .packing import pack, unpack

#: Bytes of text in a pack, and in a slice of it that is worked on at once.
PACK_BYTES = 24 << 20
SLICE_BYTES = 1 << 20
#: Documents of a pack that are summed up at once.
ROWS = 1024
_DOC, _PAIRS = 0, 1
_STORED = "kind int, pack long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, a array<int>, b array<int>, docs array<int>, links binary"
_CUTS_SQL = """
CREATE OR REPLACE TEMP TABLE cuts AS
    SELECT e, lag(e, 1, 0) OVER (ORDER BY e) AS s, CAST(sum(1) OVER (ORDER BY e) AS BIGINT) - 1 AS g
    FROM (SELECT ta.e FROM ta JOIN tb ON ta.e = tb.e)
"""
_GROUP_A_SQL = "CREATE OR REPLACE TEMP TABLE ga AS SELECT ta.k, ta.id, cuts.g FROM ta ASOF JOIN cuts ON ta.e <= cuts.e"
_GROUP_B_SQL = """
CREATE OR REPLACE TEMP TABLE gb AS
    SELECT tb.k, tb.id, c.g FROM tb JOIN (SELECT g, s, e, unnest(range((s + 1) >> 5, (e >> 5) + 1)) AS block FROM cuts) c
    ON tb.e >> 5 = c.block AND tb.e > c.s AND tb.e <= c.e
"""
_PAIRS_SQL = "SELECT g, ga.id AS a, gb.id AS b, CAST(1 AS BIGINT) AS n FROM ga JOIN gb USING (g)"
_COUNTED_PAIRS_SQL = """
SELECT g, ca.id AS a, cb.id AS b, ca.n * cb.n AS n FROM (SELECT g, id, count(*) AS n FROM ga GROUP BY g, id) ca
JOIN (SELECT g, id, count(*) AS n FROM gb GROUP BY g, id) cb USING (g)
"""
#: Links of a group from which on its ids are counted before they are joined.
MANY_LINKS = 4096


class Aligner:
    """Both tokenizers and a DuckDB connection of a worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.splits = not any(x == "▁" and y != "▁" for p in pieces for y, x in zip(p, p[1:]))
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "300MB", "temp_directory": ""})

    def tokens(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """(A ids, B ids, whether both spell the unit) of each unit; each begins with the space."""
        texts = [u.decode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        b = [x if len(u) > 1 else [self.space] for x, u in zip(b, units)]
        size = np.array([len(u) for u in units])
        good = np.ones(len(units), bool)
        for ids, length, spelt in ((a, self.len_a, self.flat_a), (b, self.len_b, self.flat_b)):
            flat, n = _flat(ids)
            good &= T.sums(length[flat], np.concatenate([[0], np.cumsum(n)])) == size
            keep = np.repeat(good, n)
            want = np.frombuffer(b"".join([u for u, ok in zip(units, good.tolist()) if ok]), np.uint8)
            wrong = np.flatnonzero(T.segments(spelt, length, flat[keep])[0] != want)
            good[np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), wrong, side="right")]] = False
        return a, b, good

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where units begin, and the end of the data; every document begins with a space."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if self.splits:
            at = np.flatnonzero(data == 0x20)
            at = at[at >= 3]
            at = at[~_white(data, at - 1)]
            cut[at] = True
        return np.flatnonzero(cut)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after the other, how many each list has)."""
    n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(n.sum())), n


def _joined(strings: pa.Array, counts: np.ndarray, by: str) -> pa.Array:
    """Runs of strings, each joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), strings), by)


def _white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space, as the tokenizer's pattern has it, ends at these places."""
    x, y, z = data[at], data[at - 1], data[at - 2]
    found = (x == 0x20) | ((x >= 0x09) & (x <= 0x0D)) | ((x >= 0x1C) & (x <= 0x1F))
    found |= (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
    found |= (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
    found |= (z == 0xE2) & (y == 0x81) & (x == 0x9F)
    return found | ((z == 0xE1) & (y == 0x9A) & (x == 0x80)) | ((z == 0xE3) & (y == 0x80) & (x == 0x80))


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def release() -> None:
    """Give back what the tokenizers take."""
    load.cache_clear()
    gc.collect()
    T.trim()


class Pack:
    """What is known of the units and pairs of a pack."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.codes: dict[bytes, int] = {}
        self.shown: list[bytes] = []
        self.stats = [np.zeros((0, 4), np.int64)]  # tokens of A and B, groups and links of each unit
        self.bad = [np.zeros(0, bool)]
        self.pairs: dict[int, int] = {}
        self.docs = np.zeros(0, np.int64)
        self.links: list[np.ndarray] = [np.zeros((2, 0), np.int32)]  # unit, pair
        self.times: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, units: list[bytes]) -> None:
        """Tokenize, group and link new units."""
        al = self.aligner
        base = len(self.codes)
        self.codes.update(zip(units, range(base, base + len(units))))
        a, b, good = al.tokens(units)
        self.bad.append(~good)
        live = np.flatnonzero(good)
        end = np.cumsum([len(units[k]) for k in live.tolist()])
        if len(live) < len(units):
            a, b = [a[k] for k in live.tolist()], [b[k] for k in live.tolist()]
        (ids_a, _), (ids_b, _) = _flat(a), _flat(b)
        db = al.db
        ends = np.cumsum(al.len_a[ids_a])
        db.register("ta", pa.table({"k": np.arange(len(ids_a)), "id": ids_a, "e": ends}))
        db.register("tb", pa.table({"k": np.arange(len(ids_b)), "id": ids_b, "e": np.cumsum(al.len_b[ids_b])}))
        for sql in (_CUTS_SQL, _GROUP_A_SQL, _GROUP_B_SQL):
            db.execute(sql)
        cut = db.sql("SELECT e FROM cuts ORDER BY g").to_arrow_table()["e"].to_numpy()
        group_a, group_b = (db.sql(f"SELECT g FROM {x} ORDER BY k").to_arrow_table()["g"].to_numpy() for x in ("ga", "gb"))
        n_a, n_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        linked = db.sql(_PAIRS_SQL if (n_a * n_b).max(initial=0) < MANY_LINKS else _COUNTED_PAIRS_SQL).to_arrow_table()
        db.unregister("ta")
        db.unregister("tb")
        of = np.searchsorted(end, cut, side="left")  # the unit in which a group ends
        first = np.searchsorted(of, np.arange(len(live) + 1))
        stats = np.zeros((len(units), 4), np.int64)
        stats[live] = np.stack([T.sums(n_a, first), T.sums(n_b, first), np.diff(first), T.sums(n_a * n_b, first)], axis=1)
        self.stats.append(stats)
        sides = [_joined(pa.array(ids).cast(pa.string()), n, ",") for ids, n in ((ids_a, n_a), (ids_b, n_b))]
        strings = _joined(pc.binary_join_element_wise(*sides, "|"), np.diff(first), ";").cast(pa.binary()).to_pylist()
        if len(live) < len(units):
            own = dict(zip(live.tolist(), strings))
            strings = [own.get(k, b"") for k in range(len(units))]
        self.shown += strings
        unit = live[of[linked["g"].to_numpy()]] + base
        keys, code = np.unique(linked["a"].to_numpy().astype(np.int64) << 32 | linked["b"].to_numpy(), return_inverse=True)
        known = self.pairs
        pair = np.array([known.setdefault(x, len(known)) for x in keys.tolist()], dtype=np.int64)[code]
        both, at = np.unique(unit << 32 | pair, return_inverse=True)  # a unit may hold a pair in several groups
        times = np.zeros(len(both), np.int64)
        np.add.at(times, at, linked["n"].to_numpy())
        self.links.append(np.stack([both >> 32, both & 0xFFFFFFFF]).astype(np.int32))
        self.times.append(times)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(sums of each document, digests, units, times, units of each document) of documents that begin with a space each."""
        al, n_docs = self.aligner, len(offsets) - 1
        bounds = al.bounds(data, offsets)
        codes, first = T.distinct_spans(data, bounds)
        raw = data.tobytes()
        units = [raw[lo:hi] for lo, hi in zip(bounds[first].tolist(), bounds[first + 1].tolist())]
        new = [u for u in units if u not in self.codes]
        if new:
            self.add(new)
        self.stats, self.bad = [np.concatenate(self.stats)], [np.concatenate(self.bad)]
        self.links = [np.concatenate(self.links, axis=1)]
        known = self.codes
        unit = np.array([known[u] for u in units], dtype=np.int64)[codes]
        per_doc = np.searchsorted(bounds, offsets)
        doc = np.repeat(np.arange(n_docs), np.diff(per_doc))
        bad = np.bincount(doc, weights=self.bad[0][unit], minlength=n_docs) > 0
        bad |= np.diff(offsets) <= 1
        sums = np.stack([T.sums(self.stats[0][unit, k], per_doc) for k in range(4)], axis=1)
        sums[bad] = 0
        shown, at = self.shown, unit.tolist()
        digests = ["" if x else hashlib.sha256(b";".join([shown[k] for k in at[lo:hi]])).hexdigest() for x, lo, hi in zip(bad.tolist(), per_doc.tolist(), per_doc[1:].tolist())]
        keep = ~bad[doc]
        held, times = np.unique(doc[keep] << 32 | unit[keep], return_counts=True)
        doc, unit = held >> 32, held & 0xFFFFFFFF
        self._count(doc, unit)
        return sums, digests, unit, times, np.bincount(doc, minlength=n_docs)

    def _count(self, doc: np.ndarray, unit: np.ndarray) -> None:
        """Add the documents of a slice to the counts of its pairs."""
        db, links = self.aligner.db, self.links[0]
        db.register("held", pa.table({"doc": doc, "unit": unit}))
        db.register("links", pa.table({"unit": links[0], "pair": links[1]}))
        got = db.sql("SELECT pair, count(*) AS n FROM (SELECT DISTINCT held.doc, links.pair FROM held JOIN links ON held.unit = links.unit) GROUP BY pair").to_arrow_table()
        db.unregister("held")
        db.unregister("links")
        self.docs = np.concatenate([self.docs, np.zeros(len(self.pairs) - len(self.docs), np.int64)])
        self.docs[got["pair"].to_numpy()] += got["n"].to_numpy()


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a space in front of each."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 0x20, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    return out, offsets + np.arange(n + 1)


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values.astype(np.int32)))


def _bundles(units: np.ndarray, times: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each document's units, which ascend, and how often it has them, as a small buffer; empty where it has none."""
    ends = np.concatenate([[0], np.cumsum(n)]).tolist()
    return [pack([np.diff(units[lo:hi], prepend=0), times[lo:hi]]) if hi > lo else b"" for lo, hi in zip(ends, ends[1:])]


def _packed(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document with its own sums and its units, and one for each pack with its pairs."""
    names = [x.strip().split(" ")[0] for x in _STORED.split(", ")]
    kind = docs.schema["id"].dataType

    def rows(n: int, id_type: pa.DataType, **given) -> pa.RecordBatch:
        ints = pa.list_(pa.int32())
        types = {"kind": pa.int32(), "id": id_type, "groups_sha256": pa.string(), "units": pa.binary(), "links": pa.binary(), **dict.fromkeys(("a", "b", "docs"), ints)}
        return pa.record_batch([given[x] if x in given else pa.nulls(n, types.get(x, pa.int64())) for x in names], names=names)

    def close(held: Pack, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        key = np.fromiter(held.pairs, dtype=np.int64, count=len(held.pairs))
        whole = lambda x: _list(x, [len(x)])
        unit, pair = np.concatenate(held.links, axis=1)
        times = np.concatenate(held.times)
        return rows(1, id_type, kind=pa.array([_PAIRS], pa.int32()), pack=pa.array([number]), a=whole(key >> 32), b=whole(key & 0xFFFFFFFF), docs=whole(held.docs), links=pa.array([pack([np.diff(unit, prepend=0), pair, times])], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b)
        number, now, held = TaskContext.get().partitionId() << 24, None, 0
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo, hi, data, offsets in T.chunks(batch, size=SLICE_BYTES):
                now = now or Pack(aligner)
                sums, digests, units, times, n = now.slice(*_spaced(data, offsets))
                yield rows(
                    hi - lo, id_type, kind=pa.array(np.full(hi - lo, _DOC), pa.int32()), pack=pa.array(np.full(hi - lo, number)), id=batch.column(0).slice(lo, hi - lo),
                    n_a=pa.array(sums[:, 0]), n_b=pa.array(sums[:, 1]), n_groups=pa.array(sums[:, 2]), n_links=pa.array(sums[:, 3]),
                    groups_sha256=pa.array(digests, pa.string()), units=pa.array(_bundles(units, times, n), pa.binary()),
                )
                held += len(data)
                T.trim()
                if held >= PACK_BYTES:
                    yield close(now, number, id_type)
                    number, now, held = number + 1, None, 0
        if now is not None:
            yield close(now, number, id_type)
        now = aligner = None
        release()  # the stages that follow need no tokenizers, and their workers are these

    return docs.mapInArrow(run, _STORED.format(id=kind.simpleString()))


def _totals(answers: pa.Table, stored: pa.Table) -> pa.Table:
    """The documents of a pack with what their units' links have together, some rows at a time."""
    unit, pair, times = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    for b in stored.to_batches():
        row = pc.index(b.column("kind"), _PAIRS).as_py()
        if row >= 0:
            unit, pair, times = unpack(b.column("links")[row].as_py())
            unit = np.cumsum(unit)
    at = answers["pos"].to_numpy()
    n = max(int(pair.max(initial=-1)), int(at.max(initial=-1))) + 1
    per_unit = np.zeros((int(unit.max(initial=-1)) + 1, 2), np.int64)
    for k, name in enumerate(("best", "count")):
        x = np.zeros(n, np.int64)
        x[at] = answers[name].to_numpy()
        np.add.at(per_unit[:, k], unit, times * x[pair])
    out, own = [], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    for b in stored.to_batches(max_chunksize=ROWS):
        docs = b.select([*own, "units"]).filter(pc.equal(b.column("kind"), _DOC))
        sums = np.zeros((docs.num_rows, 2), np.int64)
        for row, bundle in enumerate(docs.column("units").to_pylist()):
            if bundle:
                steps, repeats = unpack(bundle)
                sums[row] = (per_unit[np.cumsum(steps)] * repeats[:, None]).sum(axis=0)
        out.append(pa.record_batch([*(docs.column(x) for x in own), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[*own, "n_best", "count_sum"]))
    T.trim()
    return pa.Table.from_batches(out)


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): (id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row, and (a, b, count, best) of every linked pair of ids."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stored = written(_packed(docs, path_a, path_b), "packs")
    packs = stored.filter(F.col("kind") == _PAIRS)
    each = packs.select("pack", F.posexplode(F.arrays_zip("a", "b", "docs"))).select("pack", "pos", "col.*")
    pairs = each.groupBy("a", "b").agg(F.sum("docs").cast("long").alias("count"))
    pairs = written(pairs, "pairs")
    highest = pairs.groupBy("a").agg(F.max("count").alias("highest"))
    pairs = pairs.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = each.drop("docs").join(pairs, ["a", "b"]).select(F.col("pack").alias("of_pack"), "pos", "count", "best")
    held = stored.select("kind", "pack", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units", "links")
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = answers.groupBy("of_pack").cogroup(held.groupBy("pack")).applyInArrow(_totals, schema)
    return out.withColumnRenamed("id", id_col), pairs


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = align(table(spark, sf_dir, "documents"), *default_vocabularies())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
