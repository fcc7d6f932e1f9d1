"""N-gram Jaccard join by token-combination prefixes.

A document is the set of hashes of its ``WORDS``-word shingles, ordered by how
often they occur, rare ones first: a first pass counts all shingles of all
texts in a table of slots, whose size follows the number of shingles up to
2 ** MAX_SLOT_BITS bytes. What falls into one slot by chance costs time, never a
pair, as the counts decide only the order and the class of a token.

Texts of Jaccard similarity ``NUM / DEN`` or more agree, in that order, on a
token early in both sets: the prefix of a set of n is its first
n - ceil(NUM n / DEN) + 1 tokens, and with prefixes longer by c they share c + 1
tokens. Tokens fall into two classes. Frequent are those in the fullest slots,
which together hold at most ``FREQUENT_SHARE`` of all occurrences and each more
than ``FREQUENT`` above twice the mean; the others are rare. As rare ones stand
first, similar sets either share a rare token of their prefixes, which is a key
itself, or share frequent tokens only. For these, prefixes are longer by c and
frequent tokens are dealt by hash into c groups: of c + 1 shared tokens two
fall into one group, so every combination of two frequent tokens of a group is
a key. c is a power of two of at least n / ``GROUPED`` for the larger set, so a
set of any size has fewer keys than tokens; sets that may be the smaller of a
pair with the next c have keys for both. Sets whose rare tokens fill their
prefix need no combinations. Equal sets meet in a key of the whole set.

*Keys.* Tasks pack the prefixes of their documents by hash bucket; of documents
with equal sets in one pack only the smallest id is packed and the others are
linked to it. A key counted more than ``HOT`` times is dealt over several
buckets by document.

*Stars.* A bucket pairs each key's documents with one of them, the key's
centre: the document whose prefix has the most frequent tokens, so of near
copies one without edits. A key with m documents gives m - 1 rows. For each
document, the centre that looks most similar is verified on the full sets of
the whole texts, and components of these links are formed.

*Cells.* A centre and the documents that ever met it are a cell; any two
documents that share a key share a cell. In cells with several components the
documents outside the main one are compared with the others, block against
block inside tasks, by parity sketches of two bits or more a token, whose
differing bits bound the number of tokens not shared from below. Documents that
may have a partner are sent on with their texts, and pairs whose ends are still
apart are verified, the likeliest first. No pair is written but those links
that join two components of a task.

So no two similar texts stay in different components, though pairs within one
are not listed, nor counted.

Defined results: a text of fewer than ``WORDS`` words is one shingle, its whole
word sequence; texts without words and null texts have no shingles and are in
no links. Rows that repeat an id count as one document with several texts: each
row has its own set size, all have one component. Null ids are returned as they
are, without links. Shingles are compared by 64-bit hashes; two texts with u
shingles in all hold a pair of different shingles of one hash with a chance
of about u ** 2 / 2 ** 65 (20,000 words: 1e-11), whatever their words are like. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import forget, table, text_bytes, written
from .components import components
from .packing import delta, pack, undelta, unpack

WORDS = 5
NUM, DEN = 3, 4
#: The class of frequent tokens: at most this share of all occurrences, in slots this much fuller than twice the mean.
FREQUENT_SHARE, FREQUENT = 1 / 16, 64
#: Tokens of a set for each group of frequent tokens, at most.
GROUPED = 8
HOT = 1 << 20
#: The table of counts has a slot for about so many shingles, and 2 ** MAX_SLOT_BITS slots of one byte at most.
SLOT_LOAD, MIN_SLOT_BITS, MAX_SLOT_BITS = 32, 16, 26
PACK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
#: Tokens of the documents of one block of a cell, and documents in it.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 20, 2048
#: Tokens of the documents that one task compares at once, by sketches and by texts.
SKETCH_TOKENS, TEXT_TOKENS = 32 << 20, 2 << 20
#: Rows of wanted documents that are broadcast at most, of 33 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 250_000
_KEYS, _COPIES, _ABOUT = 0, 1, 2  # kinds of payload
_U = np.uint64


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each document's distinct shingle hashes in ascending order, one document after the other."""
    w = T.words_of(data, offsets, lower=True)
    h, n_docs = w.hashes(), len(offsets) - 1
    at = T.window_starts(w.first, WORDS)
    g = T.shingles(h, WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n_docs), np.maximum(w.n_words - WORDS + 1, 0))
    few = np.flatnonzero((w.n_words > 0) & (w.n_words < WORDS))
    if len(few):
        own = np.array([T.shingles(h[w.first[i] : w.first[i + 1]], int(w.n_words[i]))[0] + _U(w.n_words[i]) for i in few], dtype=np.uint64)
        g, doc = np.concatenate([g, own]), np.concatenate([doc, few])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], np.bincount(doc[keep], minlength=n_docs)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Tokens of the prefix of sets of ``n``."""
    return np.minimum(n, n - -(-NUM * n // DEN) + 1)


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of frequent tokens where the larger set has ``n`` tokens: a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(n / GROUPED, 1))).astype(np.int64)


def most_apart(a, b):
    """Tokens that similar sets of sizes a and b do not share, at most."""
    return a + b - 2 * -(-NUM * (a + b) // (NUM + DEN))


# --- counts of shingles -------------------------------------------------------------------------


class Counts:
    """Counts of shingles by slot, each as a byte that grows with the logarithm of the count."""

    STEPS = 4  # bytes for each doubling

    def __init__(self, bits: int, level: np.ndarray, mean: float):
        self.bits, self.level, self.mean = bits, level, mean
        full = np.bincount(level, minlength=256) * 2.0 ** (np.arange(256) / self.STEPS)
        above = np.cumsum(full[::-1])[::-1] <= FREQUENT_SHARE * full.sum()  # levels that with all higher ones hold few occurrences
        self.frequent = max(int(np.argmax(above)) if above.any() else 256, int(self.levels(np.array([FREQUENT + 2 * mean]))[0]))

    @classmethod
    def levels(cls, count: np.ndarray) -> np.ndarray:
        return np.floor(cls.STEPS * np.log2(np.maximum(count, 1))).astype(np.uint8)

    def of(self, g: np.ndarray) -> np.ndarray:
        return self.level[(g >> _U(64 - self.bits)).astype(np.int64)]

    def parts(self, level: np.ndarray) -> np.ndarray:
        """Among how many buckets a key of this level is dealt."""
        return np.ceil(2.0 ** ((level.astype(np.float64) + 1) / self.STEPS) / HOT).astype(np.int64)


def count_shingles(docs: DataFrame, n_bytes: int) -> Counts:
    """Counts of all shingles of all texts; the tables of the packs are added up piece by piece."""
    load = max(1, n_bytes // (6 * SLOT_LOAD))
    bits = min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, load.bit_length()))
    piece = 1 << min(bits, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def found() -> pa.RecordBatch:
            slot, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cuts = np.flatnonzero(np.diff(slot // piece, prepend=-1))
            parts = [pack([np.diff(slot[lo:hi], prepend=slot[lo] // piece * piece), count[lo:hi]]) for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slot)])]
            return pa.record_batch([pa.array((slot[cuts] // piece).astype(np.int32)), pa.array(parts, pa.binary())], names=["piece", "payload"])

        for b in batches:
            for _, _, data, offsets in T.chunks(b):
                w = T.words_of(data, offsets, lower=True)
                at = T.window_starts(w.first, WORDS)
                if len(at):
                    held.append((T.shingles(w.hashes(), WORDS)[at] >> _U(64 - bits)).astype(np.int32))
                size += len(data)
                if size >= PACK_BYTES and held:
                    yield found()
                    size = 0
        if held:
            yield found()
        T.trim()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(piece, dtype=np.int64)
        for p in group.column("payload").to_pylist():
            step, n = unpack(p)
            total[np.cumsum(step)] += n
        return pa.table({"piece": pa.array([group.column("piece")[0].as_py()], pa.int32()), "total": pa.array([int(total.sum())], pa.int64()), "level": pa.array([Counts.levels(total).tobytes()], pa.binary())})

    out, total = np.zeros(1 << bits, dtype=np.uint8), 0
    added = docs.mapInArrow(run, "piece int, payload binary").groupBy("piece").applyInArrow(add, "piece int, total long, level binary")
    for r in added.toArrow().to_pylist():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["level"], dtype=np.uint8)
        total += r["total"]
    return Counts(bits, out, total / (1 << bits))


# --- sketches -----------------------------------------------------------------------------------


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of sets of ``n``: a power of two with two bits a token at least."""
    return 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)


def sketches(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first): parities of the tokens that fall on each bit. A sketch of half the words is the xor of the two halves."""
    words = sketch_words(n)
    first = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(n)), n)
    bit = first[doc] * 64 + ((g >> _U(8)) & (words[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=int(first[-1]) * 64) & 1).astype(bool), bitorder="little").view(np.uint64), first


def differing(words: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of a[i] and b[i] differ, on as many bits as the smaller of the two has."""
    size = np.diff(first)
    out, least = np.zeros(len(a), dtype=np.int64), np.minimum(size[a], size[b])
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        some, code = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        m = np.zeros((len(some), w), dtype=np.uint64)
        for k in np.unique(size[some]).tolist():
            of = np.flatnonzero(size[some] == k)
            m[of] = np.bitwise_xor.reduce(words[first[some[of]][:, None] + np.arange(k)].reshape(len(of), k // w, w), axis=1)
        x, y = code[: len(pairs)], code[len(pairs) :]
        step = max(1, (1 << 21) // w)
        for lo in range(0, len(pairs), step):
            out[pairs[lo : lo + step]] = np.bitwise_count(m[x[lo : lo + step]] ^ m[y[lo : lo + step]]).sum(axis=1)
    return out


# --- keys and stars -----------------------------------------------------------------------------


def combinations_of(g: np.ndarray, doc: np.ndarray, level: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, document, level) of the combinations of two tokens of a document that fall into one of its ``c`` groups; tokens come in their order."""
    group = ((g >> _U(20)) & (c - 1).astype(np.uint64)).astype(np.int64)
    order = np.lexsort((group, doc))
    g, doc, level, group, c = g[order], doc[order], level[order], group[order], c[order].astype(np.uint64)
    out, k = [], 1
    while True:  # by distance in a group
        same = np.flatnonzero((doc[k:] == doc[:-k]) & (group[k:] == group[:-k])) if k < len(g) else np.zeros(0, np.int64)
        if not len(same):
            return out
        two = T.mix(g[same] * _U(3) + T.mix(g[same + k] + c[same])) & ~_U(1)
        out.append((two, doc[same + k], np.minimum(level[same + k], level[same])))
        k += 1


def keys_of(g: np.ndarray, n: np.ndarray, whole: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, level, score): keys of sets, and each set's share of frequent tokens in its prefix."""
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    level = counts.of(g)
    order = np.lexsort((level, doc))  # hashes ascend already, and the sort is stable
    g, level = g[order], level[order]
    p, rank, often = prefix_size(n), np.arange(len(g)) - first[doc], level >= counts.frequent
    inside = rank < p[doc]
    score = T.sums(np.where(inside, level, 0).astype(np.int64), first) * 64 // np.maximum(p, 1)
    single = inside & ~often
    out = [(g[single] & ~_U(1), doc[single], level[single]), (whole | _U(1), np.arange(len(n), dtype=np.int32), np.zeros(len(n), np.uint8))]
    open_ = (np.bincount(doc[~often], minlength=len(n)) < p) & (n > 1)  # rare tokens do not fill the prefix
    own, next_ = groups_of(n), groups_of(n * DEN // NUM)
    for c, more in ((own, open_), (next_, open_ & (next_ > own))):
        at = np.flatnonzero(often & more[doc] & (rank < (p + c)[doc]))
        out += combinations_of(g[at], doc[at], level[at], c[doc[at]])
    key, doc, level = (np.concatenate(x) for x in zip(*out))
    return key, doc, level, score


def _packed(docs: DataFrame, n_buckets: int, counts: Counts) -> DataFrame:
    """(bucket, kind, payload) rows: keys by bucket, links of equal sets, sizes and sketches."""

    def rows(held: list) -> pa.RecordBatch:
        g, n, ids = (np.concatenate(x) for x in zip(*held))
        held.clear()
        words, _ = sketches(g, n)
        out = [(int(abs(int(ids[0])) % n_buckets), _ABOUT, pack([delta(ids), n, words.view(np.uint8)]))]
        first = np.concatenate([[0], np.cumsum(n)])
        whole = T.mix(T.sums(T.mix(g.copy()), first) + n.astype(np.uint64))
        order = np.argsort(ids, kind="stable")
        order = order[n[order] > 0]
        code, place = T.distinct(whole[order])
        least = np.sort(order[place])  # the smallest id of each set
        of = ids[order[place]][code]
        other = ids[order] != of
        if other.any():
            out.append((out[0][0], _COPIES, pack([delta(ids[order][other]), delta(of[other])])))
        keep = np.zeros(len(n), dtype=bool)
        keep[least] = True
        g, n, ids, whole = g[np.repeat(keep, n)], n[keep], ids[keep], whole[keep]
        key, doc, level, score = keys_of(g, n, whole, counts)
        parts = counts.parts(level)
        hot = parts > 1
        salt = np.zeros(len(key), dtype=np.uint64)
        salt[hot] = T.mix(ids[doc[hot]].astype(np.uint64)) % parts[hot].astype(np.uint64) + _U(1)
        bucket = (T.mix(key + salt * _U(0x9E3779B97F4A7C15)) % _U(n_buckets)).astype(np.int32)
        order = np.lexsort((doc, bucket))
        key, doc, bucket, salt = key[order], doc[order], bucket[order], salt[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
            some, which = np.unique(doc[lo:hi], return_inverse=True)
            out.append((int(bucket[lo]), _KEYS, pack([key[lo:hi], delta(which), delta(ids[some]), n[some], score[some], salt[lo:hi]])))
        return pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, offsets in T.chunks(b):
                g, n = sets_of(data, offsets)
                held.append((g, n.astype(np.int64), ids[lo:hi]))
                size += len(data)
                if size >= PACK_BYTES:
                    yield rows(held)
                    size = 0
        if held:
            yield rows(held)
        T.trim()

    return docs.filter("id is not null").mapInArrow(run, "bucket int, kind int, payload binary")


def stars(parts: list[list[np.ndarray]]) -> dict[str, np.ndarray]:
    """(cell, a, b, na, nb): each key's documents b with its centre a. The cell is the centre, or the key itself if it is dealt over several buckets."""
    key, salt = np.concatenate([p[0] for p in parts]), np.concatenate([p[5] for p in parts]) > 0
    shift = np.cumsum([0, *(len(p[2]) for p in parts)])
    doc = np.concatenate([s + undelta(p[1]) for s, p in zip(shift, parts)])
    ids, n, score = np.concatenate([undelta(p[2]) for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64), np.concatenate([p[4] for p in parts]).astype(np.int64)
    by_size = np.lexsort((ids, n))
    place = np.empty(len(ids), dtype=np.int64)
    place[by_size] = np.arange(len(ids))
    ids, n, score, doc = ids[by_size], n[by_size], score[by_size], place[doc]
    order = np.lexsort((doc, key))
    key, doc, hot = key[order].astype(np.int64), doc[order], salt[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (n[doc[:-1]] * DEN < NUM * n[doc[1:]])  # documents beyond a gap in sizes have no partner before it
    begin = np.flatnonzero(new)
    size = np.diff(begin, append=len(key))
    rank = np.empty(len(ids), dtype=np.int64)
    best = np.lexsort((ids, -score))
    rank[best] = np.arange(len(ids))
    centre = np.repeat(best[np.minimum.reduceat(rank[doc], begin)], size) if len(begin) else doc
    keep = hot | (centre != doc)
    cell, a, b, hot = key[keep], centre[keep], doc[keep], hot[keep]
    code = a * len(ids) + b
    _, plain = np.unique(code[~hot], return_index=True)
    plain = np.flatnonzero(~hot)[plain]
    split = np.flatnonzero(hot)
    split = split[np.unique(np.stack([cell[split], code[split]]), axis=1, return_index=True)[1]] if len(split) else split
    at = np.concatenate([plain, split])
    return {"hot": hot[at], "cell": np.where(hot[at], cell[at], ids[a[at]]), "a": ids[a[at]], "b": ids[b[at]], "na": n[a[at]], "nb": n[b[at]]}


_FOUND = pa.schema([("kind", pa.int32()), ("hot", pa.bool_()), ("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("sketch", pa.binary())])


def _meet(group: pa.Table) -> pa.Table:
    """Rows of a bucket: stars (kind 0), links of equal sets (1: a, b), sizes and sketches (2: a, na, sketch)."""
    by_kind: dict[int, list] = {_KEYS: [], _COPIES: [], _ABOUT: []}
    for kind, payload in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist()):
        by_kind[kind].append(unpack(payload))
    del group
    out = []
    for a, b in by_kind[_COPIES]:
        out.append(pa.table({"a": undelta(b), "b": undelta(a), "kind": np.full(len(a), _COPIES, np.int32)}))
    for ids, n, words in by_kind[_ABOUT]:
        n = n.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sketch_words(n))]) * 8
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(first.astype(np.int64).tobytes()), pa.py_buffer(words.astype(np.uint8).tobytes())])
        out.append(pa.table({"a": undelta(ids), "na": n, "sketch": column.cast(pa.binary()), "kind": np.full(len(n), _ABOUT, np.int32)}))
    if by_kind[_KEYS]:
        found = stars(by_kind[_KEYS])
        out.append(pa.table(found | {"kind": np.full(len(found["a"]), _KEYS, np.int32)}))
    table = pa.concat_tables(pa.table({f.name: t.column(f.name) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in _FOUND}, schema=_FOUND) for t in out)
    T.trim()
    return table


# --- comparing documents of cells ---------------------------------------------------------------


def candidates(cell: np.ndarray, left: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, apart): pairs of a left row x and another row y of a cell, of different components, whose sketches do not rule out that they are similar."""
    order = np.lexsort((n, left, cell))
    _, code = np.unique(cell[order], return_inverse=True)
    scale = int(n.max(initial=0)) + 2
    is_left = left[order]
    right = np.flatnonzero(~is_left)
    place = code[right] * scale + n[order][right]  # ascending
    for x in np.array_split(np.flatnonzero(is_left), max(1, int(is_left.sum()) // 4096)):
        nx = n[order][x]
        lo = np.searchsorted(place, code[x] * scale + -(-NUM * nx // DEN))
        hi = np.searchsorted(place, code[x] * scale + np.minimum(DEN * nx // NUM, scale - 1), side="right")
        many = np.maximum(hi - lo, 0)
        upto = np.cumsum(many)
        begin = 0
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 500_000, side="right")))
            k = many[begin:end]
            a = np.repeat(x[begin:end], k)
            b = right[np.repeat(lo[begin:end], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)]
            begin = end
            a, b = order[a], order[b]
            ok = comp[a] != comp[b]
            a, b = a[ok], b[ok]
            if len(a):
                apart = differing(words, first, a, b)
                ok = apart <= most_apart(n[a], n[b])
                yield a[ok], b[ok], apart[ok]


def _sketched(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Columns of rows with sketches: cell, left, id, component, n, and all sketches in one array."""
    cell, left, ids, comp, n = (group.column(c).to_numpy() for c in ("cell", "left", "id", "component", "n"))
    sketch = group.column("sketch").combine_chunks()
    raw = np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint64)
    return cell, left, ids, comp, n, raw, np.concatenate([[0], np.cumsum(sketch_words(n))])


def _likeliest(group: pa.Table) -> pa.Table:
    """(a, b, apart): pairs of a cell's left row a with b that can be similar, from rows with sketches."""
    cols = _sketched(group)
    ids, n = cols[2], cols[4]
    out = [(ids[x], ids[y], d * 1000 // np.maximum(n[x] + n[y], 1)) for x, y, d in candidates(*cols)]
    T.trim()
    return pa.table({c: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k, c in enumerate(("a", "b", "apart"))})


def _hopeful(group: pa.Table) -> pa.Table:
    """(cell, left, id, component, n) of the rows that have a partner in their cell, by sketches."""
    cols = _sketched(group)
    keep = np.zeros(len(cols[0]), dtype=bool)
    for x, y, _ in candidates(*cols):
        keep[x] = keep[y] = True
    T.trim()
    return group.select(["cell", "left", "id", "component", "n"]).filter(pa.array(keep))


def _joined(group: pa.Table) -> pa.Table:
    """Links (a, b) between rows with texts that join two components of this task."""
    cell, left, ids, comp = (group.column(c).to_numpy() for c in ("cell", "left", "id", "component"))
    got = [sets_of(data, offsets) for b in group.select(["text"]).to_batches() for _, _, data, offsets in T.chunks(b)]
    g, n = (np.concatenate(x) for x in zip(*got))
    del got, group
    n = n.astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    words, at = sketches(g, n)
    pairs = list(candidates(cell, left, ids, comp, n, words, at))
    x, y, apart = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
    order = np.argsort(apart / np.maximum(n[x] + n[y], 1), kind="stable")
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    found = []
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        p, q = find(int(comp[i])), find(int(comp[j]))
        if p != q:
            a, b = g[first[i] : first[i + 1]], g[first[j] : first[j + 1]]
            at_b = np.searchsorted(b, a)
            at_b[at_b == len(b)] = 0
            if int((b[at_b] == a).sum()) * (NUM + DEN) >= NUM * (len(a) + len(b)):
                root[max(p, q)] = min(p, q)
                found.append((ids[i], ids[j]))
    T.trim()
    return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([p for _, p in found], pa.int64())})


def _buckets(rows: DataFrame, tokens: int) -> Column:
    """The bucket of a row of a cell, so that a bucket has about ``tokens`` tokens in all its rows."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    return F.pmod(F.xxhash64("cell"), F.lit(max(8, -(-int(total) // tokens))))


def _verified(rows: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Written links (a, b) among rows (cell, left, id, component, n), on the full sets of the texts."""
    wanted = rows.withColumn("bucket", _buckets(rows, TEXT_TOKENS)).drop("n")
    if rows.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    j = docs.join(wanted, "id")
    return written(j.groupBy("bucket").applyInArrow(_joined, "a long, b long"), name)


def _close(a: str, b: str) -> Column:
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _blocks(n: str, rows: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / F.lit(BLOCK_TOKENS)), F.ceil(F.col(rows) / F.lit(BLOCK_ROWS)), F.lit(1)).cast("int")


def _with_sketches(rows: DataFrame, about: DataFrame, run, schema: str) -> DataFrame:
    j = about.join(rows.drop("n").withColumn("bucket", _buckets(rows, SKETCH_TOKENS)), "id")
    return j.groupBy("bucket").applyInArrow(run, schema)


def _first_links(star: DataFrame, about: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of documents with their likeliest centres."""
    tops = star.filter("hot").groupBy("cell", "a", "na").agg(F.lit(1)).withColumn("top", F.first(F.struct("a", "na")).over(Window.partitionBy("cell").orderBy("a")))
    tops = tops.select(F.col("top.a").alias("a"), F.col("a").alias("b"), F.col("top.na").alias("na"), F.col("na").alias("nb"))
    pairs = star.select("a", "b", "na", "nb").unionByName(tops).filter(_close("na", "nb") & (F.col("a") != F.col("b")))
    pairs = written(pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb")), "pairs")
    likely = written(_with_sketches(_hubs(pairs), about, _likeliest, "a long, b long, apart long"), "likely")
    sizes = about.groupBy("id").agg(F.max("n").alias("n"))
    best = likely.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("c")).select(F.col("c.a").alias("a"), "b")
    best = best.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
    wanted = written(_hubs(best), "wanted")
    links = _verified(wanted, docs, "links")
    forget(pairs, likely, wanted)
    return links


def _hubs(pairs: DataFrame) -> DataFrame:
    """Rows (cell, left, id, component, n) of pairs (a, b, na, nb): a is the left row of each block of its b."""
    blocks = pairs.groupBy("a", "na").agg(F.sum("nb").alias("sum"), F.count(F.lit(1)).alias("rows")).select("a", "na", _blocks("sum", "rows").alias("blocks"))
    hubs = blocks.select(F.col("a").alias("id"), F.col("na").alias("n"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("hub"))
    members = pairs.join(blocks.drop("na"), "a").select(F.col("b").alias("id"), F.col("nb").alias("n"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("a").alias("hub"))
    rows = hubs.withColumn("left", F.lit(True)).unionByName(members.withColumn("left", F.lit(False)))
    return rows.select(F.xxhash64("hub", "block").alias("cell"), "left", "id", F.col("id").alias("component"), "n")


def _across(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Written rows (cell, left, id, component, n) of the cells with several components.

    Left are the documents outside a cell's main component, dealt in blocks;
    each block meets every block of the cell's other documents.
    """
    both = star.select("hot", "cell", F.col("a").alias("id"), F.col("na").alias("n")).unionByName(star.select("hot", "cell", F.col("b").alias("id"), F.col("nb").alias("n")))
    rows = both.groupBy("hot", "cell", "id").agg(F.max("n").alias("n")).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = written(rows.select("hot", "cell", "id", "n", "component"), "cells")
    parts = rows.groupBy("hot", "cell", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"))
    main = parts.groupBy("hot", "cell").agg(F.max(F.struct("rows", "sum", "component")).alias("main"), F.sum("rows").alias("rows"), F.sum("sum").alias("sum"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    out_n, out_rows = F.col("sum") - F.col("main.sum"), F.col("rows") - F.col("main.rows")
    main = main.select("hot", "cell", F.col("main.component").alias("main"), _blocks("sum", "rows").alias("ys"), out_n.alias("out_n"), out_rows.alias("out_rows")).withColumn("xs", _blocks("out_n", "out_rows"))
    cells, rows = rows, rows.join(main, ["hot", "cell"])
    block = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    outside = rows.filter("component <> main").withColumn("x", block("xs")).withColumn("y", every("ys")).withColumn("left", F.lit(True))
    inside = rows.withColumn("y", block("ys")).withColumn("x", every("xs")).withColumn("left", F.lit(False))
    both = outside.unionByName(inside.select(outside.columns)).select(F.xxhash64("hot", "cell", "x", "y").alias("cell"), "left", "id", "component", "n")
    out = written(both, "rows")
    forget(cells)
    return out


def _linked(docs: DataFrame, n_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, links, about): components, the links that were found, and (id, n, sketch) of every row with an id."""
    packed = _packed(docs, max(8, -(-n_bytes // BUCKET_BYTES)), count_shingles(docs, n_bytes))
    found = written(packed.groupBy("bucket").applyInArrow(_meet, "kind int, hot boolean, cell long, a long, b long, na long, nb long, sketch binary"), "found")
    about = found.filter(F.col("kind") == _ABOUT).select(F.col("a").alias("id"), F.col("na").alias("n"), "sketch")
    star = found.filter(F.col("kind") == _KEYS).select("hot", "cell", "a", "b", "na", "nb")
    links = _first_links(star, about, docs).unionByName(found.filter(F.col("kind") == _COPIES).select("a", "b"))
    labels = components(links)
    rows = _across(star, labels)
    hopeful = written(_with_sketches(rows, about, _hopeful, "cell long, left boolean, id long, component long, n long"), "hopeful")
    more = _verified(hopeful, docs, "links")
    forget(rows, hopeful)
    if more.head(1):
        links = links.unionByName(more)
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    return labels, links, about


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(labels, links): (id, component) of every document that is linked, and the verified links (a, b) that connect them.

    The id must be a whole number.
    """
    return _linked(_documents(df, id_col, text_col), text_bytes(df, text_col))[:2]


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): each row's set size and its document's class."""
    docs = _documents(df, id_col, text_col)
    labels, _, about = _linked(docs, text_bytes(df, text_col))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in T.chunks(b):
                n = sets_of(data, offsets)[1].astype(np.int64)
                yield pa.record_batch([pa.nulls(len(n), pa.int64()), pa.array(n)], names=["id", "n"])

    unnamed = docs.filter("id is null").mapInArrow(sizes, "id long, n long")
    out = about.select("id", "n").unionByName(unnamed).join(labels, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


SQL = {
    "op8_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id)
SELECT id AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id
"""
}
