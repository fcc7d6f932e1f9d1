"""Substring dedup with prefix-partitioned suffix trees over words.

A window is ``SPAN`` words of a document. A word goes if a window that covers
it also starts in a document with a smaller id. Every window start is a suffix,
of which ``SPAN`` words matter. Suffixes are grouped by prefixes, a group's
subtree is grown, and its nodes of depth ``SPAN`` are the repeats: all their
suffixes but those of the smallest document are marked. Trees alone decide, on
codes of words that are dealt by comparing the words' bytes.

*Trees of a pack.* A task first grows the trees of the few megabytes that it
has read. Suffixes that repeat a smaller document of the pack are marked there;
one document's go on, so a passage that stands in a third of all documents
leaves each pack once.

*Prefix groups.* What is left is dealt to buckets by a minimizer or by
variable-length prefixes. The minimizer (anchor) of a suffix is the least hash
of any three words of its window. It is no prefix: prefixes proper would send
every suffix with its own ``SPAN`` words, as neighbours begin with different
words, while neighbours mostly share their anchor, so they travel as one run of
words and a suffix costs a few bytes. A first pass counts the suffixes of every
anchor, and of the prefixes of the lengths in ``LENGTHS``, in tables of slots,
and finds the commonest words; where an anchor has more than ``HOT`` suffixes
they are dealt by their first words instead, by as many as it takes to come
below it, and by all ``SPAN`` at last. Each of these keys depends on a suffix's ``SPAN`` words alone, so
equal ones meet. Common words travel as codes that all tasks share, of others a
payload has each once.

*Subtrees.* In a bucket, prefixes split the suffixes into groups of at most
``GROUP`` (a prefix with more is extended by a word, again and again; only
suffixes equal in all ``SPAN`` words can exceed it, and of those a pack has sent
one document's). Each group's subtree is grown from its root, some words at a
time: suffixes with equal next words stay together as an internal node, a
suffix that is alone is a leaf and needs no more work.

Marks come back as (document, first window, number of windows), are gathered by
document and cut out of its text. The number of buckets follows the bytes of
text, so a bucket's memory does not.

Defined results: null texts have no words. Null ids neither lose words nor make
others lose them. Rows that repeat an id do not affect each other, whatever
their texts, as no id is smaller than itself; they are told apart by a 64-bit
hash of the text. Documents of fewer than ``SPAN`` words are kept whole. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import forget, table, text_bytes, written
from .packing import delta, pack, undelta, unpack

SPAN = 13
GRAM = 3
#: Words of the longer prefixes by which the suffixes of a hot anchor are dealt; SPAN follows.
LENGTHS = (4, 8)
#: Suffixes of one prefix above which it is extended: before they are dealt, and inside a bucket.
HOT, GROUP = 200_000, 250_000
MIN_SLOT_BITS, MAX_SLOT_BITS = 14, 26
#: Commonest words, whose codes all tasks share, and bytes of such a word at most.
WORDS, WORD_BYTES = 1 << 17, 32
#: A bucket's runs are ordered by so many sub-buckets, whose trees are grown one after the other.
SUBS = 8
PACK_BYTES = 8 << 20
BUCKET_BYTES = 20 << 20
_RUNS = 1  # kind of a row: suffix runs, or marks that a pack has settled
_MARKS = 0


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those of start[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def _runs_of(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of maximal runs of consecutive numbers over which each of ``same`` is constant."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1] + 1
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(begin, append=len(at))


def anchors(h: np.ndarray) -> np.ndarray:
    """The least hash of ``GRAM`` words in the window that begins at each word."""
    gram = T.shingles(h, GRAM)
    if len(h) < SPAN:
        return gram[:0]
    for width in (1, 2, 4):
        gram = np.minimum(gram[:-width], gram[width:])
    extra = SPAN - GRAM + 1 - 8
    return T.mix(np.minimum(gram[:-extra], gram[extra:]))


def coded(words: list[pa.Array], known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, distinct words that are not known): equal codes are equal bytes; a known word's code is its place, others follow. Empties ``words``."""
    w = pa.concat_arrays(words)
    words.clear()
    if not len(known):
        d = w.dictionary_encode()
        return d.indices.to_numpy(), d.dictionary
    at = pc.index_in(w, value_set=known)
    rest = w.filter(at.is_null()).dictionary_encode()
    codes = at.fill_null(-1).to_numpy().copy()
    codes[codes < 0] = rest.indices.to_numpy() + len(known)
    return codes, rest.dictionary


def prefix_keys(h: np.ndarray, starts: np.ndarray, hot: list[np.ndarray], bits: int) -> np.ndarray:
    """The hash of the prefix by which the suffix at each of ``starts`` is dealt; ``hot`` are bits of the slots with too many, by length."""
    key = anchors(h)[starts]
    rest = np.flatnonzero(is_hot(key, hot[0], bits))
    for k, length in enumerate((*LENGTHS, SPAN)):
        if not len(rest):
            break
        longer = T.shingles(h, length)[starts[rest]] + np.uint64(length)
        key[rest] = longer
        if length < SPAN:
            rest = rest[is_hot(longer, hot[k + 1], bits)]
    return key


def is_hot(key: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    return (hot[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


@dataclass
class Survey:
    """What a first pass tells of all texts: bits of the slots with too many suffixes, for anchors and each of ``LENGTHS``, and the commonest words."""

    hot: list[np.ndarray]
    bits: int
    words: pa.Array


def survey(docs: DataFrame, n_bytes: int) -> Survey:
    """One pass over all texts, counted by packs.

    A pack counts each distinct window once, as its trees will send one
    document's, and names its commonest words of at most ``WORD_BYTES``. Tables
    have a fixed number of slots and the words a fixed number, so what comes to
    the driver is bounded: some 4 MB of words.
    """
    load = max(1, n_bytes // 6 * 16 // HOT)
    bits = min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, load.bit_length()))

    def rows(held: list, total: np.ndarray) -> pa.RecordBatch:
        words, window, *keys = map(list, zip(*held))
        held.clear()
        if sum(map(len, window)):
            _, place = np.unique(np.concatenate(window), return_index=True)
            window.clear()
            for k, key in enumerate(keys):
                total[k] += np.bincount(np.concatenate(key)[place], minlength=1 << bits)
        codes, dictionary = coded(words, pa.nulls(0, pa.large_binary()))
        n = np.bincount(codes, minlength=len(dictionary))
        short = pc.less_equal(pc.binary_length(dictionary), WORD_BYTES).to_numpy(zero_copy_only=False)
        dictionary, n = dictionary.filter(pa.array(short)), n[short]
        best = np.argsort(-n, kind="stable")[: WORDS // 2]
        zero = np.zeros(len(best), np.int32)
        return pa.record_batch([pa.array(zero - 1), pa.array(zero), dictionary.take(pa.array(best)).cast(pa.binary()), pa.array(n[best])], names=["level", "slot", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + len(LENGTHS), 1 << bits), dtype=np.int64)
        held, size = [], 0
        for b in batches:
            for _, _, data, offsets in T.chunks(b):
                w = T.words_of(data, offsets)
                h, at = w.hashes(), T.window_starts(w.first, SPAN)
                keys = [anchors(h)[at], *(T.shingles(h, n)[at] + np.uint64(n) for n in LENGTHS)] if len(at) else [h[:0]] * (1 + len(LENGTHS))
                held.append((w.array(), T.shingles(h, SPAN)[at] if len(at) else h[:0], *((k >> np.uint64(64 - bits)).astype(np.int32) for k in keys)))
                size += len(data)
                if size >= PACK_BYTES:
                    yield rows(held, total)
                    size = 0
        if held:
            yield rows(held, total)
        level, slot = np.nonzero(total)
        n = total[level, slot]
        del total
        T.trim()
        for lo in range(0, len(n), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.record_batch([pa.array(level[part].astype(np.int32)), pa.array(slot[part].astype(np.int32)), pa.nulls(len(n[part]), pa.binary()), pa.array(n[part])], names=["level", "slot", "word", "n"])

    counts = written(docs.mapInArrow(run, "level int, slot int, word binary, n long").groupBy("level", "slot", "word").agg(F.sum("n").alias("n")), "survey")
    limit = max(HOT, 4 * (n_bytes // 6 >> bits))
    found = counts.filter(F.col("level") >= 0).filter(F.col("n") > limit).select("level", "slot").toArrow()
    words = counts.filter(F.col("level") < 0).orderBy(F.desc("n"), "word").limit(WORDS).select("word").toArrow().column("word").combine_chunks()
    forget(counts)
    level, slot = found.column("level").to_numpy(), found.column("slot").to_numpy()
    out = []
    for k in range(1 + len(LENGTHS)):
        flags = np.zeros(1 << bits, dtype=bool)
        flags[slot[level == k]] = True
        out.append(np.packbits(flags, bitorder="little"))
    return Survey(out, bits, words.cast(pa.large_binary()))


def pack_runs(keys: list[np.ndarray], words: list[pa.Array], n_words: np.ndarray, ids: np.ndarray, marks: np.ndarray, known: pa.Array, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload) rows of a pack of documents, from the prefix keys of their windows; ``marks`` tells rows of one id apart."""
    first = np.concatenate([[0], np.cumsum(n_words)])
    starts = T.window_starts(first, SPAN).astype(np.int32)
    if not len(starts):
        return
    codes, dictionary = coded(words, known)
    common = len(known)
    doc = np.repeat(np.arange(len(n_words), dtype=np.int32), np.maximum(n_words - SPAN + 1, 0))
    local = repeated(codes, starts, np.unique(ids, return_inverse=True)[1].astype(np.int32)[doc])
    at = np.flatnonzero(local)
    begin, n = _runs_of(starts[at], doc[at])
    if len(begin):
        d = doc[at[begin]]
        yield int(T.mix(ids[:1].astype(np.uint64))[0] % np.uint64(n_buckets)), _MARKS, pack([delta(ids[d]), marks[d].view(np.uint64), starts[at[begin]] - first[d], n])
    # the rest, in runs of one prefix
    at = np.flatnonzero(~local)
    key = np.concatenate(keys)[at]
    keys.clear()
    begin, n = _runs_of(starts[at], doc[at], key)
    bucket = (T.mix(key[begin]) % np.uint64(n_buckets * SUBS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sub, bucket, begin, n = bucket[order] % SUBS, bucket[order] // SUBS, at[begin[order]], n[order]
    del at, key, order, local
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        s, c = starts[begin[lo:hi]], n[lo:hi]
        run = codes[_expand(s, c + (SPAN - 1))].astype(np.int64)
        rare = run >= common
        vocabulary, number = np.unique(run[rare], return_inverse=True)
        run[rare] = number + common
        text, ends = T.binary_buffers(dictionary.take(pa.array(vocabulary - common)))
        d = doc[begin[lo:hi]]
        some, which = np.unique(d, return_inverse=True)
        yield int(bucket[lo]), _RUNS, pack([np.diff(ends), text, run, c, delta(which), s - first[d], delta(ids[some]), marks[some].view(np.uint64), sub[lo:hi]])


def prefix_groups(codes: np.ndarray, starts: np.ndarray, depth: int = 0, limit: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(places in ``starts``, depth): groups of at most ``limit`` suffixes that share their first ``depth`` words."""
    limit = limit or GROUP
    stack = [(np.arange(len(starts)), depth)]
    while stack:
        at, depth = stack.pop()
        if len(at) <= limit or depth == SPAN:
            yield at, depth
            continue
        word = codes[starts[at] + depth]
        order = np.argsort(word, kind="stable")
        at, word = at[order], word[order]
        cuts = [*np.flatnonzero(np.diff(word, prepend=-1)).tolist(), len(at)]
        lo = 0
        for a, b in zip(cuts, cuts[1:]):
            if b - a > limit:
                if a > lo:
                    yield at[lo:a], depth
                stack.append((at[a:b], depth + 1))
                lo = b
            elif b - lo > limit:
                yield at[lo:a], depth
                lo = a
        if lo < len(at):
            yield at[lo:], depth


def subtree(codes: np.ndarray, starts: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``starts``, node) of the suffixes that lie below internal nodes of depth ``SPAN``, node by node."""
    at, node, node_bits = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64), 0
    while depth < SPAN and len(at):
        step = max(1, min(SPAN - depth, (63 - node_bits) // bits))
        key = node
        for k in range(step):
            key = key << bits | codes[starts[at] + (depth + k)]
        depth += step
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(begin, append=len(key))
        inner = size > 1  # a suffix alone is a leaf
        at = at[order][np.repeat(inner, size)]
        node = np.repeat(np.arange(int(inner.sum())), size[inner])
        node_bits = int(inner.sum()).bit_length()
    return at, node


def repeated(codes: np.ndarray, starts: np.ndarray, ids: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Whether each suffix's ``SPAN`` words also start in a document with a smaller id."""
    out = np.zeros(len(starts), dtype=bool)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    for group, depth in prefix_groups(codes, starts, limit=limit):
        at, node = subtree(codes, starts[group], depth, bits)
        if len(at):
            at = group[at]
            least = np.minimum.reduceat(ids[at], np.flatnonzero(np.diff(node, prepend=-1)))
            out[at] = ids[at] > least[node]
    return out


def _unified(codes: np.ndarray, code: np.ndarray, common: int, first: int) -> np.ndarray:
    """A payload's codes as the bucket's; its own words stand from ``first`` on in the bucket's list."""
    return code[np.where(codes < common, codes, codes + first)]


def bucket_marks(payloads: list[bytes], common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks (id, row mark, first window, windows) from a bucket's suffix runs; ``common`` words have codes that all packs share."""
    parts = []
    words = []
    for p in payloads:
        length, text, *rest = unpack(p)
        words.append(T.binary_array(text, np.concatenate([[0], np.cumsum(length)])))
        parts.append(rest)
    payloads.clear()
    first = np.cumsum([0, *(len(w) for w in words)])
    code, _ = coded(words, pa.nulls(0, pa.large_binary()))
    code = np.concatenate([np.arange(common, dtype=np.int32), code + np.int32(common)])
    ids, marks = [undelta(p[4]) for p in parts], [p[5].astype(np.int64) for p in parts]
    docs = [undelta(p[2]).astype(np.int32) for p in parts]
    ends = [np.concatenate([[0], np.cumsum(p[1] + (SPAN - 1))]) for p in parts]
    shift = np.cumsum([0, *map(len, ids)])
    all_ids, all_marks = np.concatenate(ids), np.concatenate(marks)
    out = []
    for sub in range(SUBS):
        cut = [(int(np.searchsorted(p[6], sub)), int(np.searchsorted(p[6], sub, side="right"))) for p in parts]
        codes = np.concatenate([_unified(p[0][e[lo] : e[hi]], code, common, f) for p, f, e, (lo, hi) in zip(parts, first, ends, cut)])
        count = np.concatenate([p[1][lo:hi] for p, (lo, hi) in zip(parts, cut)]).astype(np.int64)
        run_doc = np.concatenate([s + d[lo:hi] for s, d, (lo, hi) in zip(shift, docs, cut)])
        run_at = np.concatenate([p[3][lo:hi] for p, (lo, hi) in zip(parts, cut)])
        length = count + (SPAN - 1)
        starts = _expand(np.cumsum(length) - length, count)
        doc = np.repeat(run_doc, count)
        hit = np.flatnonzero(repeated(codes, starts, all_ids[doc]))
        at, doc = _expand(run_at, count)[hit], doc[hit]
        order = np.lexsort((at, doc))
        at, doc = at[order], doc[order]
        begin, n = _runs_of(at, doc)
        out.append((all_ids[doc[begin]], all_marks[doc[begin]], at[begin], n))
    return tuple(np.concatenate(x) for x in zip(*out))


def find_repeats(docs: DataFrame, n_bytes: int) -> DataFrame:
    """Marks of ``docs`` (id long, mark long, text): (id, mark, at, n), n windows from word ``at`` on."""
    n_buckets = max(8, -(-n_bytes // BUCKET_BYTES))
    docs = docs.filter(F.col("id").isNotNull())
    known = survey(docs, n_bytes)
    common = len(known.words)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list) -> pa.RecordBatch:
            keys, words, n, ids, marks = map(list, zip(*held))
            held.clear()
            got = list(pack_runs(keys, words, *(np.concatenate(x) for x in (n, ids, marks)), known.words, n_buckets))
            T.trim()
            return pa.record_batch([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary())], names=["bucket", "kind", "payload"])

        held, size = [], 0
        for b in batches:
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, data, offsets in T.chunks(b):
                w = T.words_of(data, offsets)
                key = prefix_keys(w.hashes(), T.window_starts(w.first, SPAN), known.hot, known.bits)
                held.append((key, w.array(), w.n_words, ids[lo:hi], marks[lo:hi]))
                size += len(data)
                if size >= PACK_BYTES:
                    yield rows(held)
                    size = 0
        if held:
            yield rows(held)

    def grow(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        payload = group.column("payload").to_pylist()
        del group
        marks = [p for k, p in zip(kind, payload) if k == _MARKS]
        runs = [p for k, p in zip(kind, payload) if k == _RUNS]
        del payload
        out = [(undelta(a), b.astype(np.int64), c, d) for a, b, c, d in map(unpack, marks)]
        if runs:
            out.append(bucket_marks(runs, common))
        a, b, c, d = (np.concatenate(x) for x in zip(*out))
        T.trim()
        return pa.table({"id": pa.array(a, pa.int64()), "mark": pa.array(b, pa.int64()), "at": pa.array(c, pa.int32()), "n": pa.array(d, pa.int32())})

    return docs.mapInArrow(packed, "bucket int, kind int, payload binary").groupBy("bucket").applyInArrow(grow, "id long, mark long, at int, n int")


def _cut(batches: Iterator[pa.RecordBatch], as_is: bool) -> Iterator[pa.RecordBatch]:
    """(id, text, at list, n list, others) to (id, n_words, n_removed, kept, others); ``as_is`` keeps texts that lose nothing as they are."""
    for b in batches:
        carried = b.schema.names[4:]
        lists = [c.fill_null([]) if c.null_count else c for c in (b.column(2), b.column(3))]
        ends = lists[0].offsets.to_numpy()
        at, n = (c.flatten().to_numpy() for c in lists)
        ends = ends - ends[0]
        for lo, hi, data, offsets in T.chunks(b):
            w = T.words_of(data, offsets)
            s, c = at[ends[lo] : ends[hi]].astype(np.int64), n[ends[lo] : ends[hi]].astype(np.int64)
            s = s + w.first[np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))]
            edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + c + (SPAN - 1), -1)
            keep = np.cumsum(edge)[:-1] == 0
            step = np.zeros(len(data) + 2, dtype=np.int8)
            step[w.starts[keep]] = 1
            step[w.ends[keep] + 1] -= 1  # with one byte of white space after the word
            stay = np.cumsum(step[: len(data)], dtype=np.int8) > 0
            gap = w.ends[keep]
            out = data.copy()
            out[gap[gap < len(data)]] = 0x20
            # the byte after a document's last word may belong to the next document
            last = np.flatnonzero(np.diff(w.doc[keep], append=-1)) if keep.any() else np.zeros(0, np.int64)
            tail = gap[last]
            inner = tail < offsets[w.doc[keep][last] + 1]
            stay[tail[inner]] = False
            clash = tail[~inner]
            clash = clash[clash < len(data)]
            own = np.zeros(len(data) + 1, dtype=bool)
            own[w.starts[keep]] = True
            stay[clash] = own[clash]
            out[clash] = data[clash]
            size = T.sums(stay.astype(np.int64), offsets)
            raw = pa.py_buffer(out[stay].tobytes())
            kept = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()), raw).cast(pa.string())
            total = w.n_words
            left = T.sums(keep.astype(np.int64), w.first)
            if as_is:
                kept = pc.if_else(pa.array(left < total), kept, b.column(1).slice(lo, hi - lo).cast(pa.string()))
            cols = [b.column(0).slice(lo, hi - lo), pa.array(total), pa.array(total - left), kept, *(b.column(c).slice(lo, hi - lo) for c in carried)]
            yield pa.record_batch(cols, names=["id", "n_words", "n_removed", "kept", *carried])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): the text of each document without repeated passages, words joined by one space.

    The columns in ``carry`` follow. The id must be a whole number. With
    ``as_is`` texts that lose nothing are kept with their white space, and null
    ones null.
    """
    others = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"), *others)
    marks = find_repeats(docs.select("id", "mark", "text"), text_bytes(df, text_col)).groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("runs"))
    marks = marks.select("id", "mark", F.col("runs.at").alias("at"), F.col("runs.n").alias("n"))  # equal rows have the same marks, once
    both = docs.join(marks, ["id", "mark"], "left").select("id", "text", "at", "n", *(f"c{k}" for k in range(len(carry))))
    more = "".join(f", c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = both.mapInArrow(lambda batches: _cut(batches, as_is), "id long, n_words long, n_removed long, kept string" + more)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash(w[i:i + 12]) AS h, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, g, min(doc_id) AS f FROM win GROUP BY h, g),
hit AS (SELECT win.doc_id, win.i FROM win JOIN f ON win.h = f.h AND win.g = f.g WHERE f.f < win.doc_id),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM hit) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
gk AS (SELECT doc_id, unnest(ks) AS k FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gk USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
