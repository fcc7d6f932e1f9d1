"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

A task splits its texts into units (a run of non-space characters with the one
space before it, or white space between), hashes every unit with array
arithmetic and keeps the distinct ones. Each distinct unit is cut into the
tokenizer's words, and the distinct words, sorted, are walked as a trie:
neighbours in sorted order share a path as long as their common prefix, so a
depth-first walk only visits the letters below the branching point. The state
of a node is the last token of the encoding of its prefix. It is found from the
states of its ancestors: the one token that ends there and that can follow the
last token of what is left of it (encodings are unique, so the order in which
tokens are tried is free). A pair of tokens can stand side by side
if, undoing their merges latest first, no merge across the border would have
come earlier; the verdict for a pair is computed once in a worker. A word's
encoding is read off by stepping back through the states of its path.

Decoding gathers token bytes by id with array indexing and reads them as UTF-8,
malformed bytes as U+FFFD.

Defined results: a null text encodes as the empty text, an empty text as no
ids and decodes as empty. Strings of special tokens in a text become their id.
Ids outside the vocabulary decode to nothing, null id lists to the empty text.
Repeated rows are encoded alike; the id column is only carried and may be null;
other columns are not read.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import table

#: The tokenizer's split pattern, its white space spelled out.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WIDE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_WIDE_SPACE = regex.compile("[" + "".join(_WIDE) + "]")
_WIDE_BYTES = [c.encode() for c in _WIDE]
#: Distinct units that a worker remembers; only memory depends on it.
CACHE_UNITS = 100_000
#: Verdicts on pairs of tokens that a worker remembers.
CACHE_PAIRS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file uses for bytes."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary with the memo of compatible token pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for s, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        none = 1 << 40
        self.left, self.right, self.rank = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.merged: dict[int, int] = {}
        self.none = none
        whole = {i for i, b in enumerate(self.bytes) if len(b) == 1}
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if (i << 20 | j) in self.merged:
                continue
            self.merged[i << 20 | j] = r
            if self.rank[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, r
                if i in whole and j in whole and self._side_by_side(i, j, r, r):
                    whole.add(k)
        #: Tokens whose own string encodes as the token: the only ones that an encoding can hold.
        self.vocab = {self.bytes[i]: i for i in whole}
        self.longest = [0] * 256
        for b in self.vocab:
            self.longest[b[-1]] = max(self.longest[b[-1]], len(b))
        self.pairs: dict[int, bool] = {}
        self.units = T.Remembered(CACHE_UNITS)
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def _side_by_side(self, a: int, b: int, used_a: int, used_b: int) -> bool:
        """Whether no merge joins tokens a and b across their border before the ranks at which they are used up."""
        merged, rank, left, right = self.merged, self.rank, self.left, self.right
        while True:
            r = merged.get(a << 20 | b)
            if r is not None and r < used_a and r <= used_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                used_a, a = ra, right[a]
            elif rb >= 0:
                used_b, b = rb, left[b]
            else:
                return True

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words by one depth-first walk of their trie."""
        vocab, pairs, longest, none = self.vocab, self.pairs, self.longest, self.none
        get, check = vocab.get, self._side_by_side
        out: dict[bytes, tuple[int, ...]] = {}
        state: list[int] = [-1]  # last token at each depth of the current path
        size: list[int] = [0]  # and its length
        before = b""
        for w in sorted(words):
            n, depth = len(w), 0
            most = min(n, len(before))
            if w[:most] == before[:most]:
                depth = most
            else:
                while w[depth] == before[depth]:
                    depth += 1
            del state[depth + 1 :], size[depth + 1 :]
            for i in range(depth + 1, n + 1):
                at = i - 1 - size[-1]  # most often the last token of the parent grows by a letter
                t = get(w[at:i])
                if t is not None:
                    if not at:
                        state.append(t)
                        size.append(i)
                        continue
                    key = state[at] << 20 | t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = check(state[at], t, none, none)
                    if ok:
                        state.append(t)
                        size.append(i - at)
                        continue
                k = longest[w[i - 1]]
                at = i - k if k < i else 0
                while True:
                    t = get(w[at:i])
                    if t is not None:
                        if not at:
                            break
                        key = state[at] << 20 | t
                        ok = pairs.get(key)
                        if ok is None:
                            ok = pairs[key] = check(state[at], t, none, none)
                        if ok:
                            break
                    at += 1
                state.append(t)
                size.append(i - at)
            ids, i = [], n
            while i:
                ids.append(state[i])
                i -= size[i]
            out[w] = tuple(ids[::-1])
            before = w
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        return out

    def encode_units(self, units: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each unit, which is any text without special tokens."""
        known = self.units
        known.turn()
        out = [known.get(u) for u in units]
        new: dict[int, list[bytes]] = {}
        words: set[bytes] = set()
        for k, ids in enumerate(out):
            if ids is None:
                u = units[k]
                if u.isalpha() or u[:1] == b" " and u[1:].isalpha():
                    new[k] = [u]
                    words.add(u)
                else:
                    new[k] = found = [x.encode() for x in PATTERN.findall(u.decode())]
                    words.update(found)
        known.update(self.encode_words([w for w in words if known.get(w) is None]))
        for k, parts in new.items():
            out[k] = ids = known[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable([known[p] for p in parts]))
            known[units[k]] = ids
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, ids of each document)."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        raw = data.tobytes()
        odd = [i for s in self.special for i in _docs_with(raw, s.encode(), offsets)]
        if any(s in raw for s in _WIDE_BYTES):
            odd += [i for i in range(n_docs) if offsets[i + 1] > offsets[i] and _WIDE_SPACE.search(raw[offsets[i] : offsets[i + 1]].decode())]
        special = np.zeros(n_docs, dtype=bool)
        special[odd] = True
        bounds = _unit_bounds(data, offsets)
        codes, first = T.distinct_spans(data, bounds)
        lo, hi = bounds[first].tolist(), bounds[first + 1].tolist()
        per_doc = np.searchsorted(bounds, offsets)
        if len(odd):
            skip = np.repeat(special, np.diff(per_doc))
            used = np.bincount(codes[~skip], minlength=len(first)) > 0
        else:
            used = np.ones(len(first), dtype=bool)
        live = np.flatnonzero(used)
        found = self.encode_units([raw[lo[k] : hi[k]] for k in live.tolist()])
        ids: list[tuple[int, ...]] = [()] * len(first)
        for k, x in zip(live.tolist(), found):
            ids[k] = x
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
        if not len(odd):
            out, n = T.segments(flat, sizes, codes)
            return out, T.sums(n, per_doc)
        pieces, counts = [], []
        for i in range(n_docs):  # a slice with special documents is put together document by document
            if special[i]:
                one = np.array(self._encode_special(raw[offsets[i] : offsets[i + 1]].decode()), dtype=np.int32)
            else:
                one, _ = T.segments(flat, sizes, codes[per_doc[i] : per_doc[i + 1]])
            pieces.append(one)
            counts.append(len(one))
        return np.concatenate(pieces), np.array(counts, dtype=np.int64)

    def _encode_special(self, text: str) -> list[int]:
        """A text with special tokens or wide white space: split at special tokens, then as the pattern says."""
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        out: list[int] = []
        for part in cut.split(text) if cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words = [w.encode() for w in PATTERN.findall(part)]
                ids = self.encode_words(list(set(words)))
                out += chain.from_iterable(ids[w] for w in words)
        return out

    def decode_slice(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id lists that stand one after the other."""
        ok = (ids >= 0) & (ids < self.size)
        length = np.where(ok, self.length[np.where(ok, ids, 0)], 0)
        start = (np.cumsum(self.length) - self.length)[np.where(ok, ids, 0)]
        total = int(length.sum())
        at = np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
        raw = self.flat[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(T.sums(length, np.concatenate([[0], np.cumsum(counts)])))]).tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _docs_with(raw: bytes, needle: bytes, offsets: np.ndarray) -> list[int]:
    """Documents in which the bytes occur, not across a border."""
    out, at = [], raw.find(needle)
    while at >= 0:
        i = int(np.searchsorted(offsets, at, side="right")) - 1
        if at + len(needle) <= offsets[i + 1]:
            out.append(i)
        at = raw.find(needle, at + 1)
    return out


def _unit_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where units begin, and the end of the data."""
    n = len(data)
    w = T.words_of(data, offsets)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    border = cut.copy()
    start = w.starts
    cut[w.ends] = True  # white space after a word
    led = start[~border[start]]  # words with white space before them in their document: its last character stands alone or is the space
    cut[led - 1] = True
    cut[start[border[start]]] = True
    other = led[data[led - 1] != 0x20]
    cut[other] = True
    cut[n] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The vocabulary, once in a worker."""
    out = ByteBPE(path)
    gc.collect()
    T.trim()  # what reading the file took
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(ids, pa.int32()))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; ``vocabulary`` is a path that every machine has."""
    return _encoded(df, vocabulary, id_col, text_col, False)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text) of every text: its ids and what they decode to, in one pass through a worker."""
    return _encoded(df, vocabulary, id_col, text_col, True)


def _encoded(df: DataFrame, vocabulary: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    names = [id_col, "ids", "text"][: 3 if back else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            for lo, hi, data, offsets in T.chunks(b):
                ids, n = bpe.encode_slice(data, offsets)
                cols = [b.column(0).slice(lo, hi - lo), _lists(ids, n)]
                yield pa.record_batch(cols + [pa.array(bpe.decode_slice(ids, n), pa.string())] if back else cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", text string" * back)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of every id list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(n)])
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + T.CHUNK_BYTES // 4, side="right")) - 1)
                hi = min(hi, len(n))
                texts = bpe.decode_slice(ids[ends[lo] : ends[hi]], n[lo:hi])
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string())]
                yield pa.record_batch(cols, names=[id_col, "ids", "text"])
                lo = hi

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    out = round_trip(table(spark, sf_dir, "documents"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
