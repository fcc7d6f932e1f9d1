"""Token counts under a unigram vocabulary: count-only Viterbi.

A text's spaces become the mark U+2581 and one is put in front, if the text does
not begin with one. The best segmentation of the whole text is wanted. Where no
piece has a mark after another character, none can cross the place before a
mark that follows something else, and the text falls apart there into units
that are segmented on their own; with other vocabularies the whole text is one
unit. A task tells its units apart by their bytes and scores each distinct one
once. An Aho-Corasick automaton lists every vocabulary piece that ends at
each character; dynamic programming carries the best score and the number of
pieces of the path that has it, and nothing is traced back. Control, unknown,
unused and byte pieces are not entered, so a text that spells one is text.

Tie rules are the tokenizer's: paths are extended from left to right and a
path replaces another only with a strictly higher score, so of equal ones that
with the longest last piece stays. A character without a piece of its own may
be taken as unknown at ten below the lowest score; with byte fallback it counts
one piece a byte, otherwise a run of unknown characters counts as one.

Defined results: null and empty texts have no tokens and score 0. Repeated
rows are counted alike; the id is only carried and may be null; other columns
are not read.

The public vocabulary of the query comes from a BPE model, whose scores are
merge ranks and no log probabilities: its counts are those of the best path by
these scores, which are not the counts of that model's own merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import table

MARK = "▁"
_MARK_BYTES = MARK.encode()
UNKNOWN_PENALTY = 10.0
#: Distinct units that a worker remembers; only memory depends on it.
CACHE_UNITS = 250_000


class UnigramCounter:
    """Counts the pieces of the best segmentation. ``vocab``: (piece, score) in id order."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool, special: frozenset[str] = frozenset()):
        pieces = {}
        for piece, score in vocab:
            if piece and piece not in special:
                pieces[piece] = score
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocab}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.splits = not any(b == MARK and a != MARK for p in pieces for a, b in zip(p, p[1:]))
        self.known = T.Remembered(CACHE_UNITS)

    def count(self, unit: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a unit."""
        n = len(unit)
        low = float("-inf")
        best, pieces, last_unknown = [0.0] + [low] * n, [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(unit) if self.automaton.kind == ahocorasick.AHOCORASICK else iter(())
        end, (length, score) = next(matches, (n, (0, 0.0)))
        for i in range(n):
            top, count, unknown = low, 0, False
            while end == i:  # longest first
                s = best[i + 1 - length] + score
                if s > top:
                    top, count = s, pieces[i + 1 - length] + 1
                end, (length, score) = next(matches, (n, (0, 0.0)))
            if unit[i] not in self.single:
                s = best[i] + self.unknown
                if s > top:
                    top, unknown = s, True
                    count = pieces[i] + (len(unit[i].encode()) if self.byte_fallback else not last_unknown[i])
            best[i + 1], pieces[i + 1], last_unknown[i + 1] = top, count, unknown
        return pieces[n], best[n]

    def count_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, score) of each document."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(n_docs, np.int64), np.zeros(n_docs)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if self.splits:
            mark = data == 0x20
            after = np.zeros(len(data), dtype=bool)  # the byte before ends a mark
            after[1:] = mark[:-1]
            after[3:] |= (data[:-3] == _MARK_BYTES[0]) & (data[1:-2] == _MARK_BYTES[1]) & (data[2:-1] == _MARK_BYTES[2])
            cut[:-1] |= mark & ~after
        bounds = np.flatnonzero(cut)
        codes, first = T.distinct_spans(data, bounds)
        raw, known = data.tobytes(), self.known
        known.turn()
        pieces, scores = np.empty(len(first), np.int64), np.empty(len(first))
        lo, hi = bounds[first].tolist(), bounds[first + 1].tolist()
        for k in range(len(first)):
            u = raw[lo[k] : hi[k]]
            got = known.get(u)
            if got is None:
                unit = u.decode().replace(" ", MARK)
                got = known[u] = self.count(unit if unit.startswith(MARK) or not unit else MARK + unit)
            pieces[k], scores[k] = got
        per_doc = np.searchsorted(bounds, offsets)
        return T.sums(pieces[codes], per_doc), T.sums(scores[codes], per_doc)


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], frozenset[str]]:
    """Pieces and scores of a sentencepiece model file, in id order, and those pieces that stand for no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    special = frozenset(sp.id_to_piece(i) for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids], special


@lru_cache(maxsize=2)
def load(path: str, byte_fallback: bool) -> UnigramCounter:
    vocab, special = read_vocabulary(path)
    return UnigramCounter(vocab, byte_fallback, special)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, vocabulary: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of every text; ``vocabulary`` is a path that every machine has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary, byte_fallback)
        for b in batches:
            for lo, hi, data, offsets in T.chunks(b):
                n, s = counter.count_slice(data, offsets)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(s)], names=[id_col, "n_tokens", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, score double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
