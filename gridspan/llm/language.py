"""Language ID by a bidirectional gated recurrent network over bytes.

A text is cut into pieces of ``PIECE`` bytes, so that thousands of pieces of
many documents advance together, one array operation for each step. Two gated
recurrent layers read each piece forwards and backwards, a softmax over both
states labels every byte, and a document's probabilities are the mean over all
its bytes. Training is backpropagation through time in numpy on the driver,
over a bounded sample of all languages: about ``PER_LANGUAGE`` documents of each
or, if there are many, an even share of ``SAMPLE``, but ``FEW`` at least (so
``SAMPLE`` holds up to SAMPLE / FEW = 3200 languages), one piece of each at a
place that a hash gives. Ids are drawn by comparing their hash with a rate for
the language, so no group is gathered or sorted; one row of an id and language
teaches.

Learned only from documents whose fold is not 1.

Defined results: null texts and texts without a letter are ``und`` with score
0; if nothing can be learned every text is. Rows without language or id teach
nothing and are predicted like others; a null id is not held out. Equal
probabilities go to the language that sorts first. Repeated rows are predicted
alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import fold, table

FOLDS, HELD = 3, 1
PIECE = 64
HIDDEN = 8
PER_LANGUAGE = 800
SAMPLE = 51_200
#: So many expected draws that a language without any is unlikely (e^-16); a language of fewer documents gives all.
FEW = 16
STEPS = 150
BATCH = 256
RATE = 0.02
UNKNOWN = "und"
ROWS = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Two gated recurrent layers and a softmax at every byte."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        small = lambda *n: (rng.standard_normal(n) * 0.3).astype(np.float32)
        self.languages = languages
        # of each direction: input table (update, reset, candidate), recurrent matrix, candidate's recurrent bias
        self.p = {}
        for way in "fb":
            self.p |= {f"w{way}": small(256, 3 * h), f"u{way}": small(h, 3 * h), f"c{way}": np.zeros(h, np.float32)}
        self.p |= {"o": small(2 * h, len(languages)), "d": np.zeros(len(languages), np.float32)}

    def _layer(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (step, piece, unit) of one direction; ``x`` is (step, piece)."""
        h, (w, u, c) = HIDDEN, (self.p[k + way] for k in "wuc")
        out = np.empty((*x.shape, h), dtype=np.float32)
        state = np.zeros((x.shape[1], h), dtype=np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a, b = w[x[t]], state @ u
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            inner = b[:, 2 * h :] + c
            n = r * inner
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, state, z, r, inner, n))
            new = out[t]
            np.subtract(state, n, out=new)
            new *= z
            new += n
            state = new
        return out

    def label(self, pieces: np.ndarray) -> np.ndarray:
        """Probabilities (step, language, piece) of every byte of ``pieces`` (piece, step).

        Units lead and pieces run along memory; both directions advance in one
        array. The halves of sigmoid(x) = (1 + tanh(x / 2)) / 2 are folded into
        the weights.
        """
        h, x = HIDDEN, np.ascontiguousarray(pieces.T)
        steps, n = x.shape
        half = np.repeat(np.float32([0.5, 0.5, 1]), h)[:, None]
        w = [np.ascontiguousarray(self.p["w" + k].T * half) for k in "fb"]
        u = np.stack([self.p["u" + k].T * 0.5 for k in "fb"])
        c = np.stack([self.p["c" + k] * 0.5 for k in "fb"])[:, :, None]
        a, b = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
        state = np.zeros((2, h, n), np.float32)
        states = np.empty((steps, 2, h, n), np.float32)
        for t in range(steps):
            np.take(w[0], x[t], axis=1, out=a[0], mode="clip")
            np.take(w[1], x[steps - 1 - t], axis=1, out=a[1], mode="clip")
            np.matmul(u, state, out=b)
            gates, inner, new = b[:, : 2 * h], b[:, 2 * h :], a[:, 2 * h :]
            gates += a[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            inner += c
            inner *= gates[:, h:]
            new += inner
            np.tanh(new, out=new)
            state -= new
            state *= gates[:, :h]
            state *= 0.5
            state += new
            states[t, 0], states[steps - 1 - t, 1] = state
        y = np.matmul(self.p["o"].T, states.reshape(steps, 2 * h, n))
        y += self.p["d"][:, None]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, pieces: np.ndarray, length: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy of all bytes."""
        h, x = HIDDEN, np.ascontiguousarray(pieces.T)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._layer(x, way, kept[way]) for way in "fb"], axis=2)
        y = both @ self.p["o"] + self.p["d"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        y[:, np.arange(len(target)), target] -= 1
        y *= (np.arange(len(x))[:, None] < length)[:, :, None] / max(1, length.sum())
        g = {"o": np.tensordot(both, y, axes=([0, 1], [0, 1])), "d": y.sum(axis=(0, 1))}
        back = y @ self.p["o"].T
        for way, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = self.p["u" + way]
            gw, gu, gc = np.zeros_like(self.p["w" + way]), np.zeros_like(u), np.zeros(h, np.float32)
            dh = np.zeros((x.shape[1], h), dtype=np.float32)
            for t, state, z, r, inner, n in reversed(kept[way]):
                dh = dh + back[t, :, cols]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gw, x[t], da)
                gu += state.T @ db
                gc += (dn * r).sum(axis=0)
                dh = dh * z + db @ u.T
            g |= {"w" + way: gw, "u" + way: gu, "c" + way: gc}
        return g

    def train(self, pieces: np.ndarray, length: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """Adam over batches in which every language is as frequent as the others."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        groups = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        groups = [g for g in groups if len(g)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(pieces[pick], length[pick], target[pick]).items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each document."""
        n_docs = len(offsets) - 1
        total = np.zeros((n_docs, len(self.languages)))
        size = np.diff(offsets)
        count = -(-size // PIECE)
        doc = np.repeat(np.arange(n_docs), count)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[doc] + place * PIECE
        length = np.minimum(PIECE, offsets[doc + 1] - start)
        padded = np.concatenate([data, np.zeros(PIECE, np.uint8)])
        for lo in range(0, len(doc), ROWS):
            hi = min(lo + ROWS, len(doc))
            piece = padded[start[lo:hi, None] + np.arange(PIECE)]
            piece[np.arange(PIECE) >= length[lo:hi, None]] = 0  # not the next document's bytes; training fills up in the same way
            y = self.label(piece)
            if (length[lo:hi] < PIECE).any():
                y *= (np.arange(PIECE)[:, None] < length[lo:hi])[:, None, :]
            for k, p in enumerate(y.sum(axis=0)):
                total[:, k] += np.bincount(doc[lo:hi], p, minlength=n_docs)
        return total / np.maximum(size, 1)[:, None]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has a letter of any script."""
    folded = data | 0x20
    ascii_letter = (folded >= 97) & (folded <= 122) & (data < 128)
    out = T.sums(ascii_letter.astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~out & (T.sums((data >= 128).astype(np.int64), offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = SAMPLE) -> Network | None:
    """Train on a bounded sample of the documents outside the held-out fold."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = d.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # a row for each language
    if not counts:
        return None
    each = max(FEW, min(per_language, in_all // len(counts)))
    # estimates stray by some hundredths; a language that hardly passes the share gives all its ids
    rates = docs.sparkSession.createDataFrame([(r["lang"], 1.0 if r["n"] <= 1.25 * each else each / r["n"]) for r in counts], "lang string, rate double")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.join(F.broadcast(rates), "lang").filter(hashed < F.col("rate")).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.text_buffers(b.column(1))
            n = np.diff(offsets)
            ok = np.flatnonzero(has_letter(data, offsets))
            at = T.mix(ok.astype(np.uint64) + T.mix(n[ok].astype(np.uint64))) % np.maximum(n[ok] - PIECE + 1, 1).astype(np.uint64)
            got = [data[s : s + min(PIECE, n[k])].tobytes() for k, s in zip(ok.tolist(), (offsets[ok] + at.astype(np.int64)).tolist())]
            yield pa.record_batch([b.column(0).take(pa.array(ok)), pa.array(got, pa.binary()), b.column(2).take(pa.array(ok))], names=["doc_id", "piece", "lang"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"doc_id {kind}, piece binary, lang string").groupBy("doc_id", "lang").agg(F.min("piece").alias("piece")).collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["piece"])) for r in rows)
    languages = sorted({r[0] for r in rows})
    net = Network(languages)
    pieces = np.stack([np.frombuffer(p.ljust(PIECE, b"\0"), dtype=np.uint8) for _, p in rows])
    net.train(pieces, np.array([len(p) for _, p in rows]), np.array([languages.index(g) for g, _ in rows]))
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document."""
    data = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = data.value
        for b in batches:
            for lo, hi, raw, offsets in T.chunks(b, size=T.CHUNK_BYTES // 2):
                ok = has_letter(raw, offsets)
                if net:
                    p = net.pooled(raw, offsets)
                    best = p.argmax(axis=1)
                    names = [net.languages[k] if x else UNKNOWN for k, x in zip(best.tolist(), ok.tolist())]
                    scores = np.where(ok, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                else:
                    names, scores = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
