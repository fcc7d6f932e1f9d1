"""Classifier and language network against plain versions, document by document."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridspan.llm import language, quality
from gridspan.llm import text as T

TEXTS = ["Plain prose, with a few words.\nAnd a line.", "", None, "$$$ buy NOW!!! $$$ buy NOW!!!", "a a a a b b b b a a a a", "x\n" * 30, "Ünïcode — здесь тоже буквы", "\x00\x01 tab\there", "word " * 400, "same line\nsame line\nsame line\n"]


def plain_features(text):
    data = (text or "").encode()
    out = [0.0] * quality.N_PAIRS
    kind = [int(quality._CLASS[b]) for b in data]
    for a, b in zip(kind, kind[1:]):
        out[a * quality.N_CLASSES + b] += 1
    total = max(1, len(kind) - 1)
    out = [math.sqrt(x / total) for x in out]
    words = (text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    seen = lambda xs: (len(xs) - len(set(xs))) / max(1, len(xs))
    grams = [tuple(words[k : k + 4]) for k in range(len(words) - 3)]
    lines = (text or "").split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    extra = [sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), seen(words), seen(grams), seen(lines)]
    terms = [0.0] * quality.N_TERMS
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        terms[int(T.words_of(raw, np.array([0, len(raw)])).hashes()[0]) >> (64 - quality.TERM_BITS)] += 1
    terms = [math.log1p(x) for x in terms]
    length = max(1.0, math.sqrt(sum(x * x for x in terms)))
    return out[: -quality.N_EXTRA] + [math.sqrt(x) for x in extra] + [x / length for x in terms]


def corpus():
    rnd = random.Random(3)
    made = [" ".join(rnd.choice(["alpha", "Beta", "12", "!!", "gamma,", "x\ny"]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    return [(k, t, "x") for k, t in enumerate(TEXTS + made + made[:20])]


def test_features_match_a_plain_version():
    values = [t for _, t, _ in corpus()]
    batch = pa.record_batch([pa.array(values, pa.string())], names=["text"])
    got = np.concatenate([quality.features(d, o) for _, _, d, o in T.chunks(batch, size=300)])
    assert np.allclose(got, [plain_features(t) for t in values], atol=1e-6)


def test_scores_match_a_plain_vote(spark):
    rows = corpus()
    labels = [(k, int("$" in (t or "") or k % 3 == 0)) for k, t, _ in rows if k % 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    taught = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5]
    assert len(model.labels) == len(taught) and model.labels.tolist() == [y for _, y in sorted(taught)]
    text = {k: t for k, t, _ in rows}
    x = np.array([plain_features(text[k]) for k, _ in sorted(taught)])
    z = lambda f: ((np.asarray(f) * model.weight - model.mean) @ model.basis).astype(float)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    known = [unit(z(f)) for f in x]
    for k, t, _ in rows:
        mine = unit(z(plain_features(t)))
        cos = [float(np.dot(mine, v)) for v in known]
        order = sorted(range(len(cos)), key=lambda j: (-round(cos[j], 5), j))[: model.k]
        w = [max(cos[j], 1e-6) ** quality.POWER for j in order]
        want = sum(a * model.labels[j] for a, j in zip(w, order)) / sum(w)
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        tied = len({round(cos[j], 5) for j in order}) < len(order) or abs(sorted(cos)[-model.k] - sorted(cos)[-model.k - 1]) < 1e-4
        assert abs(got[k]["score"] - want) < (0.2 if tied else 1e-3)


def test_ties_among_neighbours_go_to_the_earlier_row():
    m = quality.Neighbours(np.ones(2, np.float32), np.zeros(2, np.float32), np.eye(2, dtype=np.float32), np.array([[1, 0]] * 4 + [[0, 1]], np.float32), np.array([1, 1, 0, 0, 0], np.float32), 2)
    assert m.score(np.array([[5, 0]], np.float32)).tolist() == [1.0]
    m.k = 3
    assert abs(m.score(np.array([[5, 0]], np.float32))[0] - 2 / 3) < 1e-6


def plain_states(net, data, way):
    """States of one direction, byte by byte."""
    h = language.HIDDEN
    w, u, c = (net.p[k + way].astype(float) for k in "wuc")
    state, out = np.zeros(h), {}
    for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
        a, b = w[data[t]], state @ u
        z, r = 1 / (1 + np.exp(-(a[:h] + b[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + b[h : 2 * h])))
        n = np.tanh(a[2 * h :] + r * (b[2 * h :] + c))
        state = (1 - z) * n + z * state
        out[t] = state
    return out


def plain_language(net, text):
    data = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    total = np.zeros(len(net.languages))
    for lo in range(0, len(data), language.PIECE):
        piece = data[lo : lo + language.PIECE]
        padded = piece.ljust(language.PIECE, b"\0")
        f, b = plain_states(net, padded, "f"), plain_states(net, padded, "b")
        for t in range(len(piece)):
            y = np.concatenate([f[t], b[t]]) @ net.p["o"] + net.p["d"]
            y = np.exp(y - y.max())
            total += y / y.sum()
    total /= len(data)
    return net.languages[int(total.argmax())], float(total.max())


def test_languages_match_a_plain_network(spark):
    net = language.Network(["aa", "bb", "cc"])
    rows = [(k, t, "zz") for k, t in enumerate(TEXTS)] + [(50, TEXTS[0], "zz"), (51, TEXTS[6] * 9, "zz")]
    for parts in (1, 4):  # what follows a document in its batch does not matter
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").repartition(parts)
        got = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language.identify(docs, net).collect()}
        for k, t, _ in rows:
            name, score = plain_language(net, t)
            assert got[k][0] == name and abs(got[k][1] - score) < 1e-4 and got[k][2] == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_repeated_rows_are_predicted_alike(spark):
    net = language.Network(["aa", "bb"])
    docs = spark.createDataFrame([(7, "some text")] * 30 + [(8, "some text")], "doc_id long, text string").repartition(5)
    assert language.identify(docs, net).select("lang_pred", F.round("score", 6)).distinct().count() == 1
    assert language.identify(docs.limit(0), net).count() == 0


def test_vectors_tell_topics_by_their_words():
    """Texts of the same shape whose words differ: the label hangs on terms alone."""
    rnd = random.Random(5)
    topics = [[f"{c}{x}{y}" for x in "abcdefgh" for y in "ijklmn"] for c in "pq"]
    made = [(" ".join(rnd.choice(topics[k % 2]) for _ in range(40)), k % 2) for k in range(300)]
    x = np.array([plain_features(t) for t, _ in made], np.float32)
    y = np.array([k for _, k in made], float)
    got = quality.Neighbours.fit(x[:200], y[:200]).score(x[200:])
    assert ((got >= 0.5) == y[200:]).mean() > 0.95
