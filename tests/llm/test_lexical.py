"""Ranked search against the SQL and a plain version, on hard texts, ties and small packs and clusters."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridspan.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_all = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(200)] + ["Éa", "éa", "日本", "don't", "x_y", "A1", "a1", "ſ", "İ"]
    docs = []
    for k in range(n):
        topic = rnd.randrange(5) * 40
        docs.append((k, rnd.choice([" ", ", ", "\n", "\x00"]).join(rnd.choice(words[topic : topic + 40] if rnd.random() < 0.7 else words) for _ in range(rnd.randrange(0, 60)))))
    docs += [(n + k, docs[3][1]) for k in range(30)] + [(5000, None), (5001, ""), (5002, "... !!"), (5003, "w1 " * 5000), (7, docs[3][1]), (7, docs[3][1]), (None, docs[3][1]), (None, "w2")]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12)))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "?!"), (103, docs[3][1]), (104, "unknown terms only here"), (3, "w5 w6"), (None, "w7")]
    rnd.shuffle(docs)
    return docs, items


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("leaf,pack_bytes,slice_bytes", [(96, 16 << 20, 1 << 20), (4, 3000, 200)])
def test_equals_plain_version(spark, monkeypatch, leaf, pack_bytes, slice_bytes):
    for name, x in (("LEAF", leaf), ("PACK_BYTES", pack_bytes), ("SLICE_BYTES", slice_bytes)):
        monkeypatch.setattr(lexical, name, x)
    docs, items = corpus(1, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items), key=key)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)
    docs, items = corpus(2, 80)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items, 3), key=key)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two", 1, "x"), ("a", "one two", 2, "y")], "name string, body string, score int, rank string")
    items = spark.createDataFrame([("q", "two three", 9)], "ask string, words string, id int")
    got = lexical.search(docs, items, 10, "name", "body", "ask", "words")
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert lexical.search(docs.limit(0), items, 10, "name", "body", "ask", "words").count() == 0
    assert lexical.search(docs, items.limit(0), 10, "name", "body", "ask", "words").count() == 0


def test_bisection_brings_documents_of_the_same_terms_together():
    rnd = random.Random(3)
    topic = [rnd.randrange(4) for _ in range(256)]
    doc = np.repeat(np.arange(256), 8)
    term = np.array([t * 50 + rnd.randrange(50) for t in topic for _ in range(8)])
    order, bounds = lexical.bisect(doc, term, 256, 64)
    assert sorted(order.tolist()) == list(range(256)) and bounds.tolist() == [0, 64, 128, 192, 256]
    same = [Counter(topic[d] for d in order[lo:hi]).most_common(1)[0][1] / 64 for lo, hi in zip(bounds, bounds[1:])]
    assert sum(same) / 4 > 0.8


@pytest.mark.parametrize("n", [0, 1, 2, 3, 97, 1000])
def test_bisection_of_any_size(n):
    order, bounds = lexical.bisect(np.zeros(0, np.int64), np.zeros(0, np.int64), n, 5)
    assert sorted(order.tolist()) == list(range(n)) and bounds[0] == 0 and bounds[-1] == n and (n == 0 or np.diff(bounds).max() <= 5)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical.T.Words, "hashes", lambda self: np.zeros(len(self.starts), np.uint64))
    items = lexical.Items([1, 2], ["one two", "two three"])
    raw = b"three one one four two"
    w = lexical.normal_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    doc, term, n = items.postings(w)
    names = {int(items.term[k]): items.words.word(int(items.place[k])) for k in range(items.n_terms)}
    assert {names[t]: c for t, c in zip(term.tolist(), n.tolist())} == {b"one": 2, b"two": 1, b"three": 1}


def test_whole_clusters_are_passed_over(spark, monkeypatch):
    """On documents of separate topics most clusters are never visited."""
    monkeypatch.setattr(lexical, "LEAF", 8)
    rnd = random.Random(4)
    texts = [" ".join(f"t{k % 16}x{rnd.randrange(20)}" for _ in range(20)) for k in range(512)]
    items = lexical.Items([0], ["t3x1 t3x2 t3x3"])
    raw = [t.encode() for t in texts]
    w = lexical.normal_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    doc, term, _ = items.postings(w)
    order, bounds = lexical.bisect(doc, term, 512)
    place = np.argsort(order)
    assert len(set(np.searchsorted(bounds, place[doc], side="right").tolist())) <= (len(bounds) - 1) / 4
