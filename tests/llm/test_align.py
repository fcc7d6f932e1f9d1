"""Alignment against a plain version that tokenizes whole texts and lists all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridspan.llm import align
from gridspan.llm.bpe import byte_alphabet

PATHS = align.default_vocabularies()
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(docs):
    a_tok, b_tok = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_tok.encode_special_tokens = True
    alphabet = byte_alphabet()
    groups = []
    for _, text in docs:
        groups.append([])
        if not text:
            continue
        a = a_tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()) for i in b_tok.encode(text) for p in [b_tok.id_to_piece(i)]]
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            continue
        ends = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        cuts, lo = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}), 0
        for hi in cuts:
            groups[-1].append(tuple([i for e, i in side if lo < e <= hi] for side in ends))
            lo = hi
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g in groups]
    count = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for g, x in zip(groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(n for p, n in x.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


HARD = [
    None, "", " ", "  ", "\n", "a ", " a", "a  b", "a\t  b", "a\n b\r\n\n  c", "x　 y", "x　y", "a\xa0 b\x85 c d  e  f  g", "it's 'll ''re", "mark ▁ here", "<s> </s> <unk> <0x41> <|endoftext|> x",
    "日本語のテキスト。中文文本没有空格 mixed 한국어", "ﬁ ﬀ １２３", "\0\1\x1c \x1f x", "é è à ô", "😀😀 😀a", "x" * 3000, "ab" * 2000, "語" * 2000, " ".join(["rare wörter"] * 50), "\U0001f600" * 300,
]


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["the", "and", "résumé", "naïve", "Straße", "3.14", "foo_bar", "(x+y)", "http://a.b/c?d=e", "国", "über", "don't", "...", "日本", "α", "zzzqj"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) + rnd.choice(["", " ", "\n", "."]) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes,pack_bytes", [(1 << 20, 32 << 20), (64, 300)])
def test_equals_plain_version(spark, monkeypatch, slice_bytes, pack_bytes):
    texts = HARD + corpus(1, 80) + corpus(1, 5) + HARD[-3:]
    docs = list(enumerate(texts))
    monkeypatch.setattr(align, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(align, "PACK_BYTES", pack_bytes)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[x] for x in FIELDS) for r in align.align(df, *PATHS)[0].collect()}
    for (i, t), want in zip(docs, plain(docs)):
        assert got[i] == want, (t or "")[:50]


def test_rows_that_repeat_an_id_and_null_ids(spark):
    docs = [(1, "one two"), (1, "one two"), (None, "one two"), (None, None), (1, "three")]
    got = align.align(spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n_a int, pack string"), *PATHS)[0].collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r["doc_id"], *(r[x] for x in FIELDS)) for r in got), key=key) == sorted(((i, *p) for (i, _), p in zip(docs, plain(docs))), key=key)


def test_empty_table_and_pairs(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "one")], "doc_id long, text string")
    _, pairs = align.align(df, *PATHS)
    assert sorted(r["count"] for r in pairs.collect()) == [1, 2] and all(r["best"] for r in pairs.collect())
    assert align.align(df.limit(0), *PATHS)[0].count() == 0
    assert align.align(df.filter("doc_id > 5"), *PATHS)[1].count() == 0


def test_string_ids_are_carried(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "key string, body string")
    got = {r["key"]: r["n_links"] for r in align.align(df, *PATHS, "key", "body")[0].collect()}
    assert got["b"] == 0 and got["a"] >= 2


def test_a_group_of_very_many_links(monkeypatch):
    """One group whose links are more than 32 bits can count."""
    al, n = align.load(*PATHS), 70_000
    a, b = [1] * (n - 1) + [2], [3] + [1] * (n - 1)  # ends of the two sides meet at the last byte only
    monkeypatch.setattr(al, "tokens", lambda units: ([a], [b], np.array([True])))
    monkeypatch.setattr(al, "len_a", np.array([0, 2, 3, 0]))
    monkeypatch.setattr(al, "len_b", np.array([0, 2, 0, 3]))
    pack = align.Pack(al)
    pack.add([b"x" * (2 * n + 1)])
    assert pack.stats[-1][0].tolist() == [n, n, 1, n * n]
    assert sorted(pack.times[-1].tolist()) == sorted([(n - 1) * (n - 1), n - 1, n - 1, 1])
