"""Words, BPE and token counts against brute force and the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from gridspan.llm import bpe, token_count
from gridspan.llm import text as T

ODD = "ab cd\n\t'sdlm.,!? #é ß　Ⅷ²9 0\x85\xa0\r 日本"


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    return made + ["", " ", "\n \n", "a<|endoftext|>b <|endoftext|>", "x" * 3000, "I'm 'll they're", "the the the", " lead", "tail "]


def slices(values):
    batch = pa.record_batch([pa.array(values, pa.string())], names=["text"])
    return [(d, o) for _, _, d, o in T.chunks(batch, size=500)]


def test_words_match_the_pattern():
    got = [w.word(k).decode() for d, o in slices(texts()) for w in [T.words_of(d, o)] for k in range(len(w.starts))]
    assert got == [x for t in texts() for x in regex.findall(r"[^\x20\x09-\x0D]+", t)]


def test_equal_words_have_equal_hashes_and_others_not():
    d, o = slices(["one two one", "two three one"])[0]
    h = T.words_of(d, o).hashes().tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h)) == 3


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def encoded(values):
    out, back, b = [], [], bpe.load(bpe.default_vocabulary())
    for d, o in slices(values):
        ids, n = b.encode_slice(d, o)
        ends = np.cumsum(n)
        out += [ids[x:y].tolist() for x, y in zip(ends - n, ends)]
        back += b.decode_slice(ids, n)
    return out, back


def test_bpe_matches_the_library(library):
    want = [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    got, back = encoded(texts())
    assert got == want
    assert back == library.decode_batch(want, skip_special_tokens=False) == texts()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_bpe_of_any_text(values):
    want = [e.ids for e in Tokenizer.from_file(bpe.default_vocabulary()).encode_batch(values, add_special_tokens=False)] if values else []
    assert encoded(values)[0] == want


def test_decoding_broken_and_unknown_ids():
    b = bpe.load(bpe.default_vocabulary())
    half = b.vocab[b"\xc3"]
    assert b.decode_slice(np.array([half, -5, 10**6], dtype=np.int32), np.array([3])) == ["�"]


SPACED = ["hello      world", "a    b", "  two  lead", " " * 40, "x<s>y </s> <unk> <0x41>", "▁mark  ▁▁ and▁ ▁", "a" + " " * 17 + "b", "▁", "tail   "]


def plain_counter(vocab, special, fallback, text):
    """(pieces, score) by dynamic programming over every piece at every place of the whole text."""
    pieces, low = {p: s for p, s in vocab if p not in special}, min(s for _, s in vocab) - 10.0
    text = text.replace(" ", "▁")
    text = text if text.startswith("▁") or not text else "▁" + text
    best = [(0.0, 0, False)]
    for end in range(1, len(text) + 1):
        top = None
        for begin in range(max(0, end - 40), end):
            s, n, _ = best[begin]
            if text[begin:end] in pieces and (top is None or s + pieces[text[begin:end]] > top[0]):
                top = (s + pieces[text[begin:end]], n + 1, False)
        if text[end - 1] not in pieces:
            s, n, unknown = best[end - 1]
            if top is None or s + low > top[0]:
                top = (s + low, n + (len(text[end - 1].encode()) if fallback else not unknown), True)
        best.append(top)
    return best[-1][1], best[-1][0]


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_match_the_library_and_a_plain_version(fallback):
    vocab, special = token_count.read_vocabulary(token_count.default_vocabulary())
    values = texts() + SPACED
    counter = token_count.UnigramCounter(vocab, fallback, special)
    got = [x for d, o in slices(values) for x in zip(*(c.tolist() for c in counter.count_slice(d, o)))]
    plain = [plain_counter(vocab, special, fallback, t) for t in values]
    assert [n for n, _ in got] == [n for n, _ in plain]
    assert np.allclose([s for _, s in got], [s for _, s in plain], rtol=1e-12)
    # the library segments the whole text; its control pieces are renamed so that no text spells them
    names = [(p if p not in special or p.startswith("<0x") else f"\U0010ff00{p}", s) for p, s in vocab]
    lib = Tokenizer(models.Unigram(names, 0, fallback))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    some = [k for k, t in enumerate(values) if "<0x" not in t]
    assert [got[k][0] for k in some] == [len(e.ids) for e in lib.encode_batch([values[k] for k in some], add_special_tokens=False)]


def test_token_counts_of_a_vocabulary_with_inner_marks():
    vocab = [("▁", -2.0), ("a", -1.5), ("b", -1.5), ("a▁b", -1.0), ("▁a", -2.5)]
    counter = token_count.UnigramCounter(vocab, False)
    values = ["a b", "aa  b", "", "b a", "a b a b"]
    got = [x for d, o in slices(values) for x in zip(*(c.tolist() for c in counter.count_slice(d, o)))]
    assert got == [plain_counter(vocab, (), False, t) for t in values]
    assert token_count.UnigramCounter([], False).count("▁ab") == (1, -30.0)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = bpe.default_vocabulary()
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"]), r["text"]) for r in got) == [(0, 2, "a b"), (1, 0, ""), (2, 0, ""), (3, 2, "a b"), (3, 2, "a b")]
    both = bpe.round_trip(df, path).collect()
    assert sorted(map(tuple, both), key=str) == sorted(map(tuple, got), key=str)
    counts = token_count.count_tokens(df, token_count.default_vocabulary()).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in counts) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert bpe.encode(df.limit(0), path).count() == token_count.count_tokens(df.limit(0), token_count.default_vocabulary()).count() == 0
