"""Hot groups, very long texts, clashing columns and empty tables: every path that small tables would not take by themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, brute_classes, brute_removed, corpus

from gridspan.llm import bpe, decontaminate, jaccard, language, quality, substring, token_count, url_filter, warc
from gridspan.llm.common import fresh_path


def crowded(seed):
    """Many near copies of one text, a passage and a line that many documents share, and exact copies."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(60)]
    passage = [f"p{k}" for k in range(30)]
    line = ["very", "common", "line", "of", "six", "words"]
    docs = []
    for k in range(40):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 2, 3])):
            words[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
        docs.append(words)
    for k in range(30):
        own = [rnd.choice(WORDS) for _ in range(rnd.choice([2, 4, 8, 20]))]
        at = rnd.randrange(len(own) + 1)
        docs.append(own[:at] + passage + own[at:])
    for k in range(20):
        docs.append([rnd.choice(WORDS) for _ in range(8)] + line + [rnd.choice(WORDS) for _ in range(8)])
    docs += [list(base)] * 6 + [passage + line] * 5 + [line] * 4
    rnd.shuffle(docs)
    return [(k, " ".join(w)) for k, w in enumerate(docs)]


def tight_jaccard(m, **more):
    small = dict(FREQUENT=2, FREQUENT_SHARE=1.0, GROUPED=8, HOT=4, MIN_SLOT_BITS=14, PACK_BYTES=600, BUCKET_BYTES=2000, BLOCK_TOKENS=200, BLOCK_ROWS=3, SKETCH_TOKENS=3000, TEXT_TOKENS=2000, BROADCAST_ROWS=0)
    for name, value in (small | more).items():
        m.setattr(jaccard, name, value)


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"GROUPED": 2, "FREQUENT": 0}), (3, {"HOT": 1 << 20, "GROUPED": 100}), (4, {"FREQUENT": 10**6})])
def test_jaccard_join_of_crowds(spark, monkeypatch, seed, more):
    tight_jaccard(monkeypatch, **more)
    docs = crowded(seed)
    rows = [(k, t, "x", 1) for k, t in docs]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string, component string, n int").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(docs) and len(got) == len(docs)


def test_jaccard_keeps_the_odd_corpus_in_tight_blocks(spark, monkeypatch):
    tight_jaccard(monkeypatch)
    docs = corpus(7, 90)
    got = jaccard.similarity_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(docs)


def test_links_are_similar_and_connect_the_classes(spark):
    docs = crowded(5)
    labels, links = jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string"))
    text = dict(docs)
    found = [(r["a"], r["b"]) for r in links.collect()]
    for a, b in found:
        pair = brute_classes([(0, text[a]), (1, text[b])])
        assert pair[1][1] == 0
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r["id"]: r["component"] for r in labels.collect()} == {i: find(i) for p in found for i in p}


@pytest.mark.parametrize("seed,hot", [(1, 3), (2, 30), (3, 10**9)])
def test_substring_dedup_of_crowds(spark, monkeypatch, seed, hot):
    for name, value in dict(HOT=hot, GROUP=5, MIN_SLOT_BITS=6, PACK_BYTES=1500, BUCKET_BYTES=3000, WORDS=40).items():
        monkeypatch.setattr(substring, name, value)
    docs = crowded(seed)
    rows = [(k, t, "x", 1, "y") for k, t in docs]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, mark string, at int, kept string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_removed(docs) and len(got) == len(docs)


def test_substring_query_has_the_digests_of_the_plain_version(spark, tmp_path):
    docs = crowded(6)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute_removed(docs).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op1_substring_dedup(spark, str(tmp_path)).collect()} == want


def test_words_are_compared_by_their_bytes(spark, monkeypatch):
    """Even if all words had one hash, trees would not confuse them."""
    monkeypatch.setattr(substring.T.Words, "hashes", lambda self: substring.np.zeros(len(self.starts), dtype=substring.np.uint64))
    known = substring.pa.array([b"a3", b"a4"], substring.pa.large_binary())
    docs = [(1, " ".join(f"a{k}" for k in range(20))), (2, " ".join(f"a{k if k != 7 else 'x'}" for k in range(20))), (3, " ".join(f"a{k}" for k in range(20)))]
    h = []
    for _, t in docs:
        raw = substring.np.frombuffer(t.encode(), dtype=substring.np.uint8)
        h.append(substring.T.words_of(raw, substring.np.array([0, len(raw)])))
    codes, _ = substring.coded([w.array() for w in h], known)
    first = substring.np.cumsum([0, *(len(w.starts) for w in h)])
    starts = substring.T.window_starts(first, substring.SPAN)
    got = substring.repeated(codes, starts, substring.np.repeat([1, 2, 3], 8))
    assert got.tolist() == [False] * 16 + [True] * 8


@pytest.fixture(scope="module")
def long_docs():
    rnd = random.Random(1)
    vocab = [f"{rnd.choice('abcdefgh')}{k}" for k in range(50000)]
    long = " ".join(rnd.choice(vocab) for _ in range(420_000))  # above the bytes that a task works on at once
    return [(1, long), (2, long + " and a tail of other words"), (3, "short text"), (4, "x" * 2_500_000)]


def test_very_long_texts(spark, long_docs):
    df = spark.createDataFrame(long_docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.dedup_substrings(df).drop("kept").collect()}
    assert got == {1: (420_000, 0), 2: (420_006, 420_000), 3: (2, 0), 4: (1, 0)}
    got = {r["doc_id"]: (r["n_shingles"] > 400_000, r["component_id"]) for r in jaccard.similarity_classes(df).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, 3), 4: (False, 4)}
    item = " ".join(long_docs[0][1].split(" ")[1000:1030])
    found = decontaminate.find_overlaps(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["equal_words"]) for r in sorted(found)] == [(1, 1000, 30), (2, 1000, 30)]
    assert quality.score(df, None).count() == language.identify(df, language.Network(["aa", "bb"])).count() == 4
    some = df.filter("doc_id > 2")
    assert token_count.count_tokens(some, token_count.default_vocabulary()).filter("n_tokens > 0").count() == 2
    back = bpe.decode(bpe.encode(df, bpe.default_vocabulary()), bpe.default_vocabulary()).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in back} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in long_docs}


def test_very_long_pages(spark):
    html = "<p>" + "y" * 3_000_000
    pages = spark.createDataFrame([(1, "http://a.com/" + "z" * 2_500_000, html, 1), (2, "http://b.com/", html, 1)], "page_id long, url string, html string, rule int")
    out = url_filter.filter_urls(pages, url_filter.RULES).select("page_id", "host", F.length("path").alias("n"), "rule").collect()
    assert sorted(map(tuple, out)) == [(1, "a.com", 2_500_001, "com/"), (2, "b.com", 1, "com/")]
    base = fresh_path(spark, "warc-long")
    members = warc.normalise(warc.write_archives(pages, f"{base}/streams"), f"{base}/members")
    got = warc.read_archives(members, base).select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(1, "response", None, len(html)), (2, "revisit", 1, len(html))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard.similarity_classes(docs).collect() == [] and [x.count() for x in jaccard.similar(docs)] == [0, 0]
    assert substring.dedup_substrings(docs).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, url_filter.RULES).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similarity_classes(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_repeated_rows_and_items(spark):
    item = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item), (1, item), (2, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    assert decontaminate.find_overlaps(docs, bench).count() == 4


def test_repeated_rows_have_their_marks_once(spark):
    """Rows that repeat an id and a text share one short list of marks, however many they are."""
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage)] + [(2, f"a b {passage} c d {passage} e")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring.dedup_substrings(df)
    assert {tuple(r) for r in out.collect()} == {(1, 20, 0, passage), (2, 45, 40, "a b c d e")} and out.count() == 501
    marks = substring.find_repeats(df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text"), 10_000)
    assert marks.groupBy("id", "mark").agg(F.size(F.collect_set(F.struct("at", "n"))).alias("n")).first()["n"] <= 4


def test_long_words_are_no_common_words(spark):
    rows = [(k, " ".join([f"{'x' * 2000}{j}" for j in range(30)] + ["short"] * 5)) for k in range(4)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert [w for w in substring.survey(df, 240_000).words.to_pylist()] == [b"short"]
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(df.withColumnRenamed("id", "doc_id")).collect()}
    assert got == {0: 0, 1: 35, 2: 35, 3: 35}


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    df = spark.createDataFrame([(1, f"x\n{passage}  y ", "l"), (2, f"\t{passage}\tz ", "m"), (3, None, "n"), (4, "", "o"), (None, " a  b ", "p")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["kept"], r["lang"]) for r in substring.dedup_substrings(df, carry=("lang",), as_is=True).collect()}
    assert got == {1: (f"x\n{passage}  y ", "l"), 2: ("z", "m"), 3: (None, "n"), 4: ("", "o"), None: (" a  b ", "p")}
