"""The whole pipeline against a plain version of it on a small table."""

import random
import re
import uuid

from test_operators import WORDS, brute_classes, brute_removed, corpus
from tokenizers import Tokenizer

import corpus_pipeline
from gridspan.llm import bpe, quality

ITEM = [f"bench{k}" for k in range(20)]


def tables(spark, tmp_path):
    rnd = random.Random(9)
    docs = corpus(4, 60)
    leak = ITEM[:]
    leak[3] = leak[9] = "other"
    docs += [(200, "before " + " ".join(leak) + ", after"), (201, "short bench words bench1 bench2"), (202, "fox. " + " ".join(rnd.choice(WORDS) for _ in range(40)))]
    docs += [(300 + k, " ".join(rnd.choice(["buy", "now", "$$$", "!!!", "click", "http://x"]) for _ in range(30))) for k in range(12)]
    d = f"file://{tmp_path}/{uuid.uuid4().hex}"
    rows = [(i, t, "en", "web", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def leaked(text):
    w = [x for x in re.split(r"[\x00-\x20!-/:-@\[-`{-~\x7f]+", (text or "").lower()) if x]
    return any(sum(a != b for a, b in zip(w[i : i + 13], ITEM[j : j + 13])) <= 2 for i in range(len(w) - 12) for j in range(len(ITEM) - 12))


def brute(docs, good):
    kept = [(i, t) for i, t in docs if i in good]
    classes = brute_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    cut = brute_removed(kept)
    kept = [(i, cut[i][2] if cut[i][1] else t) for i, t in kept]
    kept = [(i, t) for i, t in kept if not leaked(t)]
    ids = Tokenizer.from_file(bpe.default_vocabulary()).encode_batch([t or "" for _, t in kept], add_special_tokens=False)
    return {i: e.ids for (i, _), e in zip(kept, ids)}


def test_pipeline_equals_plain_version(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.score(docs, quality.learn(docs, labels))
    good = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    assert not good & set(range(300, 312)) and len(good) >= 60
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], good)
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert 200 not in want and 201 in want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), d)
        assert out.schema.names == docs.schema.names and out.count() == 0
    assert corpus_pipeline.bpe_encoding(spark, docs.limit(0), d).count() == 0


def test_rows_that_repeat_an_id(spark, tmp_path):
    d = f"file://{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    leak = "x " + " ".join(ITEM)
    rows = [(1, a), (1, a), (2, a + " tail"), (2, b), (3, ""), (3, ""), (4, None), (4, None), (5, c), (5, leak), (None, a), (None, a), (None, leak)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, d)
    want = [(1, a), (2, b), (3, ""), (4, None), (5, c), (5, leak), (None, a), (None, a), (None, leak)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    clean = corpus_pipeline.benchmark_decontamination(spark, kept, d)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([r for r in want if r[1] != leak], key=str)
    last = corpus_pipeline.bpe_encoding(spark, clean, d).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in last), key=str) == sorted([(i, t or "") for i, t in want if t != leak], key=str)
