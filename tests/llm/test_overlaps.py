"""Decontamination against a plain comparison of every window: spans, items and equal words."""

import random
import re

import pytest

from gridspan.llm import decontaminate, warc

SPAN, MISSES = decontaminate.SPAN, decontaminate.MISSES


def words(text):
    return [w for w in re.split(r"[\x00-\x20!-/:-@\[-`{-~\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain(docs, items, least):
    out = []
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            if item is None or not b:
                continue
            if len(b) < SPAN:
                if len(b) >= least:
                    out += [(d, i, s, s + len(b), 0, len(b), len(b)) for s in range(len(a) - len(b) + 1) if a[s : s + len(b)] == b]
                continue
            hits = {}
            for s in range(len(a) - SPAN + 1):
                for t in range(len(b) - SPAN + 1):
                    if sum(x != y for x, y in zip(a[s : s + SPAN], b[t : t + SPAN])) <= MISSES:
                        hits.setdefault(s - t, []).append(s)
            for shift, at in hits.items():
                runs = [[at[0], at[0]]]
                for s in at[1:]:
                    if s > runs[-1][1] + SPAN:
                        runs.append([s, s])
                    runs[-1][1] = s
                for lo, hi in runs:
                    end = hi + SPAN
                    out.append((d, i, lo, end, lo - shift, sum(a[k] == b[k - shift] for k in range(lo, end)), len(b)))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "日本", "x1"]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(n))) for k, n in enumerate((3, 8, 12, SPAN, SPAN + 1, 30, 60, 60))] + [(90, None), (91, "... !"), (92, "")]
    items.append((93, items[5][1]))
    docs = []
    for k in range(40):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 50))]
        for _ in range(rnd.randrange(3)):
            part = words(rnd.choice(items)[1])
            lo = rnd.randrange(0, max(1, len(part) - SPAN + 1))
            part = part[lo : lo + rnd.choice([SPAN - 1, SPAN, SPAN + 5, 60])]
            for p in range(len(part)):
                if rnd.random() < 0.07:
                    part[p] = rnd.choice(vocabulary)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in text)))
    return docs + [(100, None), (101, ""), (102, docs[0][1])], items


@pytest.mark.parametrize("seed,least,block", [(1, 1, 500_000), (2, decontaminate.MIN_WORDS, 500_000), (3, 1, 60)])
def test_overlaps_equal_a_plain_comparison(spark, monkeypatch, seed, least, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = corpus(seed)
    got = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=least)
    want = plain(docs, items, least)
    assert want and sorted(map(tuple, got.collect())) == want


def test_archives_with_digests_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    pages = spark.createDataFrame([(k, f"http://a/{k}", "x" * 200 if k % 5 == 0 else f"{k} " * 100 if k % 3 else f"{k // 6} " * 100) for k in range(40)], "page_id long, url string, html string")
    few = {r["page_id"]: (r["first"]) for r in warc._roles(pages, "page_id", "html", "url").collect()}
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 1000)
    assert few == {r["page_id"]: (r["first"]) for r in warc._roles(pages, "page_id", "html", "url").collect()} and few[5] == 0
