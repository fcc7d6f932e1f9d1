"""Each operator against a brute-force version on small tables, and on odd rows."""

import gzip
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.llm import components, decontaminate, jaccard, language, quality, substring, topk, url_filter, warc

WORDS = [f"w{k}" for k in range(60)]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    base = [[rnd.choice(WORDS) for _ in range(rnd.randint(1, 60))] for _ in range(n // 3)]
    docs = []
    for k in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        if rnd.random() < 0.3:
            words += rnd.choice(base)
        docs.append((k, " \n".join(words) if rnd.random() < 0.5 else " ".join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "w1"), (n + 4, "w1"), (n + 5, "w1 w2 w3"), (n + 6, "same " * 40), (n + 7, "same " * 41)]


def brute_removed(docs):
    first = {}
    words = {i: (t or "").split() for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    docs = corpus(seed)
    got = substring.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_removed(docs)


def test_prefix_groups_split_by_longer_prefixes():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 3, 500)
    starts, ids = np.arange(480), rng.integers(0, 50, 480)
    want = substring.repeated(codes, starts, ids)
    assert (substring.repeated(codes, starts, ids, limit=5) == want).all()
    groups = list(substring.prefix_groups(codes, starts, limit=5))
    assert sorted(np.concatenate([g for g, _ in groups]).tolist()) == starts.tolist()
    assert all(len({tuple(codes[s : s + d]) for s in starts[g]}) == 1 for g, d in groups)
    brute = {}
    for s, i in zip(starts, ids):
        brute.setdefault(tuple(codes[s : s + 13]), []).append(i)
    assert want.tolist() == [i > min(brute[tuple(codes[s : s + 13])]) for s, i in zip(starts, ids)]


def test_substring_odd_rows(spark):
    long = " ".join(WORDS[:20])
    rows = [(None, long, 1), (None, long, 1), (5, long, 1), (5, long, 2), (7, long + " tail", 3), (-3, long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring.dedup_substrings(df).collect()), key=str)
    assert got == sorted([(None, 0), (None, 0), (5, 20), (5, 20), (7, 20), (-3, 0)], key=str)
    assert substring.dedup_substrings(df.limit(0)).count() == 0


def brute_classes(docs):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed,frequent", [(1, 1024), (3, 2)])
def test_jaccard_join(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FREQUENT_SHARE", 1.0)
    docs = corpus(seed, 90)
    got = jaccard.similarity_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(docs)


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(None, None), (1, 1), (1, 1), (2, 1), (3, 3)], key=str)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(e).collect()}
    assert got == {**{k: 0 for k in range(21)}, 30: 30, 31: 30}


def test_spaced_seeds_find_all_pairs_of_substitutions():
    rnd = random.Random(2)
    item = [rnd.choice(WORDS) + str(k) for k in range(13)]
    seeds = decontaminate.Seeds([" ".join(item)])
    for i in range(13):
        for j in range(13):
            words = list(item)
            words[i] = words[j] = "zzz"
            raw = np.frombuffer(("before " + " ".join(words) + " after").encode(), dtype=np.uint8)
            assert [x[:2] for x in seeds.overlaps(raw, np.array([0, len(raw)]))] == [(0, 0)]
    words[0], words[5], words[9] = "q", "r", "s"
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    assert seeds.overlaps(raw, np.array([0, len(raw)])) == []


def test_decontamination(spark, monkeypatch):
    item = " ".join(f"b{k}" for k in range(30))
    docs = [(1, f"x y {item}, z", 0), (2, "clean text " * 20, 0), (3, item.upper().replace("B9 ", "no "), 0), (None, item, 0), (5, None, 0), (6, "tiny item", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item), (11, "tiny item"), (12, None), (13, "...")], "item_id long, text string")
    want = [("1", 10, 2, 32, 30), ("3", 10, 0, 30, 29), ("6", 11, 0, 2, 2), ("None", 10, 0, 30, 30)]
    for words in (decontaminate.BLOCK_WORDS, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = sorted((str(r["doc_id"]), r["item_id"], r["start_word"], r["end_word"], r["equal_words"]) for r in decontaminate.find_overlaps(df, bench, min_words=1).collect())
        assert got == want
    assert decontaminate.find_overlaps(df, bench).filter("item_id = 11").count() == 0
    assert decontaminate.find_overlaps(df, bench.limit(0)).count() == decontaminate.find_overlaps(df.limit(0), bench).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((400, 16)) * rng.uniform(0.1, 3, (400, 1))
    v[7] = v[3]
    rows = [(int(k), [float(x) for x in np.float32(v[k])]) for k in range(400)] + [(400, None), (401, [None] + [0.0] * 15), (402, [float("nan")] * 16), (500, [1.0]), (None, [0.0] * 16), (3, [float(x) for x in np.float32(v[3])])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    e = np.floor(1024 * np.float32(v).astype(float))
    e, known = np.vstack([e, [[1024] + [0] * 15]]), [*range(400), 500]  # 500 is shorter
    want = set()
    for q in (0, 100, 200, 300, 400):
        s = e @ e[q]
        for r, k in enumerate([k for k in np.lexsort((np.arange(401), -s)) if k != q][:10]):
            want.add((known[q], r + 1, known[k], int(s[k])))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("block", [1, 16384])
def test_top_k_is_exact_beyond_doubles(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    v = rng.uniform(-3e5, 3e5, (60, 16))
    df = spark.createDataFrame([(int(k), [float(x) for x in v[k]], "x", False) for k in range(60)], "vec_id long, embedding array<double>, v string, query boolean")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    e = [[int(np.floor(1024 * x)) for x in row] for row in v]
    want = set()
    for q in (0, 20, 40):
        s = sorted((-sum(a * b for a, b in zip(e[q], e[k])), k) for k in range(60) if k != q)[:10]
        want |= {(q, r + 1, k, -score) for r, (score, k) in enumerate(s)}
    assert {tuple(r) for r in got} == want and max(r["score"] for r in got) > 2**53
    huge = spark.createDataFrame([(0, [1e200]), (1, [1e200])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(huge, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("copies", [2, 20])
def test_top_k_counts_a_repeated_id_once(spark, copies):
    rows = [(0, [1.0, 0.0])] + [(1, [20.0, 0.0])] * copies + [(k, [20.0 - k, 0.0]) for k in range(2, 15)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(k, k, 1024 * 1024 * (20 if k == 1 else 20 - k)) for k in range(1, 11)]


def test_url_filter(spark):
    urls = ["http://Example.COM/en/1?x", "https://www.example.com/en/", "http://a.net/es/b", "ftp://net/fr/", "http://notexample.com/en/", "http://x.net/de/", None, "no scheme", "http://a.com", "http://münchen.com/#/", "http://com./"]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame([(k, u, u) for k, u in enumerate(urls)], "page_id long, url string, host string"), url_filter.RULES).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    assert got == {
        urls[0]: ("example.com", "/en/1", "example.com/en/", "block"), urls[1]: ("www.example.com", "/en/", "www.example.com/en/", "allow"), urls[2]: ("a.net", "/es/b", "net/es/", "block"), urls[3]: ("net", "/fr/", "net/fr/", "block"),
        urls[4]: ("notexample.com", "/en/", "com/", "allow"), urls[5]: ("x.net", "/de/", None, "allow"), None: ("", "", None, "allow"), urls[7]: ("", "", None, "allow"), urls[8]: ("a.com", "", None, "allow"), urls[9]: ("münchen.com", "/", "com/", "allow"), urls[10]: ("com.", "/", None, "allow"),
    }
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), []).first()["verdict"] == "allow"


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: 7)
    path = str(tmp_path / "rules.bin")
    url_filter.write_digest_array([("a", "/", "allow"), ("b", "/", "block")], path)
    array = url_filter.DigestArray(path)
    found = array.find([b"a/", b"b/", b"c/"])
    assert [array.actions[r] if r >= 0 else -1 for r in found] == [0, 1, -1]


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/\r\nx", big, 1), (1, "http://b", big, 1), (2, None, None, 1), (4, "http://c", "", 1), (5, "http://d", "short", 1), (6, "http://d", "short", 1), (None, "http://e", big, 1), (7, "http://ü", "é\r\n\r\nWARC/1.1" * 30, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    from gridspan.llm.common import fresh_path

    base = fresh_path(spark, "warc-test")
    streams = warc.write_archives(pages, f"{base}/streams")
    members = warc.normalise(streams, f"{base}/members")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"] and bytes(r["payload"])) for r in warc.read_archives(members, base).collect()}
    n = len(big)
    assert got == {1: ("response", None, n, big.encode()), 3: ("revisit", 1, n, None), None: ("revisit", 1, n, None), 2: ("response", None, 0, b""), 4: ("response", None, 0, b""), 5: ("response", None, 5, b"short"), 6: ("response", None, 5, b"short"), 7: ("response", None, len(rows[7][2].encode()), rows[7][2].encode())}
    empty = warc.write_archives(pages.limit(0), f"{base}/none")
    assert warc.read_archives(warc.normalise(empty, f"{base}/none2"), base).count() == 0


def test_normaliser_on_one_stream():
    raw = [warc.record(k, f"http://{k}", b"p" * k, "d", None, False) for k in range(50)]
    out = io.BytesIO()
    entries = list(warc.normalise_stream(io.BytesIO(gzip.compress(b"".join(raw))), out))
    data = out.getvalue()
    assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in entries] == raw
    assert gzip.decompress(data) == b"".join(raw)
    with pytest.raises(ValueError):
        list(warc.normalise_stream(io.BytesIO(gzip.compress(b"".join(raw))[:-20]), io.BytesIO()))


def test_quality_held_out(spark):
    from gridspan.llm.common import table

    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = quality.score(docs, quality.learn(docs, labels)).filter("held_out").join(labels, "doc_id")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and r[1] > 500 and 0 <= r[2] <= r[3] <= 1


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(["good text here", None, "", "### $$$ %%%", "good text here"])] + [(None, "x", 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), quality.learn(docs, labels)).count() == 0


def test_language_forward_matches_training_forward():
    net = language.Network(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (5, 16)).astype(np.uint8)
    s = np.ascontiguousarray(x.T)
    y = np.concatenate([net._layer(s, "f"), net._layer(s, "b")], axis=2) @ net.p["o"] + net.p["d"]
    y = np.exp(y) / np.exp(y).sum(axis=2, keepdims=True)
    assert np.allclose(net.label(x), y.transpose(0, 2, 1), atol=1e-5)


def test_language_gradients_match_differences():
    net = language.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n, t = np.random.default_rng(1).integers(97, 103, (3, 6)).astype(np.uint8), np.array([6, 6, 4]), np.array([0, 1, 1])

    def loss():
        s = np.ascontiguousarray(x.T)
        y = np.concatenate([net._layer(s, "f"), net._layer(s, "b")], axis=2).astype(np.float64) @ net.p["o"] + net.p["d"]
        p = np.exp(y) / np.exp(y).sum(axis=2, keepdims=True)
        return -(np.log(p[:, np.arange(3), t]) * (np.arange(6)[:, None] < n)).sum() / n.sum()

    g = net.gradients(x, n, t)
    for name in ("of", "uf", "wb", "cf", "d", "o"):
        if name not in g:
            continue
        at = tuple(k // 2 for k in g[name].shape) if name not in ("wb",) else (int(x[0, 0]), 3)
        h = 1e-2
        net.p[name][at] += h
        up = loss()
        net.p[name][at] -= 2 * h
        down = loss()
        net.p[name][at] += h
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3


def test_language_held_out(spark):
    from gridspan.llm.common import table

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = language.identify(docs, language.learn(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None), (None, "abc", "en")], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, None).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0)}
    assert language.learn(odd.limit(0)) is None


def test_samples_have_every_language_and_each_id_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language.Network, "train", lambda self, x, n, t: seen.append(t))
    docs = [(k, "some words", f"l{k % 70:02}") for k in range(1400)] + [(4, f"row {k}", "l04") for k in range(500)]
    net = language.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert net.languages == [f"l{k:02}" for k in range(70)]
    assert np.bincount(seen[0]).max() <= 20
    monkeypatch.setattr(quality.Neighbours, "fit", classmethod(lambda cls, x, y: (x, y)))
    x, y = quality.learn(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int"))
    assert len(x) == len(y) <= 20


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_share_a_key(seed):
    """Sets of any size whose tokens are frequent, rare or both; every similar pair meets in some key."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    counts = jaccard.Counts.__new__(jaccard.Counts)
    counts.bits, counts.frequent = 26, 100
    often = dict(zip(pool.tolist(), (rng.random(len(pool)) < (0.2, 0.6, 0.9, 0.97, 1.0, 0.75)[seed]).tolist()))
    counts.of = lambda g: np.array([100 + x % 7 if often[x] else x % 90 for x in g.tolist()], np.uint8)
    sets = []
    for n in (1, 2, 3, 5, 8, 15, 16, 17, 60, 96, 128, 129, 250, 600):
        base = rng.choice(pool, n, replace=False)
        for _ in range(6):
            keep = base[rng.random(n) > rng.choice([0, 0.05, 0.12])]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, rng.integers(0, max(1, n // 5) + 1))])))
    sets = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    g = np.concatenate(sets)
    whole = np.array([int(s.sum()) for s in sets], np.uint64)
    key, doc, _, _ = jaccard.keys_of(g, n, whole, counts)
    held = [set(key[doc == d].tolist()) for d in range(len(sets))]
    assert all(len(k) <= 3 * len(s) + 2 for k, s in zip(held, sets))
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))]
    assert len(similar) > 40 and all(held[a] & held[b] for a, b in similar)
