"""Mixing against a plain version: targets by sharing again and again, multipliers by halving, copies document by document."""

import itertools
import math
import random
import re

import pytest

from gridspan.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(seed, n, sources):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        words = min(2000, int(rnd.lognormvariate(3, 1.2)))
        text = rnd.choice([" ", "\t", "\x0b", "  \n"]).join(f"w{rnd.randrange(50)}" for _ in range(words))
        rows.append((k, text, rnd.choice(sources)))
    return rows


def plain_targets(own, weights, most):
    order = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in own if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, free = dict.fromkeys(own, 0.0), float(sum(own.values())), set(own)
    while free and left > 1e-9:
        share, whole = left, sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            out[s] += share * weight[s] / whole
            if out[s] >= most * own[s]:
                left += out[s] - most * own[s]
                out[s] = float(most * own[s])
                free.discard(s)
    return out


def plain_theta(sizes, mean, target, most):
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(n * min(most, math.exp(min(mid * n / mean, 64))) for n in sizes) < target:
            lo = mid
        else:
            hi = mid
    return lo


def plain_copies(rows, target):
    """Copies of the rows (rate, size, draw) of a source."""
    copies = [math.floor(r) for r, _, _ in rows]
    left = round(target - sum(c * n for c, (_, n, _) in zip(copies, rows)))
    place = [(d / (r % 1)) / (1 + d / (r % 1)) if r % 1 and n else None for r, n, d in rows]
    for share in (None, 1 / 8, 1):
        fit = [k for k, p in enumerate(place) if p is not None and (share is None or rows[k][1] <= left * share)]
        room = left
        for _, group in itertools.groupby(sorted(fit, key=lambda k: place[k]), key=lambda k: place[k]):
            group = list(group)
            need = sum(rows[k][1] for k in group)
            if need > room or left <= 0:
                break
            room -= need
            for k in group:
                copies[k] += 1
                place[k] = None
        left = room
    near = [(abs(n - left), p) for (_, n, _), p in zip(rows, place) if p is not None and abs(n - left) < left]
    if near:
        for k, p in enumerate(place):
            copies[k] += p == min(near)[1]
    return copies


@pytest.mark.parametrize("seed,n,sources", [(1, 300, ["a", "b", "c", "d", None]), (2, 200, ["é", "z", "Z", "\U0001f600", "￿"]), (3, 150, ["a"] * 30 + ["b"])])
def test_equals_plain_version(spark, seed, n, sources):
    docs = corpus(seed, n, sources) + [(9001, None, "a"), (9002, "", "b"), (9003, " \t\n", None), (9004, "x", "z"), (None, "one two", "a"), (7, "same", "a"), (7, "same", "a")]
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs)
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, size[i, t]) for i, t, _ in docs)
    own = {s: sum(size[i, t] for i, t, x in docs if x == s) for s in {d[2] for d in docs}}
    want = plain_targets(own, (5, 2, 1), 3)
    for s in own:
        rows = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == own[s] and math.isclose(r["target"], want[s], rel_tol=1e-9) for r in rows)
        sizes = [r["size"] for r in rows]
        mean = sum(x * x for x in sizes) / max(sum(sizes), 1)
        if want[s] < 3 * own[s] * (1 - 1e-9):
            theta = plain_theta(sizes, mean, want[s], 3)
            assert all(math.isclose(r["rate"], min(3, math.exp(theta * r["size"] / mean)), rel_tol=1e-4) for r in rows)
        assert [r["copies"] for r in rows] == plain_copies([(r["rate"], r["size"], r["draw"]) for r in rows], want[s])
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
        rest = [r["size"] for r in rows if r["rate"] % 1]
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= max([1, *rest])


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = spark.createDataFrame(corpus(5, 400, ["a", "b", "b", "b", "c"]), SCHEMA)
    once = sorted(map(tuple, mixing.mix(docs).collect()))
    assert once == sorted(map(tuple, mixing.mix(docs.repartition(7, "text")).collect()))


def test_sources_at_their_limit_give_all_copies(spark):
    docs = [(k, "w " * 10, "a") for k in range(2)] + [(100 + k, "w " * 10, "b") for k in range(200)]
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    assert all(r["copies"] == 3 and r["taken"] == 30 and r["target"] == 60 for r in got if r["source"] == "a")
    assert sum(r["taken"] for r in got if r["source"] == "b") == 202 * 10 - 60


def test_empty_texts_and_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, " ", "a")], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_own_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(k, "w " * (k + 1), "ab"[k % 2], 5, "x") for k in range(20)], "key string, body string, origin string, size int, target string")
    got = mixing.mix(docs, (1, 1), 2, "key", "body", "origin").collect()
    assert sorted(r["size"] for r in got) == list(range(1, 21)) and all(r["copies"] <= 2 for r in got)
    assert got[0].__fields__[:2] == ["key", "origin"]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(corpus(6, 50, ["a", "b"]), SCHEMA)
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
