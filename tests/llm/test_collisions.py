"""Words whose bytes follow a structure on which simple hashes collide, and the shared folder of a session without one."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from gridspan.llm import bpe, decontaminate, jaccard, quality, token_count
from gridspan.llm import text as T


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("n", [8, 16, 32, 64, 65, 128, 1024, 2048, 4096])
def test_structured_words_have_hashes_of_their_own(n):
    words = [*thue_morse(n), "a" * n, "b" * n, "a" * (n - 1), "\0" * n, "\0" * (n + 1)]
    assert len(set(T.words_of(*buffers(words)).hashes().tolist())) == len(words)


def test_hash_of_a_word_does_not_depend_on_where_it_stands():
    words = ["", "x", "x" * 7, "x" * 8, "x" * 9, "y" * 64, "y" * 65, "z" * 1000]
    alone = [int(T.words_of(*buffers([w])).hashes()[0]) for w in words[1:]]
    assert T.words_of(*buffers([" \t ".join(words) + "  "])).hashes().tolist() == alone


def test_equal_compares_bytes():
    a, b = thue_morse(1024)
    w = T.words_of(*buffers([a + " x " + b]))
    v = T.words_of(*buffers([b + " x " + b + " xy"]))
    assert w.equal(np.array([0, 1, 2, 1]), v, np.array([0, 1, 2, 3])).tolist() == [False, True, True, False]


def test_bpe_keeps_structured_units_apart():
    from tokenizers import Tokenizer

    texts = list(thue_morse(2048))
    ids, n = bpe.load(bpe.default_vocabulary()).encode_slice(*buffers(texts))
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == want[0] and np.split(ids, np.cumsum(n)[:-1])[1].tolist() == want[1]


def test_token_count_keeps_structured_units_apart():
    texts = list(thue_morse(2048))
    counter = token_count.load(token_count.default_vocabulary(), True)
    both = counter.count_slice(*buffers(texts))
    assert [x.tolist() for x in both] == [[float(v) if k else int(v) for t in texts for v in counter.count_slice(*buffers([t]))[k].tolist()] for k in range(2)]


def test_decontamination_counts_equal_bytes_only():
    a, b = thue_morse(1024)
    rest = " ".join(f"w{k}" for k in range(decontaminate.SPAN - 1))
    found = decontaminate.Seeds([f"{a} {rest}"]).overlaps(*buffers([f"{b} {rest}"]))
    assert [x[5] for x in found] == [decontaminate.SPAN - 1]


def test_jaccard_does_not_link_structured_words(spark):
    a, b = thue_morse(1024)
    docs = spark.createDataFrame([(1, f"{a} w x y z"), (2, f"{b} w x y z"), (3, f"{b}  w x y z")], "doc_id long, text string")
    labels, _ = jaccard.similar(docs)
    assert {r["id"]: r["component"] for r in labels.collect()} == {2: 2, 3: 2}


def test_quality_features_tell_structured_lines_apart():
    a, b = thue_morse(1024)
    got = quality.features(*buffers([f"{a}\n{b}\n", f"{a}\n{a}\n"]))
    assert got[0, -1] == 0 and got[1, -1] > 0


def test_shared_folder_of_a_local_session_without_a_setting(tmp_path):
    """In a process of its own: the setting comes from the machine's configuration and cannot be taken back."""
    code = """
from gridspan.session import local_session
from gridspan.llm import common
spark = local_session("2", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = common.shared_dir(spark)
assert first == common.shared_dir(spark)
assert common.written(spark.range(5), "numbers").count() == 5
print("fine")
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
