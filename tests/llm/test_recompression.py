"""Repeated runs of words against comparison of all windows."""

import hashlib
import random

import numpy as np
import pytest

from quadrat.llm import recompression as R


def brute(docs, size=R.WINDOW):
    """doc rows -> (doc, n_words, n_removed, sha256), window by window."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in split:
        for at in range(len(w) - size + 1):
            key = tuple(w[at:at + size])
            first[key] = min(first.get(key, (1, 0)), (i is None, i or 0))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for at in range(len(w) - size + 1):
            if first[tuple(w[at:at + size])] < (i is None, i or 0):
                gone[at:at + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, alphabet):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(alphabet), rng.randrange(alphabet))}"
    make = lambda n: [word() for _ in range(n)]
    passages = [make(rng.randint(40, 140)) for _ in range(6)] + [["a"] * 120, ["a", "b"] * 60, make(7) * 15, make(3) * 30 + ["z"] * 9]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            text += rng.choice([make(rng.randint(0, 60)), p, p[cut[0]:cut[1]], p[:cut[1]], p + ["a"] * rng.randint(0, 30)])
        docs.append((i, "  ".join(text)))
    docs += [(70 + i, docs[5 + i % 3][1]) for i in range(12)]
    return docs


@pytest.mark.parametrize("seed,alphabet", [(1, 400), (2, 3), (3, 2)])
def test_equals_all_windows(spark, seed, alphabet):
    docs = corpus(seed, alphabet)
    random.Random(seed).shuffle(docs)
    got = R.remove_repeated_words(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(80))
    docs = [(3, long), (3, long), (1, None), (2, ""), (None, long), (9, long + " tail"), (4, "x"), (5, " ".join(["k"] * 20_000)), (6, " ".join(["k"] * 60))]
    rows = [(i, t, 7, "h", [1]) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, h1 int, doc string, runs array<int>")
    got = R.remove_repeated_words(frame)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)
    assert R.remove_repeated_words(frame.limit(0)).collect() == []


@pytest.mark.parametrize("alphabet", [2, 3, 50])
def test_equal_windows_are_filed_alike(alphabet):
    """The symbol a window is filed under depends on its words alone."""
    rng = np.random.default_rng(alphabet)
    for _ in range(30):
        window = rng.integers(1, alphabet + 1, 50).astype(np.uint64)
        if rng.random() < 0.5:
            window = np.tile(window[:rng.integers(1, 9)], 50)[:50]
        seen = set()
        for _ in range(8):
            around = [rng.integers(1, alphabet + 1, rng.integers(0, 70)).astype(np.uint64) for _ in range(2)]
            if rng.random() < 0.3:
                around = [np.tile(window[:3], 20), np.tile(window[-2:], 20)]
            words = np.concatenate([around[0], window, around[1]])
            of, first, count, key, *_ = R.filed(words, np.zeros(len(words), np.int64))
            at = len(around[0])
            seen.add(int(key[(first <= at) & (at < first + count)][0]))
        assert len(seen) == 1
