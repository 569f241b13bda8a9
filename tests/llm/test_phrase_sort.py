"""Collocations against counting every phrase in a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quadrat.llm import phrase_sort as P


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for words in pieces(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang, tuple(words[i:i + k])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in candidates.items():
        for length in range(2, len(w)):
            for i in range(len(w) - length + 1):
                inner = (lang, w[i:i + length])
                if 100 * a >= 100 * candidates[inner]:
                    covered.add(inner)
    rows = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in covered:
            cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, " ".join(w), a, f[lang, w[:cut[1]]], f[lang, w[cut[1]:]], n[lang], cut[0]))
    out = []
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ÀB", "漢字", "Ab", "ab", "a b", "🙂"]
    fixed = [["new", "York", "city"], ["of", "the"], ["a", "b", "c", "d", "e", "f", "g"], ["x", "x"]]
    docs = []
    for i in range(200):
        text = ""
        for _ in range(rng.randint(0, 12)):
            some = rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 6))]
            text += rng.choice([" ", "\t", "  "]).join(some) + rng.choice([" ", ". ", ",", "\n", "\r\n", " ;", "?!", "\x0b"])
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("en", None), (None, ""), ("fr", " . "), ("en", "y " * 5_000), ("de", docs[0][1]), ("de", docs[0][1])]


@pytest.mark.parametrize("seed,least,top,chunk", [(1, 20, 2_000, 400_000), (2, 8, 15, 400_000), (3, 6, 2_000, 5)])
def test_equals_counting_all_phrases(spark, monkeypatch, seed, least, top, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)  # also where leading words have more suffixes than a chunk
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], "lang string, text string, phrase string, n int, f int").repartition(4)
    got = P.collocations(frame, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top)
    if seed == 1:
        assert P.collocations(frame.limit(0)).collect() == []


def test_products_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**15, 8 * 10**17, 10**16, 3 * 10**16
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(
        "(1000BD * CAST(a AS DECIMAL(20,0))) * CAST(n AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) * CAST(r AS DECIMAL(20,0))) AS s").head()
    assert row.s == 1000 * a * n // (l * r)


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    table = rng.integers(0, 4, (3_000, 4))
    end = rng.integers(2, 5, 3_000)
    table[np.arange(4)[None] >= end[:, None]] = -1
    weight = rng.integers(1, 5, 3_000)
    want = Counter()
    for row, w in zip(table.tolist(), weight.tolist()):
        for d in range(2, 5):
            if row[d - 1] >= 0:
                want[tuple(row[:d])] += w
    for least in (1, 100):
        got = {tuple(table[i, :d].tolist()): n for i, d, n in P.multikey_quicksort(table, weight, least, 2)}
        assert got == {k: n for k, n in want.items() if n >= least}
