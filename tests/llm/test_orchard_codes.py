"""Vector codes against search through all entries in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quadrat.llm import orchard_codes as O

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, vector string"


def brute(rows):
    """(vec_id, code, error, label_error, hash) of every usable row; rows are (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    whole = [[math.floor(Fraction(c) * 256) for c in v] for _, v, _ in rows]
    size = len(whole[0])
    edge = [size * p // 16 for p in range(17)]
    part = lambda v, p: v[edge[p]:edge[p + 1]]
    books = [[part(v, p) for v in whole[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            of = defaultdict(list)
            for v in whole:
                of[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(of[i]) for c in zip(*of[i])] if i in of else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded, labels = [], defaultdict(int)
    for (i, _, label), v in zip(rows, whole):
        best = [near(part(v, p), books[p]) for p in range(16)]
        error = sum(d for d, _ in best)
        labels[label] += error
        coded.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    return sorted([(i, c, e, labels[label], digest) for i, c, e, label in coded], key=repr)


def run(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, label, "clash", 1, "clash") for i, v, label in rows], SCHEMA).repartition(parts)
    out = O.encode(frame)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("spread,size", [(0.02, 32), (3.0, 64), (50.0, 40)])
def test_equals_search_through_all_entries(spark, spread, size):
    rng = random.Random(size)
    centres = [[rng.gauss(0, spread) for _ in range(size)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, spread / 5) for c in rng.choice(centres)], rng.choice([0, 1, 1, None])) for i in range(300)]
    rows += [(1_000 + i, rows[7][1], 1) for i in range(100)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_rows_that_are_left_out_ties_and_few_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(2)) for _ in range(16)], None) for i in range(20)]
    bad = [(-1, None, 1), (-2, [None] + [0.0] * 15, 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] * 16, 1), (50, [1.0] * 8, 1), (51, [], 1)]
    again = [(3, rows[3][1], 2), (3, rows[4][1], 2), (None, rows[5][1], None)]
    assert run(spark, rows + bad + again) == brute(rows + bad + again)
    assert run(spark, bad[:4]) == []
    assert run(spark, [(1, [], 3)]) == brute([(1, [], 3)])


def test_components_beyond_a_long(spark):
    rows = [(i, [(-1) ** (i + j) * 1.5 * 10.0 ** (i % 40 + j % 3) for j in range(16)], i % 2) for i in range(80)]
    want = [(i, c, e if e < 1 << 63 else None, None, h) for i, c, e, _, h in brute(rows)]
    got = run(spark, rows)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in sorted(want, key=repr)]


def test_orchard_visits_few_entries():
    rng = np.random.default_rng(1)
    book = O.Orchard(rng.integers(-1_000, 1_000, (64, 4)))
    points = book.entries[rng.integers(0, 64, 500)] + rng.integers(-60, 61, (500, 4))
    far = ((points[:, None] - book.entries[None]) ** 2).sum(-1)
    best, error = book.nearest(points, np.zeros(500, np.int64))
    assert (best == far.argmin(1)).all() and (error == far.min(1)).all()
