"""Values that must not depend on row order, magnitude, names or size."""

import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from quadrat.operators import normalize, permanova, ranktests, summaries


def test_taxon_shares_do_not_depend_on_row_order(spark):
    rng = random.Random(1)
    cells = [(f"s{i % 9}", f"f{i}", rng.random() * 10 ** rng.randint(-3, 5)) for i in range(900)]
    taxa = spark.createDataFrame([(f"f{i}", f"g{i % 7}") for i in range(900)], "feature string, genus string")
    seen = set()
    for parts in (1, 3, 8):
        rng.shuffle(cells)
        ab = spark.createDataFrame(cells, "sample string, feature string, value double").repartition(parts)
        rows = normalize.taxon_shares(ab, taxa, "genus", 100.0).collect()
        seen.add(tuple(sorted((r.sample, r.taxon, r.rel_abund) for r in rows)))
    assert len(seen) == 1


def test_equal_counts_tie(spark):
    ab = spark.createDataFrame([("s", "a", 0.1), ("s", "b", 0.2), ("s", "c", 0.3), ("s", "d", 0.4)],
                               "sample string, feature string, value double")
    taxa = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "feature string, genus string")
    got = {r.taxon: r.rel_abund for r in normalize.taxon_shares(ab, taxa, "genus").collect()}
    assert got["x"] == got["y"] != got["z"]


def test_standardize_keeps_digits_of_large_means(spark):
    values = [1e9 + 0.1 * i for i in range(10)]
    ab = spark.createDataFrame([(f"s{i}", "f", v) for i, v in enumerate(values)],
                               "sample string, feature string, value double")
    got = {r.sample: r.value for r in normalize.standardize(ab, "standardize").collect()}
    want = (np.array(values) - np.mean(values)) / np.std(values, ddof=1)
    assert [got[f"s{i}"] for i in range(10)] == pytest.approx(want.tolist(), rel=1e-5)


def test_standardize_with_implicit_zeros(spark):
    ab = spark.createDataFrame([("a", "f", 3.0), ("b", "f", 5.0), ("c", "g", 1.0), ("d", "g", 2.0)],
                               "sample string, feature string, value double")
    got = {(r.sample, r.feature): (r.value, r.background) for r in normalize.standardize(ab, "standardize").collect()}
    full = np.array([3.0, 5.0, 0.0, 0.0])
    mean, sd = full.mean(), full.std(ddof=1)
    assert got["a", "f"] == pytest.approx(((3 - mean) / sd, -mean / sd))


def test_density_of_large_means(spark):
    rng = np.random.default_rng(1)
    values = 1e9 + rng.normal(0, 0.5, 200)
    df = spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")
    rows = sorted(summaries.kde(df, ["key"], "v", n=64).collect(), key=lambda r: r.point)
    area = sum(a.density for a in rows) * (rows[1].x - rows[0].x)
    assert area == pytest.approx(1, abs=0.02) and rows[-1].x - rows[0].x < 10


def test_keys_may_have_short_names(spark):
    df = spark.createDataFrame([(k, m, g, float(i * 7 % 5)) for k in (1, 2) for m in (1, 2)
                                for i, g in enumerate("aabbab")], "k int, m int, grp string, v double")
    rows = ranktests.rank_sum(df, ["k", "m"], "v", "grp").collect()
    assert {(r.k, r.m) for r in rows} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_many_levels(spark):
    df = spark.createDataFrame([(f"l{i // 2:04d}", float(i * 31 % 17)) for i in range(2_400)], "grp string, v double")
    assert ranktests.rank_sum(df, [], "v", "grp", "l0000", correction=None, exact=False).count() == 1_199


def exact_null(m, n):
    ways = {0: 1}
    table = [{0: 1}] + [{} for _ in range(m)]
    for rank in range(1, m + n + 1):
        for k in range(min(rank, m), 0, -1):
            for u, c in table[k - 1].items():
                table[k][u + rank - k] = table[k].get(u + rank - k, 0) + c
    ways = table[m]
    total, run, out = comb(m + n, m), 0, []
    for u in range(m * n + 1):
        run += ways.get(u, 0)
        out.append(float(Fraction(run, total)))
    return out


@pytest.mark.parametrize("m,n", [(1, 1), (1, 7), (5, 3), (9, 12), (20, 17)])
def test_rank_sum_null_is_exact(m, n):
    assert ranktests.rank_sum_null(m, n).tolist() == pytest.approx(exact_null(m, n), rel=1e-9)


def test_rank_sum_null_of_many_values():
    cdf = ranktests.rank_sum_null(600, 600)
    assert np.isfinite(cdf).all() and (np.diff(cdf) >= 0).all() and cdf[-1] == 1
    assert cdf[180_000] == pytest.approx(0.5, abs=1e-3)
    z = (170_000 - 180_000) / np.sqrt(600 * 600 * 1201 / 12)
    assert cdf[170_000] == pytest.approx(0.5 * (1 + float(np.vectorize(__import__("math").erf)(z / 2 ** 0.5))), abs=1e-3)


def test_pairs_of_levels_with_hyphens(spark):
    rng = random.Random(2)
    labels = ["a", "b-c", "a-b", "c", "z"]
    samples = spark.createDataFrame([(f"s{i:02d}", labels[i // 4]) for i in range(20)], "sample string, grp string")
    dist = spark.createDataFrame([(f"s{i:02d}", f"s{j:02d}", rng.random()) for i in range(20) for j in range(i + 1, 20)],
                                 "a string, b string, d double")
    rows = permanova.permanova_pairwise(dist, samples, "grp", 19).collect()
    assert len(rows) == 10 and {r.n for r in rows} == {8}


def test_shares_at_any_scale(spark):
    """Small and large counts keep their digits, and equal counts tie however the rows arrive."""
    taxonomy = spark.createDataFrame([(f"f{i}", f"t{i % 3}") for i in range(300)], "feature string, species string")
    for scale in (3e-17, 1.2e-12, 1.0, 1e24, 1e-280, 1e250):
        rows = [("s", f"f{i}", scale * (1 + i // 3 % 7)) for i in range(300)]
        got = []
        for seed in (1, 2):
            random.Random(seed).shuffle(rows)
            frame = spark.createDataFrame(rows, "sample string, feature string, value double").repartition(seed + 2)
            got.append({r.taxon: r.rel_abund for r in normalize.taxon_shares(frame, taxonomy, "species").collect()})
        assert got[0] == got[1] and len(set(got[0].values())) == 1
        assert got[0]["t0"] == pytest.approx(1 / 3, rel=1e-15)
    mixed = [("s", "f0", 1e24), ("s", "f1", 1e-12), ("s", "f4", 2e-12), ("z", "f0", 0.0), ("n", "f0", -2.0), ("n", "f1", 4.0)]
    got = {(r.sample, r.taxon): r.rel_abund for r in normalize.taxon_shares(
        spark.createDataFrame(mixed, "sample string, feature string, value double"), taxonomy, "species").collect()}
    assert got["s", "t1"] == pytest.approx(3e-36, rel=1e-14) and got["s", "t0"] == 1.0
    assert got["z", "t0"] is None and got["n", "t0"] == -1.0 and got["n", "t1"] == 2.0


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=300), rng.normal(5, 0.2, size=100), [0.0] * 40])
    frame = spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")
    exact, binned = ({r.point: (r.x, r.density) for r in summaries.kde(frame, ["key"], "v", binned=b).collect()} for b in (False, True))
    assert [exact[p][0] for p in range(512)] == [binned[p][0] for p in range(512)]
    step = exact[1][0] - exact[0][0]
    spread = min(np.std(values, ddof=1), np.subtract(*np.percentile(values, [75, 25])) / 1.34)
    bandwidth = 0.9 * spread * len(values) ** -0.2
    bound = (step / bandwidth) ** 2 / 8 * 0.4 / bandwidth
    assert max(abs(exact[p][1] - binned[p][1]) for p in range(512)) <= bound
