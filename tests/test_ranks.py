"""Ranks, quantiles, rank tests and corrections against direct computation."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.operators import counts as K
from quadrat.operators import ranktests as R
from quadrat.operators import summaries as S
from quadrat.operators.multitest import p_adjust


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in "abcd":
        n = {"a": 200, "b": 40, "c": 7, "d": 1}[key]
        values = np.round(rng.normal(size=n) * 10 ** rng.uniform(-3, 3, n), 2 if key != "b" else 0)
        rows += [(key, float(v), "xyz"[int(g)]) for v, g in zip(values, rng.integers(0, 3, n))]
    pdf = pd.DataFrame(rows, columns=["key", "value", "grp"])
    return pdf, spark.createDataFrame(pdf)


def test_bucket_keeps_order(spark):
    rng = np.random.default_rng(1)
    xs = sorted([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 2.0,
                 *(rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500))])
    codes = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1)
             .select(K.value_bucket(F.col("x"))).collect()]
    assert codes == sorted(codes) and codes[0] < 0 < codes[-1]


def test_midranks_and_quantiles(table):
    pdf, df = table
    placed = K.positions(K.value_counts(df, ["key"], "value"), ["key"], "value")
    got = placed.select("key", "value", K.midrank().alias("r")).toPandas()
    want = pdf.assign(r=pdf.groupby("key")["value"].rank())[["key", "value", "r"]].drop_duplicates()
    merged = got.merge(want, on=["key", "value"])
    assert len(merged) == len(want) and np.allclose(merged.r_x, merged.r_y)
    q = K.exact_quantiles(K.value_counts(df, ["key"], "value"), ["key"], "value",
                          {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("key")
    for name, p in {"a": 0.25, "b": 0.5, "c": 0.9}.items():
        assert np.allclose(q[name].sort_index(), pdf.groupby("key")["value"].quantile(p))


def kruskal_brute(values, groups):
    n = len(values)
    r = pd.Series(values).rank().to_numpy()
    t = pd.Series(values).value_counts().to_numpy()
    h = 12 / (n * (n + 1)) * sum(r[groups == g].sum() ** 2 / (groups == g).sum() for g in set(groups)) - 3 * (n + 1)
    return h / (1 - (t ** 3 - t).sum() / (n ** 3 - n))


def test_kruskal(table):
    pdf, df = table
    got = {r.key: r for r in R.kruskal(df, ["key"], "value", "grp").collect()}
    for key in "ab":
        part = pdf[pdf.key == key]
        assert got[key].statistic == pytest.approx(kruskal_brute(part.value.to_numpy(), part.grp.to_numpy()))
        assert got[key].p == pytest.approx(math.exp(-got[key].statistic / 2))
    assert got["d"].p is None and got["d"].groups == 1


def test_all_tied_gives_null(spark):
    df = spark.createDataFrame([("k", 1.0, g) for g in "xxyy"], "key string, value double, grp string")
    assert R.kruskal(df, ["key"], "value", "grp").head().p is None
    assert R.rank_sum(df, ["key"], "value", "grp", exact=False).head().p is None


def test_exact_null_counts_arrangements():
    for m, n in [(3, 4), (1, 5), (4, 4)]:
        us = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        want = np.cumsum(np.bincount(us, minlength=m * n + 1)) / len(us)
        assert np.allclose(R.rank_sum_null(m, n), want)


def test_exact_test_and_location_shift(spark):
    x, y = [1.1, 2.5, 3.7, 9.0], [0.4, 1.9, 5.5, 6.1, 7.3]
    rows = [("k", v, "x") for v in x] + [("k", v, "y") for v in y]
    df = spark.createDataFrame(rows, "key string, value double, grp string")
    u = sum(a > b for a in x for b in y)
    cdf = R.rank_sum_null(4, 5)
    for alternative, want in {"less": cdf[u], "greater": cdf[20 - u], "two.sided": min(1, 2 * cdf[min(u, 20 - u)])}.items():
        r = R.rank_sum(df, ["key"], "value", "grp", "x", ["x", "y"], alternative, detailed=True).head()
        assert (r.statistic, r.method, r.n1, r.n2) == (u, "exact", 4, 5)
        assert r.p == pytest.approx(want)
        d = sorted(a - b for a in x for b in y)
        assert r.estimate == pytest.approx((d[9] + d[10]) / 2)
        q = max(1, int(np.searchsorted(cdf, 0.025 if alternative == "two.sided" else 0.05)))
        assert r.conf_low == (float("-inf") if alternative == "less" else pytest.approx(d[q - 1]))
        assert r.conf_high == (float("inf") if alternative == "greater" else pytest.approx(d[20 - q]))


@pytest.mark.parametrize("cells", [4_000_000, 10])
def test_location_shift_of_large_and_tied_samples(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "SHIFT_CELLS", cells)
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(1, 1, 70), 1), np.round(rng.normal(0, 2, 60), 1)
    df = spark.createDataFrame([("k", float(v), "x") for v in x] + [("k", float(v), "y") for v in y],
                               "key string, value double, grp string")
    r = R.rank_sum(df, ["key"], "value", "grp", "x", ["x", "y"], detailed=True).head()
    d = np.sort((x[:, None] - y[None, :]).ravel())
    assert r.method == "normal"
    assert r.estimate == pytest.approx(np.median(d), abs=1e-9)
    both = pd.Series(np.concatenate([x, y])).value_counts()
    sigma = math.sqrt(70 * 60 / 12 * (131 - (both ** 3 - both).sum() / (130 * 129)))
    q = int(70 * 60 / 2 - 1.959963984540054 * sigma)
    assert (r.conf_low, r.conf_high) == (pytest.approx(d[q - 1], abs=1e-9), pytest.approx(d[-q], abs=1e-9))


def test_normal_approximation(table):
    pdf, df = table
    part = pdf[pdf.key == "b"]
    x, y = part.value[part.grp == "y"], part.value[part.grp == "x"]
    m, n = len(x), len(y)
    both = pd.concat([x, y])
    u = both.rank()[: m].sum() - m * (m + 1) / 2
    t = both.value_counts()
    sigma = math.sqrt(m * n / 12 * (m + n + 1 - ((t ** 3 - t).sum()) / ((m + n) * (m + n - 1))))
    z = u - m * n / 2
    z = (z - math.copysign(0.5, z) * (z != 0)) / sigma
    want = min(1.0, math.erfc(abs(z) / math.sqrt(2)))
    got = R.rank_sum(df.filter("key = 'b'"), ["key"], "value", "grp", exact=False).filter("group1 = 'y' AND group2 = 'x'").head()
    assert got.statistic == pytest.approx(u) and got.p == pytest.approx(want)


def test_implicit_zeros_equal_explicit_ones(spark):
    sizes = spark.createDataFrame([("x", 3), ("y", 4)], "grp string, size bigint")
    sparse = [("t1", 1.0, "x"), ("t1", 2.0, "y"), ("t1", 3.0, "y"), ("t2", 4.0, "x")]
    counts = R.group_counts(spark.createDataFrame(sparse, "taxon string, v double, grp string"), ["taxon"], "v", "grp")
    full = R.add_implicit_zeros(counts, sizes, [], "taxon", "v", "grp")
    dense = sparse + [("t1", 0.0, "x")] * 2 + [("t1", 0.0, "y")] * 2 + [("t2", 0.0, "x")] * 2 + [("t2", 0.0, "y")] * 4
    a = R.kruskal(full, ["taxon"], "v", "grp", "n").orderBy("taxon").collect()
    b = R.kruskal(spark.createDataFrame(dense, "taxon string, v double, grp string"), ["taxon"], "v", "grp").orderBy("taxon").collect()
    assert a == b


def bh_brute(ps):
    n, order, out, low = len(ps), np.argsort(ps)[::-1], np.zeros(len(ps)), 1.0
    for k, i in enumerate(order):
        low = min(low, n / (n - k) * ps[i])
        out[i] = low
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_bh_and_bonferroni(spark, bounded):
    ps = list(np.round(np.random.default_rng(2).uniform(0, 1, 200) ** 3, 4)) + [0.0, 1.0]
    rows = [("a", i, float(p)) for i, p in enumerate(ps)] + [("a", 900, None), ("b", 901, 0.04), ("b", 902, 0.03)]
    df = spark.createDataFrame(rows, "f string, i int, p double")
    got = {r.i: r.p_adj for r in p_adjust(df, family=["f"], bounded=bounded).collect()}
    want = bh_brute(np.array(ps))
    assert all(got[i] == pytest.approx(w) for i, w in enumerate(want))
    assert got[900] is None and got[901] == got[902] == pytest.approx(0.04) and len(got) == len(rows)
    bon = {r.i: r.p_adj for r in p_adjust(df, method="bonferroni", family=["f"], bounded=bounded).collect()}
    assert bon[901] == pytest.approx(0.08) and bon[900] is None and bon[5] == pytest.approx(min(1, 202 * ps[5]))


def test_box_and_density(table):
    pdf, df = table
    got = S.box_stats(df, ["key"], "value").toPandas().set_index("key")
    for key, g in pdf.groupby("key"):
        q1, q3 = g.value.quantile([0.25, 0.75])
        inside = g.value[(g.value >= q1 - 1.5 * (q3 - q1)) & (g.value <= q3 + 1.5 * (q3 - q1))]
        assert (got.lower[key], got.upper[key], got.outliers[key]) == (inside.min(), inside.max(), len(g) - len(inside))
    whole = S.box_stats(df, [], "value").head()
    assert whole.n == len(pdf)
    area = S.kde(df.filter("key = 'b'"), ["key"], "value", n=256).toPandas().sort_values("point")
    assert np.trapezoid(area.density, area.x) == pytest.approx(1.0, abs=0.05)


def test_single_value_trajectory_has_null_sd(spark):
    df = spark.createDataFrame([("t", "g", 2.0)], "time string, grp string, v double")
    r = S.trajectory(df, "time", "grp", "v").head()
    assert (r.median, r.sd, r.y_min) == (2.0, None, None)


def test_numbers_and_following_minima_over_buckets(spark):
    """Against plain windows, with ties, nulls, negative and very large values, and a key with most rows."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", i,
             rng.choice([None, 0.0, 1e300, -1e-300, float(rng.randrange(-40, 40)), rng.gauss(0, 1e4)]), rng.random()) for i in range(1_500)]
    df = spark.createDataFrame(rows, "g string, id int, v double, y double").repartition(6)
    got = {(r.g, r.id): r.no for r in K.numbered(df, ["g"], "v", "id").collect()}
    plain = Window.partitionBy("g").orderBy("v", "id")
    assert got == {(r.g, r.id): r.no for r in df.withColumn("no", F.row_number().over(plain)).collect()}
    assert K.numbered(df, [], "v", "id").agg(F.max("no"), F.countDistinct("no")).head()[:] == (1_500, 1_500)
    known = df.filter("v IS NOT NULL")
    onward = plain.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = {(r.g, r.id): r.m for r in known.withColumn("m", F.min(F.when(F.col("id") % 3 == 0, F.col("y"))).over(onward)).collect()}
    least = K.following_minimum(known, ["g"], "v", F.when(F.col("id") % 3 == 0, F.col("y")), F.col("id"), out="m")
    assert {(r.g, r.id): r.m for r in least.collect()} == want
