"""Distances, PERMANOVA, ordination and clustering against dense computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.operators import clustering, distance, diversity, normalize, ordination, permanova
from quadrat.storage import settle


@pytest.fixture(scope="module")
def community(spark):
    rng = np.random.default_rng(11)
    m = rng.poisson(2.0, (40, 30)) * (rng.uniform(size=(40, 30)) < 0.5)
    m[0] = 0
    m[0, 3] = 5
    names = [f"s{i:02d}" for i in range(40)]
    rows = [(names[i], f"f{j}", float(m[i, j])) for i in range(40) for j in range(30) if m[i, j]]
    return names, m.astype(float), spark.createDataFrame(rows, "sample string, feature string, value double")


def bray(m):
    lo = np.minimum(m[:, None], m[None]).sum(2)
    t = m.sum(1)
    return 1 - 2 * lo / (t[:, None] + t[None])


def to_square(pdf, names):
    ix = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for a, b, v in pdf[["a", "b", "d"]].itertuples(index=False):
        d[ix[a], ix[b]] = d[ix[b], ix[a]] = v
    return d


@pytest.mark.parametrize("block,cells", [(256, 10 ** 6), (7, 10 ** 6), (16, 200)])
def test_distances_in_any_tiling(community, block, cells):
    names, m, ab = community
    got = distance.bray_curtis(ab, block=block, cells=cells).toPandas()
    assert len(got) == 40 * 39 // 2 and (got.a < got.b).all()
    assert np.allclose(to_square(got, names), bray(m))
    e = distance.euclidean(ab, block=block, cells=cells).toPandas()
    assert np.allclose(to_square(e, names), np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)))


def test_distance_slices_and_special_samples(spark):
    rows = [("a", "f", 1.0, "p"), ("b", "g", 1.0, "p"), ("c", "f", 0.0, "p"), ("d", "f", 0.0, "q"), ("e", "f", 0.0, "q")]
    ab = spark.createDataFrame(rows, "sample string, feature string, value double, grp string")
    got = {(r.a, r.b): r.d for r in distance.bray_curtis(ab, split="grp").collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("d", "e"): None}


def test_baseline_pairs(community, spark):
    names, m, ab = community
    who = spark.createDataFrame([(n, f"m{i // 4}", (i % 4) * 7) for i, n in enumerate(names)], "sample string, subject string, day int")
    d = bray(m)
    got = distance.baseline_dissimilarity(ab, who).collect()
    assert len(got) == 30
    for r in got:
        assert r.d == pytest.approx(d[names.index(r.baseline), names.index(r.sample)])


def test_standardize_identities(community):
    names, m, ab = community
    total = normalize.standardize(ab, "total").groupBy("sample").agg(F.sum("value").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in total)
    hell = normalize.standardize(ab, "hellinger").groupBy("sample").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in hell)
    with pytest.raises(ValueError):
        normalize.standardize(ab, "other")


def test_diversity_of_simple_samples(spark):
    ab = spark.createDataFrame([("even", f, 5.0) for f in "abcd"] + [("one", "a", 3.0), ("none", "a", 0.0)],
                               "sample string, feature string, value double")
    got = {r["sample"]: r for r in diversity.alpha_diversity(ab).collect()}
    assert got["even"].shannon == pytest.approx(np.log(4)) and got["even"].invsimpson == pytest.approx(4)
    assert got["even"].simpson == pytest.approx(0.75) and got["even"].invsimpson_ref == pytest.approx(4 / 3)
    assert got["one"].richness == 1 and got["one"].shannon == pytest.approx(0) and got["one"].invsimpson_ref is None
    assert got["none"].richness == 0 and got["none"].shannon is None


def permanova_brute(d, labels):
    n, levels = len(labels), sorted(set(labels))
    sst = (np.triu(d) ** 2).sum() / n
    ssw = sum((np.triu(d[np.ix_(ix, ix)]) ** 2).sum() / len(ix)
              for ix in (np.flatnonzero(labels == g) for g in levels))
    a = len(levels)
    return (sst - ssw) / (a - 1) / (ssw / (n - a)), (sst - ssw) / sst


@pytest.mark.parametrize("block", [512, 9])
def test_permanova(community, spark, block):
    names, m, ab = community
    labels = np.array(["xyz"[i % 3] for i in range(40)])
    who = spark.createDataFrame(list(zip(names, labels)), "sample string, grp string")
    dist = settle(distance.bray_curtis(ab))
    got = permanova.permanova(dist, who, "grp", 99, block=block).head()
    f, r2 = permanova_brute(bray(m), labels)
    assert got.f == pytest.approx(f) and got.r2 == pytest.approx(r2) and got.df == 2 and got.n == 40
    renamed = who.withColumn("grp", F.translate("grp", "xyz", "zxy"))
    again = permanova.permanova(dist, renamed, "grp", 99, block=block).head()
    assert again.f == pytest.approx(got.f) and again.p == got.p
    pairs = permanova.permanova_pairwise(dist, who, "grp", 49, "bonferroni", block=block).collect()
    assert len(pairs) == 3
    for r in pairs:
        ix = np.flatnonzero((labels == r.level1) | (labels == r.level2))
        assert r.f == pytest.approx(permanova_brute(bray(m)[np.ix_(ix, ix)], labels[ix])[0])
        assert r.p_adj == pytest.approx(min(1, 3 * r.p))


def pcoa_brute(d, cailliez):
    n = len(d)
    j = np.eye(n) - 1 / n
    x, y, c = j @ d ** 2 @ j, 2 * j @ d @ j, 0.0
    if cailliez:
        c = np.linalg.eigvals(np.block([[np.zeros((n, n)), -x], [-np.eye(n), y]])).real.max()
        d = d + c
        np.fill_diagonal(d, 0)
        x = j @ d ** 2 @ j
    e, v = np.linalg.eigh(-x / 2)
    order = np.argsort(e)[::-1]
    v = v[:, order[:2]] * np.sqrt(e[order[:2]])
    return c, e[order], v * np.sign(v[np.abs(v).argmax(0), [0, 1]])


@pytest.mark.parametrize("correction,block,width,columns", [
    ("none", 5, 32, 1500), ("cailliez", 16, 4, 1500), ("cailliez", 512, 4, 120)])
def test_principal_coordinates(community, monkeypatch, correction, block, width, columns):
    names, m, ab = community
    monkeypatch.setattr(ordination, "MAX_COLUMNS", columns)
    dist = settle(distance.bray_curtis(ab))
    coords, axes = ordination.pcoa(dist, correction=correction, block=block, width=width)
    axes = axes.orderBy("axis").collect()
    c, e, v = pcoa_brute(bray(m), correction == "cailliez")
    assert axes[0].constant == pytest.approx(c, rel=1e-6, abs=1e-9) and axes[0].converged
    for i in range(2):
        assert axes[i].eigenvalue == pytest.approx(e[i], rel=1e-6)
        assert axes[i].percent == pytest.approx(100 * e[i] / e.sum(), rel=1e-6)
    wide = ordination.coords_wide(coords).toPandas().set_index("sample").loc[names]
    assert np.allclose(wide.to_numpy(), v, atol=1e-4)


def test_ellipse(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(50, 2)) @ [[2, 0.5], [0, 1]] + [3, -1]
    rows = [("g", float(a), float(b)) for a, b in pts] + [("few", 0.0, 0.0)] * 2
    r = ordination.group_ellipse(spark.createDataFrame(rows, "grp string, pcoa1 double, pcoa2 double"), "grp", 0.75)
    got = {q.grp: q for q in r.collect()}
    w, loc = np.full(50, 1.4), pts.mean(0)
    while True:
        x = pts - loc
        q = np.einsum("ij,jk,ik->i", x, np.linalg.inv((w[:, None] * x).T @ x / w.sum()), x)
        new = 1.4 / (1 + q / 5)
        loc = (new[:, None] * pts).sum(0) / new.sum()
        done = np.abs(new - w).max() < 0.01
        w = new
        if done:
            break
    cov = (w[:, None] * x).T @ x / 50
    g = got["g"]
    assert np.allclose([g.cx, g.cy, g.sxx, g.sxy, g.syy], [*loc, cov[0, 0], cov[0, 1], cov[1, 1]], rtol=1e-6)
    assert g.radius == pytest.approx(np.sqrt(2 * (49 / 2 * (0.25 ** (-2 / 49) - 1))))
    assert got["few"].radius is None


def linkage_brute(pairs):
    """One merge at a time; clusters are as far apart as their last pair by distance, then names."""
    key = {}
    for a, b, d in pairs:
        key[a, b] = key[b, a] = (d, a, b)
    live, out = {n: [n] for p in pairs for n in p[:2]}, []
    while len(live) > 1:
        (h, *_), a, b = min((max(key[i, j] for i in live[x] for j in live[y]), x, y)
                            for x in live for y in live if x < y)
        out.append((a, b, h))
        live[a] += live.pop(b)
    return sorted(out)


@pytest.mark.parametrize("small", [1500, 2, 5])
@pytest.mark.parametrize("ties", [False, True])
def test_complete_linkage(spark, small, ties):
    rng = np.random.default_rng(8)
    pts = rng.normal(size=(18, 2))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    if ties:
        d = np.round(d, 0)
    names = [f"n{i:02d}" for i in range(18)]
    pairs = [(names[i], names[j], float(d[i, j])) for i in range(18) for j in range(i + 1, 18)]
    got = [tuple(r) for r in clustering.complete_linkage(spark.createDataFrame(pairs, "a string, b string, d double"), small=small).collect()]
    assert sorted(got) == linkage_brute(pairs)


def test_a_chain_of_nearest_clusters_takes_few_rounds(spark, monkeypatch):
    """Every point's nearest is the one before: one pair at a time would take a round per merge."""
    at = [1.0 + 0.01 * i for i in range(120)]
    at = np.cumsum(at)
    pairs = [(i, j, float(at[j] - at[i])) for i in range(120) for j in range(i + 1, 120)]
    rounds = []
    pieces = clustering._pieces
    monkeypatch.setattr(clustering, "_pieces", lambda *a: rounds.append(1) or pieces(*a))
    frame = spark.createDataFrame(pairs, "a int, b int, d double")
    got = clustering.complete_linkage(frame, small=40)
    assert sorted(map(tuple, got.collect())) == linkage_brute(pairs) and len(rounds) <= 2 * np.log2(120)


def test_copies_join_their_head(spark):
    tree = spark.createDataFrame([("s", "a", "c", 2.0)], "g string, left string, right string, height double")
    copies = spark.createDataFrame([("s", "a", "a"), ("s", "a", "b"), ("s", "c", "c"), ("t", "x", "x"), ("t", "x", "y")], "g string, head string, item string")
    assert sorted(map(tuple, clustering.attach_copies(tree, copies, "g").collect())) == [
        ("s", "a", "b", 0.0), ("s", "a", "c", 2.0), ("t", "x", "y", 0.0)]


def test_linkage_slices(spark):
    rows = [("p", "a", "b", 1.0), ("p", "b", "c", 2.0), ("p", "a", "c", 3.0), ("q", "x", "y", 5.0)]
    got = clustering.complete_linkage(spark.createDataFrame(rows, "g string, a string, b string, d double"), "g")
    assert sorted(tuple(r) for r in got.select("g", "left", "right", "height").collect()) == [
        ("p", "a", "b", 1.0), ("p", "a", "c", 3.0), ("q", "x", "y", 5.0)]
