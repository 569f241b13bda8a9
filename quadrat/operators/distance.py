"""Dissimilarity between samples, as a long table of pairs ``a, b, d`` with a < b.

All pairs of n samples are n^2 / 2 numbers however they are computed. Joining
the table with itself on the feature would also move every common feature of
every pair through the shuffle. Instead samples are hashed into blocks of about
``block`` samples, each row goes to the tiles of its block (n / block copies), and a
tile adds up its pairs in numpy. Rows of a tile are cut further by feature, so
that a task never holds more than ``cells`` rows; the partial sums of the cuts add up.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import ratio

BLOCK = 256
CELLS = 4_000_000
_DENSE = 4096  # features made dense at a time


def _dense(codes, features, values, shape):
    out = np.zeros(shape)
    out[codes, features] = values
    return out


def _shared_minimum(x, y):
    return np.stack([np.minimum(row, y).sum(axis=1) for row in x])


def _squared_difference(x, y):
    return np.stack([np.square(row - y).sum(axis=1) for row in x])


def _tile(kind: str, split: str | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        codes, names = pd.factorize(pdf["sample"], sort=True)
        home = np.empty(len(names), dtype=np.int64)
        home[codes] = pdf["_block"].to_numpy()
        rows, cols = np.flatnonzero(home == i), np.flatnonzero(home == j)
        r_of, c_of = (np.full(len(names), -1) for _ in range(2))
        r_of[rows], c_of[cols] = np.arange(len(rows)), np.arange(len(cols))
        values = pdf["value"].to_numpy(dtype=float)
        present = pdf["feature"].notna().to_numpy()
        features = pd.factorize(pdf["feature"])[0]
        on_r, on_c = present & (r_of[codes] >= 0), present & (c_of[codes] >= 0)
        weight = np.bincount(codes, values, len(names)) if kind == "bray" else None
        if kind == "bray":  # min(x, y) > 0 needs the feature on both sides
            both = np.intersect1d(features[on_r], features[on_c])
        else:
            both = np.unique(features[present])
        place = np.full(int(features.max(initial=-1)) + 2, -1)
        place[both] = np.arange(len(both))
        at = place[features]
        kernel = _shared_minimum if kind == "bray" else _squared_difference
        part = np.zeros((len(rows), len(cols)))
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        for start in range(0, len(both), _DENSE):
            width = min(_DENSE, len(both) - start)
            lo, hi = np.searchsorted(sorted_at, [start, start + width])
            take = order[lo:hi]
            left, right = take[on_r[take]], take[on_c[take]]
            x = _dense(r_of[codes[left]], at[left] - start, values[left], (len(rows), width))
            y = _dense(c_of[codes[right]], at[right] - start, values[right], (len(cols), width))
            part += kernel(x, y)
        a, b = np.meshgrid(rows, cols, indexing="ij")
        keep = (a < b) if i == j else np.ones_like(a, dtype=bool)
        first, second = np.minimum(a, b)[keep], np.maximum(a, b)[keep]  # codes follow name order
        total = weight[first] + weight[second] if kind == "bray" else np.zeros(len(first))
        out = pd.DataFrame({"a": np.asarray(names)[first], "b": np.asarray(names)[second],
                            "part": part[keep], "total": total})
        return out.assign(**{split: pdf["_slice"].iloc[0]}) if split else out
    return run


def _pair_sums(ab: DataFrame, kind: str, split: str | None, block: int, cells: int) -> DataFrame:
    slice_of = F.col(split) if split else F.lit(0)
    ab = ab.select(slice_of.alias("_slice"), "sample", "feature", F.col("value").cast("double").alias("value"))
    if kind == "bray":
        ab = ab.filter(F.col("value").isNotNull())
    size = (ab.groupBy("_slice", "sample").agg(F.count(F.lit(1)).alias("k"))
            .groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
            .agg(F.max("n").alias("n"), F.max("k").alias("k"))).head()
    n, longest = size["n"] or 0, size["k"] or 1
    blocks = max(1, math.ceil(n / block))
    cuts = max(1, math.ceil(2.0 * block * longest / cells))
    home = F.pmod(F.xxhash64(F.col("sample").cast("string")), F.lit(blocks)).cast("int")
    rows = ab.withColumns({"_block": home,
                           "_cut": F.pmod(F.xxhash64(F.col("feature").cast("string")),
                                          F.lit(cuts)).cast("int")})
    if cuts > 1:  # every sample takes part in every cut, also where it has no feature
        roster = rows.select("_slice", "sample", "_block").distinct().select(
            "_slice", "sample", F.lit(None).cast(ab.schema["feature"].dataType).alias("feature"),
            F.lit(0.0).alias("value"), "_block",
            F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("_cut"))
        rows = rows.unionByName(roster)
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(
        F.least(k, F.col("_block")).alias("_i"), F.greatest(k, F.col("_block")).alias("_j")))
    rows = rows.select("_slice", "sample", "feature", "value", "_block", "_cut", F.inline(tiles))
    kind_of = lambda c: ab.schema[c].dataType.simpleString()
    schema = f"a {kind_of('sample')}, b {kind_of('sample')}, part double, total double"
    if split:
        schema += f", {split} {kind_of('_slice')}"
    sums = rows.groupBy("_slice", "_i", "_j", "_cut").applyInPandas(_tile(kind, split), schema)
    if cuts > 1:
        keys = [split, "a", "b"] if split else ["a", "b"]
        sums = sums.groupBy(*keys).agg(F.sum("part").alias("part"), F.sum("total").alias("total"))
    return sums


def bray_curtis(ab: DataFrame, split: str | None = None, block: int = BLOCK,
                cells: int = CELLS) -> DataFrame:
    """Bray-Curtis dissimilarity of all pairs, 1 - 2 sum(min) / (total_a + total_b).

    Takes one non-negative row per (sample, feature); disjoint samples get 1, two
    empty samples get null. With ``split`` only pairs within a slice are formed.
    """
    d = F.lit(1.0) - ratio(2.0 * F.col("part"), F.col("total"))
    keys = [split] if split else []
    return _pair_sums(ab, "bray", split, block, cells).select(*keys, "a", "b", d.alias("d"))


def euclidean(ab: DataFrame, split: str | None = None, block: int = BLOCK,
              cells: int = CELLS) -> DataFrame:
    """Euclidean distance of all pairs of samples; absent cells are zero."""
    keys = [split] if split else []
    return _pair_sums(ab, "euclid", split, block, cells).select(*keys, "a", "b", F.sqrt("part").alias("d"))


def transpose(ab: DataFrame) -> DataFrame:
    """Swap samples and features, to compare the columns of a table."""
    return ab.select(F.col("feature").alias("sample"), F.col("sample").alias("feature"), "value")


def symmetrize(dist: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    flipped = F.array(F.struct(F.col("a"), F.col("b"), F.col("d")),
                      F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("d")))
    return dist.select(F.inline(flipped))


def dist_as_abundance(dist: DataFrame) -> DataFrame:
    """A distance matrix read as a table: samples by samples, zero diagonal left out."""
    return symmetrize(dist).select(F.col("a").alias("sample"), F.col("b").alias("feature"),
                                   F.col("d").alias("value"))


def baseline_dissimilarity(ab: DataFrame, samples: DataFrame, subject: str = "subject",
                           day: str = "day", ref_order: bool = False) -> DataFrame:
    """Bray-Curtis of every later sample to the day-0 samples of its subject.

    Pairs are chosen before any distance is computed, so the work is linear in
    the samples, and rows meet on (baseline sample, feature), which spreads also
    one very large subject. ``ref_order`` keeps only pairs whose baseline name
    sorts first, as comparing a triangle of the matrix does.
    Returns ``subject, baseline, sample, d``.
    """
    who = samples.select("sample", F.col(subject).alias("subject"), F.col(day).alias("_day"))
    start = who.filter("_day = 0").select("subject", F.col("sample").alias("baseline"))
    pairs = who.filter("_day != 0").join(start, "subject").select("subject", "baseline", "sample")
    if ref_order:
        pairs = pairs.filter("baseline < sample")
    totals = ab.groupBy("sample").agg(F.sum("value").alias("_total"))
    later = ab.join(pairs, "sample").select("baseline", "sample", "feature", "value")
    early = (ab.join(start.select("baseline"), ab["sample"] == F.col("baseline"), "left_semi")
             .select(F.col("sample").alias("baseline"), "feature", F.col("value").alias("_start")))
    shared = (later.join(early, ["baseline", "feature"]).groupBy("baseline", "sample")
              .agg(F.sum(F.least("value", "_start")).alias("_shared")))
    full = (pairs.join(totals.withColumnRenamed("_total", "_x"), "sample")
            .join(totals.select(F.col("sample").alias("baseline"), F.col("_total").alias("_y")), "baseline")
            .join(shared, ["baseline", "sample"], "left"))
    d = F.lit(1.0) - ratio(2.0 * F.coalesce("_shared", F.lit(0.0)), F.col("_x") + F.col("_y"))
    return full.select("subject", "baseline", "sample", d.alias("d"))
