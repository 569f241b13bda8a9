"""Kruskal-Wallis and Mann-Whitney tests for many keys at once.

Every test starts from weighted values (``keys, value, group, n``). Implicit
zeros of sparse abundance enter as one weighted row per key and group, not as
rows per sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import ratio
from quadrat.functions.special import chi2_tail, normal_tail
from quadrat.operators.counts import following_minimum, midrank, ordered_pairs, positions
from quadrat.operators.multitest import p_adjust
from quadrat.storage import settle

EXACT_BELOW = 50
SHIFT_CELLS = 4_000_000
_TRIALS = 15          # trial values per bracket and round
_SEARCH_ROUNDS = 12   # 16^12 > 2^47: brackets end at the precision of the values


def group_counts(df: DataFrame, keys: Sequence[str], value: str, group: str,
                 weight: str | None = None) -> DataFrame:
    """Weighted distinct values per key and group; rows without value or group are left out."""
    v = F.col(value).cast("double")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    out = (df.filter(v.isNotNull() & ~F.isnan(v) & F.col(group).isNotNull())
           .groupBy(*keys, v.alias(value), group).agg(n.cast("bigint").alias("n")))
    return settle(out, "groups") if weight is None else out


def add_implicit_zeros(counts: DataFrame, sizes: DataFrame, context: Sequence[str],
                       taxon: str, value: str, group: str) -> DataFrame:
    """Complete sparse counts with one zero row per (context, taxon, group).

    ``sizes`` has ``context, group, size``: how many samples each group has. A
    taxon seen in k of them gets a zero row of weight size - k.
    """
    seen = counts.groupBy(*context, taxon, group).agg(F.sum("n").alias("_seen"))
    taxa = counts.select(*context, taxon).distinct()
    levels = sizes.groupBy(*context).agg(
        F.collect_list(F.struct(F.col(group).alias("level"), F.col("size"))).alias("_levels"))
    if context:
        wanted = taxa.join(levels, list(context))
    else:  # one row: a scalar, not a join on a constant
        wanted = taxa.withColumn("_levels", levels.scalar())
    wanted = wanted.select(*context, taxon, F.inline("_levels")).withColumnRenamed("level", group)
    zeros = (wanted.join(seen, [*context, taxon, group], "left")
             .withColumn("n", F.col("size") - F.coalesce("_seen", F.lit(0)))
             .filter("n > 0")
             .select(*context, taxon, F.lit(0.0).alias(value), group, "n"))
    return counts.select(*zeros.columns).unionByName(zeros)


def kruskal(df: DataFrame, keys: Sequence[str], value: str, group: str,
            weight: str | None = None) -> DataFrame:
    """Kruskal-Wallis test per key: ``keys, n, groups, statistic, df, p``.

    The p-value is null when all values of a key are tied or only one group is present.
    """
    keys = list(keys)
    placed = positions(group_counts(df, keys, value, group, weight), keys, value)
    t = F.col("_ties").cast("double")
    per_group = placed.groupBy(*keys, group).agg(
        F.sum(F.col("n") * midrank()).alias("_r"), F.sum("n").alias("_n"),
        F.sum(F.col("n") * (t * t - 1.0)).alias("_t"))
    per_key = per_group.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).cast("int").alias("groups"),
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.sum("_t").alias("_t"))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) * F.col("_s") / (n * (n + 1.0)) - F.lit(3.0) * (n + 1.0)
    correction = F.lit(1.0) - ratio(F.col("_t"), n * n * n - n)
    h = F.when((F.col("groups") > 1) & (correction > 0),
               F.greatest(F.lit(0.0), ratio(raw, correction)))
    return (per_key.withColumns({"statistic": h, "df": F.col("groups") - 1})
            .withColumn("p", chi2_tail(F.col("statistic"), F.col("df")))
            .select(*keys, "n", "groups", "statistic", "df", "p"))


def rank_sum_null(m: int, n: int) -> np.ndarray:
    """P(U <= u) for u = 0..m*n, all arrangements equally likely.

    The numbers of arrangements are the coefficients of the product of (1 - x^(n+i)) / (1 - x^i), i = 1..m.
    They are built factor by factor as probabilities, which cannot overflow, for the lower half of u; the
    upper half is its mirror image. Memory is one number per u.
    """
    m, n = min(m, n), max(m, n)
    half = m * n // 2 + 1
    p = np.zeros(half)
    p[0] = 1.0
    for i in range(1, m + 1):
        if n + i < half:
            p[n + i:] -= p[:half - n - i].copy()
        for start in range(min(i, half)):
            p[start::i] = np.cumsum(p[start::i])
        p *= i / (n + i)
    p = np.maximum(p, 0.0)
    whole = np.concatenate([p, p[:m * n + 1 - half][::-1]])
    upto = np.cumsum(whole)
    return upto / upto[-1]


def _null_tables(pdf: pd.DataFrame) -> pd.DataFrame:
    m, n = int(pdf["_m"].iloc[0]), int(pdf["_k"].iloc[0])
    cdf = rank_sum_null(m, n)
    return pd.DataFrame({"_m": m, "_k": n, "_u": np.arange(len(cdf)), "_cdf": cdf})


def level_pairs(df: DataFrame, group: str, pairs="all", levels: Sequence[str] | None = None) -> DataFrame:
    """Table of the level pairs to test: ``group1, group2``.

    ``"all"``: first is the later level, second the earlier one. A single level
    name is a reference: it comes first. A list of pairs is taken as given.
    """
    spark, kind = df.sparkSession, df.schema[group].dataType.simpleString()
    if not isinstance(pairs, str):
        return spark.createDataFrame([tuple(p) for p in pairs], f"group1 {kind}, group2 {kind}")
    if levels is None:
        known = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("label")).distinct()
        if pairs == "all":
            return ordered_pairs(known).select(F.col("second").alias("group1"), F.col("first").alias("group2"))
        return known.filter(F.col("label") != F.lit(pairs)).select(F.lit(pairs).cast(kind).alias("group1"), F.col("label").alias("group2"))
    chosen = ([(y, x) for i, x in enumerate(levels) for y in levels[i + 1:]] if pairs == "all"
              else [(pairs, x) for x in levels if x != pairs])
    return spark.createDataFrame(chosen, f"group1 {kind}, group2 {kind}")


def rank_sum(df: DataFrame, keys: Sequence[str], value: str, group: str, pairs="all",
             levels: Sequence[str] | None = None, alternative: str = "two.sided",
             correction: str | None = "BH", exact="auto", detailed: bool = False,
             confidence: float = 0.95, weight: str | None = None) -> DataFrame:
    """Mann-Whitney test of pairs of group levels, per key.

    Returns ``keys, group1, group2, n1, n2, statistic, p, method`` and, with a
    correction, ``p_adj`` within the key. ``statistic`` is U of ``group1``, which
    is also what ``alternative`` refers to. ``exact="auto"`` uses the exact null
    distribution for fewer than 50 untied values on both sides, else the normal
    approximation with continuity correction. ``detailed`` adds ``estimate,
    conf_low, conf_high`` (location shift).
    """
    keys = list(keys)
    sides = level_pairs(df, group, pairs, levels).select("group1", "group2", F.inline(F.array(
        F.struct(F.col("group1").alias(group), F.lit(True).alias("_first")),
        F.struct(F.col("group2").alias(group), F.lit(False).alias("_first")))))
    counts = group_counts(df, keys, value, group, weight).join(sides, group)
    test = [*keys, "group1", "group2"]
    t = F.col("_ties").cast("double")
    first = F.col("_first")
    sums = positions(counts, test, value).groupBy(*test).agg(
        F.sum(F.when(first, F.col("n") * midrank())).alias("_r"),
        F.sum(F.when(first, F.col("n"))).alias("_m"),
        F.sum(F.when(~first, F.col("n"))).alias("_k"),
        F.sum(F.col("n") * (t * t - 1.0)).alias("_t"))
    sums = sums.filter(F.col("_m").isNotNull() & F.col("_k").isNotNull())
    m, k = F.col("_m").cast("double"), F.col("_k").cast("double")
    u = F.col("_r") - m * (m + 1.0) / 2.0
    size = m + k
    sigma = F.sqrt(m * k / 12.0 * (size + 1.0 - ratio(F.col("_t"), size * (size - 1.0))))
    centred = F.col("statistic") - m * k / 2.0
    shift = {"two.sided": F.signum(centred) * 0.5, "less": F.lit(-0.5),
             "greater": F.lit(0.5)}[alternative]
    z = ratio(centred - shift, F.col("_sigma"))
    tail = {"two.sided": F.least(F.lit(1.0), 2.0 * normal_tail(F.abs(F.col("_z")))),
            "less": normal_tail(-F.col("_z")), "greater": normal_tail(F.col("_z"))}[alternative]
    small = (F.col("_m") < EXACT_BELOW) & (F.col("_k") < EXACT_BELOW) & (F.col("_t") == 0)
    use_exact = {"auto": small, True: F.col("_t") == 0, False: F.lit(False)}[exact]
    out = (sums.withColumns({"statistic": u, "_sigma": sigma})
           .withColumns({"_z": z, "method": F.when(use_exact, "exact").otherwise("normal")})
           .withColumn("p", F.when(F.col("_z").isNotNull(), tail)))
    if exact is not False:
        is_exact = F.col("method") == "exact"
        grid = out.filter(is_exact).select("_m", "_k").distinct()
        null = grid.groupBy("_m", "_k").applyInPandas(
            _null_tables, "_m bigint, _k bigint, _u bigint, _cdf double")
        mirrored = F.col("_m") * F.col("_k") - F.col("statistic")
        at = {"two.sided": F.least(F.col("statistic"), mirrored), "less": F.col("statistic"),
              "greater": mirrored}[alternative]
        sided = F.least(F.lit(1.0), 2.0 * F.col("_cdf")) if alternative == "two.sided" else F.col("_cdf")
        out = (out.withColumn("_u", F.when(is_exact, at.cast("bigint")))
               .join(null, ["_m", "_k", "_u"], "left")
               .withColumn("p", F.when(is_exact, sided).otherwise(F.col("p"))))
    columns = [*test, F.col("_m").alias("n1"), F.col("_k").alias("n2"), "statistic", "p", "method"]
    if not detailed:
        out = out.select(*columns)
        return p_adjust(out, "p", correction, keys, bounded=True) if correction else out
    out = settle(out.select(*columns, "_sigma"), "tests")
    shift = location_shift(counts, out, test, value, alternative, confidence)
    if correction:
        out = p_adjust(out, "p", correction, keys, bounded=True)
    return out.drop("_sigma").join(shift, test, "left")


_STATISTICS = ("_mid1", "_mid2", "_low", "_high")


def location_shift(counts: DataFrame, tests: DataFrame, test: Sequence[str], value: str,
                   alternative: str, confidence: float) -> DataFrame:
    """Median and confidence limits of all differences x - y of every test.

    The limits are the order statistics q and mn + 1 - q of the differences; q comes from
    the exact null distribution or its normal approximation. The differences of a
    test with few distinct values are formed in one task (at most ``SHIFT_CELLS`` of
    them). A larger test never forms them: its order statistics are found by
    counting how many differences lie below trial values.
    """
    alpha = (1 - confidence) / (2 if alternative == "two.sided" else 1)

    def critical(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0])
        return pd.DataFrame({"n1": [m], "n2": [n], "_q": [int(np.searchsorted(rank_sum_null(m, n), alpha))]})

    is_exact = F.col("method") == "exact"
    limits = tests.filter(is_exact).select("n1", "n2").distinct().groupBy("n1", "n2").applyInPandas(
        critical, "n1 bigint, n2 bigint, _q bigint")
    pairs = F.col("n1") * F.col("n2")
    approx = F.floor(pairs / 2.0 - F.lit(NormalDist().inv_cdf(1 - alpha)) * F.col("_sigma"))
    q = F.greatest(F.lit(1), F.when(is_exact, F.col("_q")).otherwise(approx))
    distinct = counts.groupBy(*test).agg(F.sum(F.col("_first").cast("bigint")).alias("_dx"),
                                         F.sum((~F.col("_first")).cast("bigint")).alias("_dy"))
    ranks = tests.join(limits, ["n1", "n2"], "left").join(distinct, list(test)).select(
        *test, pairs.alias("_pairs"), F.floor((pairs + 1) / 2).alias("_mid1"),
        F.floor((pairs + 2) / 2).alias("_mid2"), q.alias("_low"), (pairs + 1 - q).alias("_high"),
        (F.col("_dx") * F.col("_dy") <= SHIFT_CELLS).alias("_small"))
    ranks = settle(ranks, "ranks")
    rows = counts.join(ranks, list(test))
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in test)
    found = rows.filter("_small").groupBy(*test).applyInPandas(
        _order_statistics(list(test), value), kinds + ", " + ", ".join(f"{c} double" for c in _STATISTICS))
    if ranks.filter("NOT _small").head(1):
        found = found.unionByName(_searched_statistics(rows.filter("NOT _small"), list(test), value))
    endless = F.lit(float("inf"))
    return found.select(
        *test, ((F.col("_mid1") + F.col("_mid2")) / 2.0).alias("estimate"),
        (-endless if alternative == "less" else F.col("_low")).alias("conf_low"),
        (endless if alternative == "greater" else F.col("_high")).alias("conf_high"))


def _order_statistics(test: list[str], value: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["_first"]], pdf[~pdf["_first"]]
        d = np.subtract.outer(x[value].to_numpy(), y[value].to_numpy()).ravel()
        w = np.multiply.outer(x["n"].to_numpy(), y["n"].to_numpy()).ravel()
        order = np.argsort(d)
        upto = np.cumsum(w[order])
        row = pdf.iloc[0]
        out = {c: [row[c]] for c in test}
        for s in _STATISTICS:
            out[s] = [d[order[np.searchsorted(upto, row[s])]]]
        return pd.DataFrame(out)
    return run


def _searched_statistics(rows: DataFrame, test: list[str], value: str) -> DataFrame:
    """Order statistics of the differences by trial values, for all tests and ranks at once.

    Every round counts, for a few trial shifts t per bracket, the pairs with x - y <= t:
    y is ranked against x - t with y alone carrying weight.
    """
    rows = settle(rows.select(*test, value, "n", "_first", "_pairs", *_STATISTICS), "large")
    x = F.col("_first")
    edges = rows.groupBy(*test, "_pairs", *_STATISTICS).agg(
        (F.min(F.when(x, F.col(value))) - F.max(F.when(~x, F.col(value)))).alias("_lo"),
        (F.max(F.when(x, F.col(value))) - F.min(F.when(~x, F.col(value)))).alias("_hi"))
    goals = F.array(*[F.struct(F.lit(s).alias("_goal"), F.col(s).alias("_rank")) for s in _STATISTICS])
    width = F.col("_hi") - F.col("_lo")
    state = edges.select(*test, "_pairs", "_lo", "_hi", F.inline(goals)).select(
        *test, "_pairs", "_goal", "_rank", (F.col("_lo") - width * 1e-9 - 1e-300).alias("_lo"), "_hi")
    state = settle(state, "brackets")
    for _ in range(_SEARCH_ROUNDS):
        trial = state.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(_TRIALS)))).withColumn(
            "_t", F.col("_lo") + width * F.col("_i") / F.lit(_TRIALS + 1.0))
        met = rows.select(*test, value, "n", "_first").join(
            trial.select(*test, "_goal", "_i", "_t"), test).select(
            *test, "_goal", "_i",
            F.when(x, F.col(value) - F.col("_t")).otherwise(F.col(value)).alias("_v"),
            F.when(x, 0).otherwise(F.col("n")).alias("_w"), F.when(x, F.col("n")).otherwise(0).alias("_x"))
        above = positions(met, [*test, "_goal", "_i"], "_v", "_w").groupBy(*test, "_goal", "_i").agg(
            F.sum(F.col("_x") * F.col("_below")).alias("_above"))
        reached = F.col("_pairs") - F.col("_above") >= F.col("_rank")
        state = settle(trial.join(above, [*test, "_goal", "_i"]).groupBy(
            *test, "_pairs", "_goal", "_rank").agg(
            F.coalesce(F.max(F.when(~reached, F.col("_t"))), F.first("_lo")).alias("_lo"),
            F.coalesce(F.min(F.when(reached, F.col("_t"))), F.first("_hi")).alias("_hi")), "brackets")
    # the bracket's upper end is a trial value: take the largest difference x - y that does not exceed it
    met = rows.select(*test, value, "n", "_first").join(state.select(*test, "_goal", "_hi"), test)
    at = F.when(x, F.col(value) - F.col("_hi")).otherwise(F.col(value))
    nearest = following_minimum(met.withColumn("_at", at), [*test, "_goal"], "_at", F.when(~x, F.col(value)), F.col("_first").desc(), out="_y")
    reached = nearest.filter(x).groupBy(*test, "_goal").agg(F.max(F.col(value) - F.col("_y")).alias("_d"))
    return reached.groupBy(*test).agg(*[
        F.max(F.when(F.col("_goal") == s, F.col("_d"))).alias(s) for s in _STATISTICS])
