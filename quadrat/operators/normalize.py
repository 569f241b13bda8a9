"""Relative abundance, standardisation and collapse to a taxonomic rank.

Abundance is long and sparse: one row per (sample, feature) with a non-zero
``value``; a missing pair counts as zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import ratio
from quadrat.operators.counts import midrank, positions, value_counts

METHODS = ("total", "max", "freq", "normalize", "range", "standardize", "pa",
           "hellinger", "chi.square", "log", "rank")


def wide_to_long(df: DataFrame, ids: Sequence[str] = ("sample",), name: str = "feature",
                 value: str = "value", drop_zeros: bool = False) -> DataFrame:
    """Unpivot a sample-by-feature table, optionally keeping only non-zero cells."""
    out = df.unpivot(list(ids), None, name, value)
    return out.filter(F.col(value) != 0) if drop_zeros else out


def relative_abundance(ab: DataFrame, scale: float = 1.0, out: str = "rel_abund") -> DataFrame:
    """Share of each feature in its sample; null where the sample total is zero.

    The totals are a map-side combined aggregate joined back, so a very long
    sample is never sorted or buffered in one task.
    """
    totals = ab.groupBy("sample").agg(F.sum("value").alias("_total"))
    return (ab.join(totals, "sample")
            .withColumn(out, ratio(F.lit(float(scale)) * F.col("value"), F.col("_total")))
            .drop("_total"))


def standardize(ab: DataFrame, method: str, log_base: float = 2.0) -> DataFrame:
    """Community-table standardisation of the stored cells.

    Returns ``sample, feature, value, background``; ``background`` is what a
    cell that is not stored becomes (non-zero only for ``range`` and
    ``standardize``), so that a table never has to be filled in.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    v = F.col("value").cast("double")
    ab = ab.select("sample", "feature", v.alias("value"))
    v = F.col("value")
    zero = F.lit(0.0)

    def done(df, value, background=zero):
        return df.select("sample", "feature", value.alias("value"), background.alias("background"))

    if method == "pa":
        return done(ab, F.when(v > 0, 1.0).otherwise(0.0))
    if method == "log":
        smallest = ab.filter(v > 0).agg(F.min("value")).scalar()
        x = F.when(smallest < 1.0, v / smallest).otherwise(v)
        return done(ab, F.when(v > 0, F.ln(x) / F.ln(F.lit(log_base)) + 1.0).otherwise(0.0))
    if method == "rank":
        counts = value_counts(ab.filter(v > 0), ["sample"], "value")
        ranks = positions(counts, ["sample"], "value").select(
            "sample", "value", midrank().alias("_rank"))
        return done(ab.join(ranks, ["sample", "value"], "left"), F.coalesce("_rank", zero))
    if method in ("total", "hellinger", "normalize"):
        size = F.sqrt(F.sum(v * v)) if method == "normalize" else F.sum(v)
        x = ratio(v, F.col("_size"))
        rows = ab.join(ab.groupBy("sample").agg(size.alias("_size")), "sample")
        return done(rows, F.sqrt(x) if method == "hellinger" else x)
    if method == "chi.square":
        rows = (ab.join(ab.groupBy("sample").agg(F.sum(v).alias("_row")), "sample")
                .join(ab.groupBy("feature").agg(F.sum(v).alias("_col")), "feature"))
        grand = ab.agg(F.sum("value")).scalar()
        return done(rows, F.sqrt(grand) * ratio(v, F.col("_row") * F.sqrt("_col")))

    stats = ab.groupBy("feature").agg(
        F.sum(v).alias("_sum"), F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"), F.min(v).alias("_min"),
        F.max(v).alias("_max"), F.count(F.lit(1)).alias("_stored"),
        F.sum((v != 0).cast("bigint")).alias("_nonzero"))
    n = ab.select("sample").distinct().agg(F.count(F.lit(1))).scalar()
    rows = ab.join(stats, "feature").withColumn("_n", n)
    complete = F.col("_stored") == F.col("_n")
    low = F.when(complete, F.col("_min")).otherwise(F.least(F.col("_min"), zero))
    high = F.when(complete, F.col("_max")).otherwise(F.greatest(F.col("_max"), zero))
    if method == "max":
        return done(rows, ratio(v, high))
    if method == "freq":
        return done(rows, ratio(v * F.col("_nonzero"), F.col("_sum")))
    if method == "range":
        return done(rows, ratio(v - low, high - low), ratio(-low, high - low))
    # the stored cells' moments merged with those of the implicit zeros: no difference of large sums
    share = F.col("_stored") / F.col("_n")
    mean = F.col("_mean") * share
    squares = F.col("_stored") * (F.col("_var") + F.col("_mean") * F.col("_mean") * (F.lit(1.0) - share))
    var = ratio(squares, F.col("_n") - 1)
    return done(rows, ratio(v - mean, F.sqrt(var)), ratio(-mean, F.sqrt(var)))


def collapse(ab: DataFrame, taxonomy: DataFrame, level: str, value: str = "value",
             by: Sequence[str] = ()) -> DataFrame:
    """Sum abundance within the taxa of one rank: ``sample, *by, taxon, value``.

    Only the requested rank is read from the taxonomy.
    """
    ranks = taxonomy.select("feature", F.col(level).alias("taxon"))
    return (ab.join(ranks, "feature").groupBy("sample", *by, "taxon")
            .agg(F.sum(value).alias(value)))


def exact_sum(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum per key that does not depend on the order of rows, for values of any size.

    Values are summed as decimals within spans of 32 binary orders, each scaled by its power of two, so
    that small values keep their digits; the few spans of a key are then added from the largest down.
    """
    v = F.col(value).cast("double")
    span = F.greatest(F.lit(-31), F.least(F.lit(31), F.coalesce(F.floor(F.log2(F.abs(v)) / 32).cast("int"), F.lit(0))))
    spans = df.select(*keys, span.alias("_span"), (v / F.pow(F.lit(2.0), 32 * span)).cast("decimal(38,20)").alias("_v"))
    spans = spans.groupBy(*keys, "_span").agg(F.sum("_v").cast("double").alias("_s"))
    ordered = F.sort_array(F.collect_list(F.struct("_span", "_s")), asc=False)
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["_s"] * F.pow(F.lit(2.0), 32 * x["_span"]))
    return spans.groupBy(*keys).agg(total.alias(out))


def taxon_shares(ab: DataFrame, taxonomy: DataFrame, level: str, scale: float = 1.0) -> DataFrame:
    """Share of each taxon of a rank in its sample: ``sample, taxon, rel_abund``.

    Sums do not depend on the order of the rows (``exact_sum``) and each share is one division by the
    sample's sum, so equal counts tie. Null where the total is zero.
    """
    ranks = taxonomy.select("feature", F.col(level).alias("taxon"))
    taxa = exact_sum(ab.join(ranks, "feature"), ["sample", "taxon"], "value", "value")
    totals = exact_sum(ab, ["sample"], "value", "_total")
    return taxa.join(totals, "sample").select("sample", "taxon", (F.lit(float(scale)) * ratio(
        F.col("value"), F.col("_total"))).alias("rel_abund"))


def taxonomy_long(taxonomy: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """One row per (feature, level, taxon)."""
    return taxonomy.unpivot(["feature"], list(ranks), "level", "taxon")
