"""Correction for multiple tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.counts import positions, value_bucket, value_counts
from quadrat.storage import settle


def p_adjust(df: DataFrame, p: str = "p", method: str = "BH", family: Sequence[str] = (),
             out: str = "p_adj", bounded: bool = False) -> DataFrame:
    """Benjamini-Hochberg (``BH``/``fdr``), ``bonferroni`` or ``none`` within a family.

    Null p-values stay null and do not count. ``bounded=True`` says that a
    family is small by construction (the level pairs of one test); then one
    window does it. Otherwise a family may hold any number of tests: it is
    ranked over value buckets, and the running minimum from the largest p
    downwards is taken within buckets and carried across them.
    """
    family = list(family)
    if method == "none":
        return df.withColumn(out, F.col(p))
    if method == "bonferroni":
        def capped(n):  # least() would pass over a null p
            return F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * n))
        if bounded:
            return df.withColumn(out, capped(F.count(p).over(Window.partitionBy(*family))))
        if not family:
            return df.withColumn(out, capped(df.agg(F.count(p)).scalar()))
        sizes = df.groupBy(*family).agg(F.count(p).alias("_n"))
        return df.join(sizes, family).withColumn(out, capped(F.col("_n"))).drop("_n")
    if method not in ("BH", "fdr"):
        raise ValueError(f"unknown correction {method!r}")

    if bounded:
        within = Window.partitionBy(*family)
        up = within.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        down = within.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding,
                                                            Window.currentRow)
        scaled = F.count(p).over(within) * F.col(p) / F.count(p).over(up)
        return (df.withColumn("_q", F.when(F.col(p).isNotNull(), scaled))
                .withColumn(out, F.when(F.col(p).isNotNull(),
                                        F.least(F.lit(1.0), F.min("_q").over(down))))
                .drop("_q"))

    df = settle(df, "tests")
    placed = positions(value_counts(df, family, p, written=True), family, p)
    q = (placed.withColumn("_q", F.col("_total") * F.col(p) / (F.col("_below") + F.col("_ties")))
         .withColumn("_bucket", value_bucket(F.col(p))))
    of_family = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    later = of_family.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = q.groupBy(*family, "_bucket").agg(F.min("_q").alias("_least")).select(
        *family, "_bucket", F.min("_least").over(later).alias("_carried"))
    local = Window.partitionBy(*family, "_bucket").orderBy(F.col(p).desc())
    adjusted = (q.withColumn("_local", F.min("_q").over(local))
                .join(carried, [*family, "_bucket"])
                .select(*family, p, F.least(F.lit(1.0), F.col("_local"), F.col("_carried"))
                        .alias(out)))
    return df.join(adjusted, [*family, p], "left").select(*df.columns, out)
