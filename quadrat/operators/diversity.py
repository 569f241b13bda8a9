"""Diversity of each sample from partial sums: one map-side combined aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import ratio

METRICS = ("richness", "shannon", "simpson", "invsimpson", "invsimpson_ref")


def alpha_diversity(ab: DataFrame, metrics: Sequence[str] = METRICS,
                    value: str = "value") -> DataFrame:
    """Diversity metrics per sample; null where the sample total is zero.

    ``invsimpson`` is 1 / sum(p^2). ``invsimpson_ref`` is 1 / (1 - sum(p^2)), the
    reciprocal of the reported Simpson index.
    """
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    sums = ab.groupBy("sample").agg(
        F.count(v).alias("_richness"), F.sum(v).alias("_s"),
        F.sum(v * F.ln(v)).alias("_e"), F.sum(v * v).alias("_q"))
    s = F.col("_s")
    concentration = ratio(F.col("_q"), s * s)
    simpson = F.lit(1.0) - concentration
    formulas = {
        "richness": F.col("_richness"),
        "shannon": F.ln(s) - ratio(F.col("_e"), s),
        "simpson": simpson,
        "invsimpson": ratio(F.lit(1.0), concentration),
        "invsimpson_ref": ratio(F.lit(1.0), simpson),
    }
    return sums.select("sample", *[formulas[m].alias(m) for m in metrics])


def alpha_long(ab: DataFrame, samples: DataFrame, metrics: Sequence[str] = METRICS,
               value: str = "value") -> DataFrame:
    """Diversity in long form (``sample, metric, value``) joined to the sample table."""
    wide = alpha_diversity(ab, metrics, value)
    wide = wide.withColumns({m: F.col(m).cast("double") for m in metrics})
    return wide.unpivot(["sample"], list(metrics), "metric", "value").join(samples, "sample")
