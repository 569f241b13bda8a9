"""Group summaries: boxes, densities, trajectories and prevalence selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.columns import ratio
from quadrat.operators.counts import exact_median, exact_quantiles, numbered, value_counts
from quadrat.storage import settle


def box_stats(df: DataFrame, keys: Sequence[str], value: str,
              weight: str | None = None) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR of the box, and the number of outliers."""
    keys = list(keys)
    counts = value_counts(df, keys, value, weight)
    boxes = exact_quantiles(counts, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v = F.col(value)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    counts = counts.withColumnRenamed("n", "_w")
    box = ["n", "q1", "median", "q3"]
    if keys:
        rows = counts.join(boxes, keys)
    else:  # one row: a scalar, not a join on a constant
        rows = counts.withColumn("_box", boxes.select(F.struct(*box)).scalar()).select(value, "_w", "_box.*")
    return rows.groupBy(*keys, *box).agg(
        F.min(F.when(inside, v)).alias("lower"), F.max(F.when(inside, v)).alias("upper"),
        F.coalesce(F.sum(F.when(~inside, F.col("_w"))), F.lit(0)).alias("outliers")
    ).select(*keys, "n", "lower", "q1", "median", "q3", "upper", "outliers")


def trajectory(df: DataFrame, time: str, group: str, value: str,
               by: Sequence[str] = ()) -> DataFrame:
    """Median and median +- 2 sd per time and group; sd is null for a single value."""
    keys = [*by, time, group]
    spread = df.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"))
    out = exact_median(df, keys, value).join(spread, keys)
    return out.withColumns({"y_min": F.col("median") - 2 * F.col("sd"),
                            "y_max": F.col("median") + 2 * F.col("sd")})


def kde(df: DataFrame, keys: Sequence[str], value: str, n: int = 512, cut: float = 3.0,
        weight: str | None = None, binned: bool = False) -> DataFrame:
    """Gaussian kernel density on an even grid that reaches ``cut`` bandwidths past the data.

    The bandwidth is 0.9 * min(sd, IQR / 1.34) * count^-0.2. Each distinct value
    meets the n grid points of its key, and the sums combine map-side. With ``binned`` a value
    first gives its weight to the two grid points beside it, in proportion to its nearness, and only grid points meet: a key
    costs n * n rows however many values it has, and the density is off by at most (step / bandwidth)^2 / 8 of the
    kernel's height 0.4 / bandwidth.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value, weight)
    quartiles = exact_quantiles(counts, keys, value, {"_q1": 0.25, "_q3": 0.75})
    v, w = F.col(value), F.col("n")
    moments = counts.groupBy(*keys).agg(
        F.sum(w).alias("_n"), (F.sum(w * v) / F.sum(w)).alias("_mean"),
        F.min(v).alias("_min"), F.max(v).alias("_max"), F.max(F.abs(v)).alias("_abs"))
    apart = v - F.col("_mean")  # squares of deviations, not a difference of large sums
    squares = counts.join(moments.select(*keys, "_mean"), keys).groupBy(*keys).agg(
        F.sum(w * apart * apart).alias("_ss"))
    moments = moments.join(squares, keys)
    sd = F.sqrt(ratio(F.col("_ss"), F.col("_n") - 1))
    stats = moments.join(quartiles.drop("n"), keys).withColumn("_sd", sd)
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    low = F.least(F.col("_sd"), iqr)
    spread = (F.when(low > 0, low).when(F.col("_sd") > 0, F.col("_sd"))
              .when(F.col("_abs") > 0, F.col("_abs")).otherwise(1.0))
    stats = stats.withColumn("bw", F.lit(0.9) * spread * F.pow(F.col("_n"), F.lit(-0.2)))
    stats = stats.select(*keys, "_n", "bw", (F.col("_min") - cut * F.col("bw")).alias("_from"),
                         (F.col("_max") + cut * F.col("bw")).alias("_to"))
    values = counts.join(stats, keys)
    if binned:
        step = (F.col("_to") - F.col("_from")) / F.lit(float(n - 1))
        place = (v - F.col("_from")) / step
        low = F.least(F.floor(place), F.lit(n - 2))
        beside = F.array(F.struct(low.alias("bin"), (w * (low + 1 - place)).alias("w")),
                         F.struct((low + 1).alias("bin"), (w * (place - low)).alias("w")))
        bins = values.select(*keys, F.inline(beside)).groupBy(*keys, "bin").agg(F.sum("w").alias("n"))
        values = bins.join(stats, keys).withColumn(value, F.col("_from") + F.col("bin") * step)
    points = values.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = F.col("_from") + F.col("point") * (F.col("_to") - F.col("_from")) / F.lit(float(n - 1))
    z = (F.col("_x") - v) / F.col("bw")
    kernel = F.col("n") * F.exp(F.lit(-0.5) * z * z)
    scale = F.lit((2 * 3.141592653589793) ** 0.5) * F.col("bw") * F.col("_n")
    return (points.withColumn("_x", x).withColumn("_k", kernel / scale)
            .groupBy(*keys, "point").agg(F.first("_x").alias("x"), F.sum("_k").alias("density")))


def select_taxa(rel: DataFrame, group: str, keep: Column, taxon: str = "taxon",
                value: str = "rel_abund", by: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """Taxa by the largest of their group medians: ``by, taxon, median``.

    ``keep`` is a predicate on the column ``median``, for example ``col("median") >= 0.5``.
    """
    medians = exact_median(rel, [*by, taxon, group], value, weight=weight)
    return medians.groupBy(*by, taxon).agg(F.max("median").alias("median")).filter(keep)


def order_by_statistic(df: DataFrame, category: str, statistic: Column,
                       descending: bool = False) -> DataFrame:
    """Categories with their position by a statistic: ``category, statistic, position``.

    Equal statistics share a position. The distinct ones are numbered within buckets of their value
    (``counts.numbered``), not in one window; missing ones come first in ascending order and last in descending order.
    """
    table = settle(df.groupBy(category).agg(statistic.alias("statistic")), "statistics")
    value = F.col("statistic").cast("double")
    known = table.where("statistic IS NOT NULL").select((-value if descending else value).alias("_key")).distinct()
    places = numbered(known, [], "_key", out="position")
    missing = table.where("statistic IS NULL")
    before = F.lit(1 if not descending and missing.head(1) else 0)
    placed = table.withColumn("_key", -value if descending else value).join(places, "_key").select(
        category, "statistic", (F.col("position") + before).cast("int").alias("position"))
    last = F.lit(known.count() + 1 if descending else 1)
    return placed.unionByName(missing.select(category, "statistic", last.alias("position")))
