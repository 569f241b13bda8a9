"""Exact ranks and quantiles within groups of any size.

Rank statistics and medians need the position of a value within its group. A
window over the group would sort a hot group in one task. Here the group is
first reduced to weighted distinct values (combined map-side), and each value
gets a bucket that depends on the value alone and grows with it. Rows are then
sorted only within (group, bucket); a small table of bucket totals supplies what
lies below each bucket. A group that holds a third of all rows is thus spread
over as many tasks as it has buckets, and the ranks are exact.

The distinct values are written once before they are ranked: ranks and bucket
totals must see the same bits, and a recomputed floating-point sum may differ in
its last one. Weighted input counts as written already.

Key columns must not be null: label missing categories first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.storage import settle

BUCKETS_PER_OCTAVE = 1024
_CENTRE = 2_000_000  # larger than 1075 * BUCKETS_PER_OCTAVE: keeps codes of one sign apart
_FAR = 5_000_000


def value_bucket(v: Column) -> Column:
    """Order-preserving coarse code of a finite or infinite double."""
    size = F.abs(v)
    code = F.floor(F.log2(size) * BUCKETS_PER_OCTAVE) + F.lit(_CENTRE)
    code = F.when(size == F.lit(float("inf")), F.lit(_FAR)).otherwise(code)
    return F.when(v == 0, F.lit(0)).when(v > 0, code).otherwise(-code).cast("int")


def value_counts(df: DataFrame, keys: Sequence[str], value: str,
                 weight: str | None = None, written: bool = False) -> DataFrame:
    """Distinct values per key with their number ``n``; null and NaN are left out."""
    v = F.col(value).cast("double")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    out = (df.filter(v.isNotNull() & ~F.isnan(v))
           .groupBy(*keys, v.alias(value)).agg(n.cast("bigint").alias("n")))
    return settle(out, "values") if weight is None and not written else out


def positions(counts: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Add ``_below``, ``_ties`` and ``_total`` to weighted values.

    ``_below`` is the weight of strictly smaller values of the key, ``_ties`` the
    weight of equal ones (over all rows with that value), ``_total`` the weight
    of the key.
    """
    keys = list(keys)
    rows = counts.withColumn("_bucket", value_bucket(F.col(value)))
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(value)
    upto = F.sum(n).over(in_bucket.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # same rows, same order: the peers of a value need neither another shuffle nor a sort
    equal = F.sum(n).over(Window.partitionBy(*keys, "_bucket", value))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(n).alias("_in"))
    offsets = totals.select(
        *keys, "_bucket",
        (F.sum("_in").over(of_key.orderBy("_bucket")) - F.col("_in")).alias("_offset"),
        F.sum("_in").over(of_key).alias("_total"),
    )
    return (rows.withColumn("_upto", upto).withColumn("_ties", equal)
            .join(offsets, [*keys, "_bucket"])
            .withColumn("_below", F.col("_offset") + F.col("_upto") - F.col("_ties"))
            .drop("_offset", "_upto", "_bucket"))


def midrank(below: str = "_below", ties: str = "_ties") -> Column:
    return F.col(below) + (F.col(ties) + 1) / F.lit(2.0)


def exact_quantiles(counts: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], n: str = "n") -> DataFrame:
    """Interpolated quantiles (type 7) of weighted values, one column per entry of ``probs``."""
    placed = positions(counts, keys, value, n)
    aggs = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(h)
        high = F.least(low + 1, F.col("_total") - 1)
        at = lambda r: F.max(F.when((F.col("_below") <= r) & (r < F.col("_below") + F.col("_ties")),
                                    F.col(value)))
        aggs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"),
                 F.max(h - low).alias(f"_fr_{name}")]
    out = placed.groupBy(*keys).agg(*aggs, F.max("_total").alias("n"))
    return out.select(*keys, "n", *[
        (F.col(f"_lo_{k}") + F.col(f"_fr_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k)
        for k in probs])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 weight: str | None = None) -> DataFrame:
    return exact_quantiles(value_counts(df, keys, value, weight), keys, value, {name: 0.5})


def numbered(df: DataFrame, keys: Sequence[str], order: str, *ties: str, out: str = "no") -> DataFrame:
    """Rows with their number within the key, from 1, by a numeric column and then by ``ties``; nulls come first.

    Rows are sorted within buckets of the value only; bucket sizes supply what comes before, so a key with a third of
    all rows is sorted by as many tasks as it has buckets.
    """
    keys = list(keys)
    v = F.col(order).cast("double")
    rows = df.withColumn("_bucket", F.when(F.isnan(v), F.lit(2 * _FAR)).otherwise(F.coalesce(value_bucket(v), F.lit(-2 * _FAR))))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = sizes.select(*keys, "_bucket", (F.sum("_in").over(of_key.orderBy("_bucket")) - F.col("_in")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, *ties))
    return (rows.withColumn("_own", own).join(before, [*keys, "_bucket"])
            .withColumn(out, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before"))


def following_minimum(df: DataFrame, keys: Sequence[str], order: str, value: Column, *ties: Column, out: str = "_least") -> DataFrame:
    """Smallest ``value`` among a row and all after it by a numeric column, then ``ties``, within the key.

    Within a bucket of the order column by a window; the smallest of all later buckets is carried over a table of buckets.
    """
    keys = list(keys)
    rows = df.withColumns({"_bucket": value_bucket(F.col(order)), "_value": value})
    onward = lambda w: w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lows = rows.groupBy(*keys, "_bucket").agg(F.min("_value").alias("_low"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    later = lows.select(*keys, "_bucket", F.min("_low").over(
        of_key.orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    own = F.min("_value").over(onward(Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)))
    return (rows.withColumn("_own", own).join(later, [*keys, "_bucket"])
            .withColumn(out, F.least("_own", "_later")).drop("_bucket", "_value", "_own", "_later"))


def ordered_pairs(levels: DataFrame) -> DataFrame:
    """``number, first, second`` of all pairs of ``label`` in order; the pairs of a level are numbered one after another.

    A level's place in the order says how many pairs start with it, so each pair is an equi-join of the places.
    """
    placed = settle(levels.withColumn("_at", F.row_number().over(Window.orderBy("label"))), "levels")
    count = placed.count()
    heads = placed.withColumn("_to", F.explode(F.when(F.col("_at") < count, F.sequence(F.col("_at") + 1, F.lit(count)))))
    number = (F.col("_at") - 1) * count - F.expr("_at * (_at - 1) / 2") + (F.col("_to") - F.col("_at")) - 1
    return heads.join(placed.select(F.col("label").alias("second"), F.col("_at").alias("_to")), "_to").select(
        number.cast("int").alias("number"), F.col("label").alias("first"), "second")
