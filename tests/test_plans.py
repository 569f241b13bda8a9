"""Physical plans: what must not appear at scale."""

import pytest
from pyspark.sql import functions as F

from quadrat.operators import counts, distance, diversity, multitest, normalize, permanova, ranktests, summaries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "ab")
    spark.range(2000).select(
        F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("sample"),
        F.concat(F.lit("f"), (F.col("id") / 20).cast("int").cast("string")).alias("feature"),
        (F.col("id") % 7 + 1).cast("double").alias("value"), F.lit("x").alias("unused"),
        F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("grp")).write.parquet(path)
    return spark.read.parquet(path)


def test_no_nested_loops_or_row_udfs(stored):
    who = stored.select("sample", F.col("sample").alias("subject"), (F.lit(0)).alias("day")).distinct()
    frames = {
        "relative": normalize.relative_abundance(stored),
        "alpha": diversity.alpha_diversity(stored),
        "chi": normalize.standardize(stored, "chi.square"),
        "median": counts.exact_median(stored, ["grp"], "value"),
        "box": summaries.box_stats(stored, [], "value"),
        "kruskal": ranktests.kruskal(stored, ["feature"], "value", "grp"),
        "wilcox": ranktests.rank_sum(stored, ["feature"], "value", "grp", levels=["u", "v"], exact=False),
        "bh": multitest.p_adjust(stored.withColumn("p", F.col("value") / 10)),
        "baseline": distance.baseline_dissimilarity(stored, who),
        "bray": distance.bray_curtis(stored),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "BatchEvalPython" not in text, name
        if name not in ("bray",):
            assert "Pandas" not in text, name


def test_scan_reads_only_needed_columns(stored):
    text = plan(diversity.alpha_diversity(stored, ["shannon"]))
    assert "unused" not in text and "grp" not in text
    assert text.count("Exchange") == 1  # one shuffle, by sample
    assert "partial_sum" in text


def test_hot_key_is_spread_over_buckets(stored):
    spread = counts.value_counts(stored.withColumn("v", F.rand(1) + F.lit(1.0)).withColumn("k", F.lit("one")), ["k"], "v")
    assert spread.select(counts.value_bucket(F.col("v"))).distinct().count() > 500


def test_level_pairs_need_no_join(spark):
    dist = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.7), ("b", "c", 0.2), ("c", "d", 0.1), ("a", "d", 0.9), ("b", "d", 0.4)],
                                 "a string, b string, d double")
    who = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "sample string, grp string")
    got = permanova.permanova_pairwise(dist, who, "grp", 9).select("level1", "level2", "n", "p").collect()
    assert sorted(tuple(r)[:3] for r in got) == [("x", "y", 3), ("x", "z", 3), ("y", "z", 2)]
    assert [r.level1 for r in got if r.p is None] == ["y"]  # two samples leave no residual
