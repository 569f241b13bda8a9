"""Abundance, diversity, tests and summaries on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import *  # noqa: F403
from catalog.base import (LEVELS, REF, abundance, customer_abundance, query, rounded, samples,
                          sql_bh, sql_kruskal, sql_nulls, sql_wilcox, table, taxonomy)
from quadrat.functions.columns import p_symbol
from quadrat.operators import diversity, multitest, normalize, ranktests, summaries
from quadrat.operators.counts import exact_median

A, S, T = ("abundance",), ("samples",), ("taxonomy",)


@query("relative_abundance", "SELECT sample, feature, round(rel_abund, 6) AS rel_abund FROM rel", ["rel"])
def _(spark, sf):
    out = normalize.relative_abundance(abundance(spark, sf), 100.0)
    return rounded(out.select("sample", "feature", "rel_abund"))


_STANDARD = {
    "total": "value / SUM(value) OVER (PARTITION BY sample)",
    "hellinger": "sqrt(value / SUM(value) OVER (PARTITION BY sample))",
    "normalize": "value / sqrt(SUM(value * value) OVER (PARTITION BY sample))",
    "max": "value / MAX(value) OVER (PARTITION BY feature)",
    "freq": "value * COUNT(*) OVER (PARTITION BY feature) / SUM(value) OVER (PARTITION BY feature)",
    "pa": "1e0",
    "log": "ln(value) / ln(2) + 1",
    "rank": "RANK() OVER (PARTITION BY sample ORDER BY value) + (COUNT(*) OVER (PARTITION BY sample, value) - 1) / 2e0",
    "chi.square": "sqrt(SUM(value) OVER ()) * value / (SUM(value) OVER (PARTITION BY sample) * sqrt(SUM(value) OVER (PARTITION BY feature)))",
}


def _standardized(method):
    def run(spark, sf):
        return rounded(normalize.standardize(abundance(spark, sf), method))
    return run


for _m, _sql in _STANDARD.items():
    query("standardize_" + _m.replace(".", "_"),
          f"SELECT sample, feature, round(CAST({_sql} AS DOUBLE), 6) AS value, 0e0 AS background FROM abundance", A)(
        _standardized(_m))

_FULL = """full_table AS (SELECT s.sample, f.feature, COALESCE(a.value, 0) AS value, a.value IS NOT NULL AS stored
    FROM (SELECT DISTINCT sample FROM abundance) s CROSS JOIN (SELECT DISTINCT feature FROM abundance) f
    LEFT JOIN abundance a ON a.sample = s.sample AND a.feature = f.feature),
  st AS (SELECT *, MIN(value) OVER (PARTITION BY feature) AS lo, MAX(value) OVER (PARTITION BY feature) AS hi,
    AVG(value) OVER (PARTITION BY feature) AS mu, STDDEV_SAMP(value) OVER (PARTITION BY feature) AS sd FROM full_table)"""
query("standardize_range", f"WITH {_FULL} SELECT sample, feature, round((value - lo) / (hi - lo), 6) AS value, round((0 - lo) / (hi - lo), 6) + 0 AS background FROM st WHERE stored", A)(_standardized("range"))
query("standardize_standardize", f"WITH {_FULL} SELECT sample, feature, round((value - mu) / sd, 6) + 0 AS value, round(-mu / sd, 6) AS background FROM st WHERE stored", A)(_standardized("standardize"))


@query("collapse_to_rank", """SELECT sample, grp, phylum AS taxon, round(SUM(rel_abund), 6) AS rel_abund
    FROM rel JOIN samples USING (sample) JOIN taxonomy USING (feature) GROUP BY 1, 2, 3""", ["rel", "samples", "taxonomy"])
def _(spark, sf):
    rel = normalize.relative_abundance(abundance(spark, sf), 100.0).join(
        samples(spark, sf).select("sample", "grp"), "sample")
    return rounded(normalize.collapse(rel, taxonomy(spark, sf), "phylum", "rel_abund", by=["grp"]))


@query("alpha_diversity", """SELECT sample, richness, round(shannon, 6) AS shannon, round(simpson, 6) AS simpson,
    round(1 / (1 - simpson), 6) AS invsimpson, round(1 / simpson, 6) AS invsimpson_ref FROM shannon""", ["shannon"])
def _(spark, sf):
    return rounded(diversity.alpha_diversity(abundance(spark, sf)))


@query("alpha_long", """SELECT sample, metric, round(value, 6) AS value, grp, timepoint, sex FROM (
    SELECT sample, 'richness' AS metric, CAST(richness AS DOUBLE) AS value FROM shannon
    UNION ALL SELECT sample, 'shannon', shannon FROM shannon UNION ALL SELECT sample, 'simpson', simpson FROM shannon)
    JOIN samples USING (sample)""", ["shannon", "samples"])
def _(spark, sf):
    who = samples(spark, sf).select("sample", "grp", "timepoint", "sex")
    return rounded(diversity.alpha_long(abundance(spark, sf), who, ["richness", "shannon", "simpson"]))


@query("alpha_trajectory", """SELECT timepoint, grp, COUNT(*) AS n, round(median(shannon), 6) AS median, round(stddev_samp(shannon), 6) AS sd,
    round(median(shannon) - 2 * stddev_samp(shannon), 6) AS y_min, round(median(shannon) + 2 * stddev_samp(shannon), 6) AS y_max
    FROM shannon JOIN samples USING (sample) GROUP BY 1, 2""", ["shannon", "samples"])
def _(spark, sf):
    div = diversity.alpha_diversity(abundance(spark, sf), ["shannon"]).join(samples(spark, sf), "sample")
    return rounded(summaries.trajectory(div, "timepoint", "grp", "shannon"))


# ---- rank tests ------------------------------------------------------------------

_TAXA = """taxa AS (SELECT s.sample, s.grp, s.timepoint, s.sex, t.taxon, COALESCE(r.v, 0) AS v
    FROM samples s CROSS JOIN (SELECT DISTINCT genus AS taxon FROM taxonomy) t
    LEFT JOIN (SELECT sample, genus AS taxon, 100 * SUM(value) / any_value(total) AS v FROM abundance JOIN totals USING (sample) JOIN taxonomy USING (feature) GROUP BY 1, 2) r
    ON r.sample = s.sample AND r.taxon = t.taxon)"""
_RTV = ["totals", "samples", "taxonomy"]


def taxon_counts(spark, sf, level="genus", context=()):
    """Weighted values of every taxon and group, zeros completed by count."""
    who = samples(spark, sf).select("sample", "grp", *context)
    taxa = normalize.taxon_shares(abundance(spark, sf), taxonomy(spark, sf), level, 100.0).join(who, "sample")
    counts = ranktests.group_counts(taxa, [*context, "taxon"], "rel_abund", "grp")
    sizes = who.groupBy(*context, "grp").agg(F.count(F.lit(1)).alias("size"))
    return ranktests.add_implicit_zeros(counts, sizes, list(context), "taxon", "rel_abund", "grp")


@query("kruskal_by_taxon", f"""WITH {_TAXA}, kw AS ({sql_kruskal('taxa', 'taxon', 'v', 'grp')}),
    adj AS ({sql_bh('kw', 'p', '')})
    SELECT taxon, CAST(n AS BIGINT) AS n, CAST(groups AS INT) AS groups, round(statistic, 6) AS statistic, df, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM adj""", _RTV)
def _(spark, sf):
    tests = ranktests.kruskal(taxon_counts(spark, sf), ["taxon"], "rel_abund", "grp", "n")
    return rounded(multitest.p_adjust(tests))


@query("kruskal_odd_df", f"""WITH four AS (SELECT * FROM samples JOIN shannon USING (sample) WHERE grp <> 'ASIA'),
    kw AS ({sql_kruskal('four', 'timepoint', 'shannon', 'grp')})
    SELECT timepoint, CAST(n AS BIGINT) AS n, CAST(groups AS INT) AS groups, round(statistic, 6) AS statistic, df, round(p, 6) AS p FROM kw""", ["samples", "shannon"])
def _(spark, sf):
    div = diversity.alpha_diversity(abundance(spark, sf), ["shannon"]).join(samples(spark, sf), "sample")
    return rounded(ranktests.kruskal(div.filter(F.col("grp") != "ASIA"), ["timepoint"], "shannon", "grp"))


_PAIRS_ALL = "SELECT y.g AS group1, x.g AS group2 FROM lv x JOIN lv y ON x.g < y.g"
_PAIRS_REF = f"SELECT '{REF}' AS group1, g AS group2 FROM lv WHERE g <> '{REF}'"
_LV = "lv AS (SELECT DISTINCT r_name AS g FROM region)"
_TEST_OUT = "round(statistic, 6) AS statistic, round(p, 6) AS p, method, round(p_adj, 6) AS p_adj"


@query("pairwise_wilcox_by_taxon", f"""WITH {_TAXA}, {_LV}, w AS ({sql_wilcox('taxa', 'taxon', 'v', 'grp', _PAIRS_ALL)}),
    adj AS ({sql_bh('w', 'p', 'taxon')}) SELECT taxon, group1, group2, n1, n2, {_TEST_OUT} FROM adj""", _RTV)
def _(spark, sf):
    return rounded(ranktests.rank_sum(taxon_counts(spark, sf), ["taxon"], "rel_abund", "grp",
                                      "all", LEVELS, exact=False, weight="n"))


_SIZES = "SELECT CAST(x.c AS INT) AS m, CAST(y.c AS INT) AS k FROM gs x JOIN gs y USING (timepoint) WHERE x.grp = 'AFRICA' AND y.grp <> 'AFRICA'"
_GS = "gs AS (SELECT timepoint, grp, COUNT(*) AS c FROM samples GROUP BY 1, 2)"


@query("wilcox_vs_reference", f"""WITH RECURSIVE {_GS}, {sql_nulls(_SIZES)}, {_LV}, dv AS (SELECT * FROM shannon JOIN samples USING (sample)),
    w AS ({sql_wilcox('dv', 'timepoint', 'shannon', 'grp', _PAIRS_REF, 'less', True)}),
    adj AS ({sql_bh('w', 'p', 'timepoint')}) SELECT timepoint, group1, group2, n1, n2, {_TEST_OUT} FROM adj""", ["shannon", "samples"])
def _(spark, sf):
    div = diversity.alpha_diversity(abundance(spark, sf), ["shannon"]).join(samples(spark, sf), "sample")
    return rounded(ranktests.rank_sum(div, ["timepoint"], "shannon", "grp", REF, LEVELS, "less"))


@query("wilcox_selected_pairs", f"""WITH {_LV}, dv AS (SELECT * FROM shannon JOIN samples USING (sample)),
    w AS ({sql_wilcox('dv', 'sex', 'shannon', 'grp', "SELECT * FROM (VALUES ('AFRICA', 'ASIA'), ('ASIA', 'EUROPE'), ('AFRICA', 'EUROPE')) t(group1, group2)")})
    SELECT sex, group1, group2, n1, n2, round(statistic, 6) AS statistic, round(p, 6) AS p, method,
      CASE WHEN p IS NULL THEN NULL WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS label FROM w""", ["shannon", "samples"])
def _(spark, sf):
    div = diversity.alpha_diversity(abundance(spark, sf), ["shannon"]).join(samples(spark, sf), "sample")
    out = ranktests.rank_sum(div, ["sex"], "shannon", "grp",
                             [("AFRICA", "ASIA"), ("ASIA", "EUROPE"), ("AFRICA", "EUROPE")],
                             correction=None, exact=False)
    return rounded(out.withColumn("label", p_symbol(F.col("p"))))


@query("wilcox_location_shift", f"""WITH RECURSIVE {_GS}, {sql_nulls(_SIZES)}, dv AS (SELECT timepoint, grp, shannon FROM shannon JOIN samples USING (sample)),
    cut AS (SELECT nm, nk, greatest(1, COUNT(*) FILTER (cdf < 0.025)) AS q FROM nulls GROUP BY 1, 2),
    dd AS (SELECT x.timepoint, x.grp AS group1, y.grp AS group2, x.shannon - y.shannon AS d FROM dv x JOIN dv y ON x.timepoint = y.timepoint
      WHERE x.grp = 'AFRICA' AND y.grp <> 'AFRICA'),
    placed AS (SELECT dd.*, ROW_NUMBER() OVER (PARTITION BY dd.timepoint, group1, group2 ORDER BY d) AS r, gx.c * gy.c AS pairs, q FROM dd
      JOIN gs gx ON gx.timepoint = dd.timepoint AND gx.grp = group1 JOIN gs gy ON gy.timepoint = dd.timepoint AND gy.grp = group2
      JOIN cut ON nm = gx.c AND nk = gy.c)
    SELECT timepoint, group1, group2, round(median(d), 6) AS estimate, round(MAX(d) FILTER (r = q), 6) AS conf_low,
      round(MAX(d) FILTER (r = pairs + 1 - q), 6) AS conf_high FROM placed GROUP BY 1, 2, 3""", ["shannon", "samples"])
def _(spark, sf):
    div = diversity.alpha_diversity(abundance(spark, sf), ["shannon"]).join(samples(spark, sf), "sample")
    out = ranktests.rank_sum(div, ["timepoint"], "shannon", "grp", REF, LEVELS, detailed=True)
    return rounded(out.select("timepoint", "group1", "group2", "estimate", "conf_low", "conf_high"))


@query("bh_one_family", f"""WITH pv AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE (o_orderkey * 7919 % 100003) / 100003e0 END AS p FROM orders),
    adj AS ({sql_bh('pv', 'p', '')}) SELECT o_orderkey, round(p, 8) AS p, round(p_adj, 8) AS p_adj FROM adj""")
def _(spark, sf):
    p = F.when(F.col("o_orderpriority") != "1-URGENT", (F.col("o_orderkey") * 7919 % 100003) / F.lit(100003.0))
    df = table(spark, sf, "orders").select("o_orderkey", p.alias("p"))
    return rounded(multitest.p_adjust(df), 8)


@query("bonferroni_by_family", """SELECT o_orderkey, o_orderpriority, round(p, 8) AS p, round(least(1, p * COUNT(p) OVER (PARTITION BY o_orderpriority)), 8) AS p_adj
    FROM (SELECT o_orderkey, o_orderpriority, (o_orderkey * 7919 % 100003) / 100003e2 AS p FROM orders)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (
        (F.col("o_orderkey") * 7919 % 100003) / F.lit(10000300.0)).alias("p"))
    return rounded(multitest.p_adjust(df, method="bonferroni", family=["o_orderpriority"]), 8)


@query("significance_stars", """SELECT o_orderkey, CASE WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS label
    FROM (SELECT o_orderkey, (o_orderkey * 7919 % 100003) / 100003e0 AS p FROM orders)""")
def _(spark, sf):
    p = (F.col("o_orderkey") * 7919 % 100003) / F.lit(100003.0)
    return table(spark, sf, "orders").select("o_orderkey", p_symbol(p).alias("label"))


# ---- summaries -------------------------------------------------------------------

@query("box_statistics", """WITH q AS (SELECT l_returnflag, l_linestatus, COUNT(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med,
    quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, l_linestatus, n, MIN(l_extendedprice) FILTER (i) AS lower, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
      MAX(l_extendedprice) FILTER (i) AS upper, COUNT(*) FILTER (NOT i) AS outliers
    FROM (SELECT *, l_extendedprice BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS i FROM lineitem JOIN q USING (l_returnflag, l_linestatus))
    GROUP BY l_returnflag, l_linestatus, n, q1, med, q3""")
def _(spark, sf):
    return rounded(summaries.box_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                                       "l_extendedprice"))


@query("kernel_density", """WITH s AS (SELECT event_type, COUNT(*) AS n, min(value) AS lo, max(value) AS hi,
      0.9e0 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(COUNT(*), -0.2) AS bw FROM events GROUP BY 1),
    g AS (SELECT *, lo - 3 * bw + point * ((hi + 3 * bw) - (lo - 3 * bw)) / 511e0 AS x FROM s, (SELECT unnest(range(0, 512)) AS point))
    SELECT g.event_type, CAST(point AS INT) AS point, round(x, 6) AS x, round(SUM(exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (sqrt(2 * pi()) * bw * n), 6) AS density
    FROM g JOIN events e ON e.event_type = g.event_type GROUP BY g.event_type, point, x, bw, n""")
def _(spark, sf):
    return rounded(summaries.kde(table(spark, sf, "events"), ["event_type"], "value"))


@query("prevalent_taxa", f"""WITH {_TAXA} SELECT taxon, round(MAX(m), 6) AS median FROM (SELECT taxon, grp, median(v) AS m FROM taxa GROUP BY 1, 2) GROUP BY 1 HAVING MAX(m) >= 4""", _RTV)
def _(spark, sf):
    return rounded(summaries.select_taxa(taxon_counts(spark, sf), "grp", F.col("median") >= 4, weight="n"))


@query("exact_median_by_group", """SELECT l_returnflag, round(median(l_extendedprice), 6) AS median, COUNT(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    return rounded(exact_median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("order_by_statistic", """SELECT source, round(statistic, 6) AS statistic, DENSE_RANK() OVER (ORDER BY statistic DESC) AS position
    FROM (SELECT source, AVG(n_chars) AS statistic FROM documents GROUP BY 1)""")
def _(spark, sf):
    out = summaries.order_by_statistic(table(spark, sf, "documents"), "source", F.avg("n_chars"), True)
    return rounded(out.withColumn("position", F.col("position").cast("bigint")))
