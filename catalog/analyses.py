"""The complete analyses on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (LEVELS, REF, TIMEPOINTS, abundance, annotations, change_groups, clusters, gene_counts,
                          mapping, quality, query, rounded, samples, sql_bh, sql_euclid, sql_kruskal, sql_linkage, sql_nulls, sql_wilcox,
                          table, taxonomy, transit_wide)
from catalog.clusters import RULES, _RULE_SQL
from catalog.distances import _PERM_OUT, _sql_permanova
from quadrat.plans import analyses as plans
from quadrat.sources import delimited
from quadrat.storage import scratch_path

OUT = ("M_Day1", "F_Day4")
_OUT = "cohort NOT IN ('M_Day1', 'F_Day4')"
_TEST = "group1, group2, n1, n2, round(statistic, 6) AS statistic, round(p, 6) AS p, method"
_LV = "lv AS (SELECT DISTINCT r_name AS g FROM region)"
_REFPAIRS = f"SELECT '{REF}' AS group1, g AS group2 FROM lv WHERE g <> '{REF}'"
_ALLPAIRS = "SELECT y.g AS group1, x.g AS group2 FROM lv x JOIN lv y ON x.g < y.g"
_SELECTED = "SELECT * FROM (VALUES ('AFRICA', 'AMERICA'), ('AMERICA', 'ASIA'), ('AFRICA', 'ASIA')) t(group1, group2)"
_STARS = "CASE WHEN p IS NULL THEN NULL WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS label"


def _sizes(source, keys):
    return (f"SELECT CAST(x.c AS INT) AS m, CAST(y.c AS INT) AS k FROM (SELECT {keys}, grp, COUNT(*) AS c FROM {source} GROUP BY ALL) x "
            f"JOIN (SELECT {keys}, grp, COUNT(*) AS c FROM {source} GROUP BY ALL) y USING ({keys}) WHERE x.grp = '{REF}' AND y.grp <> '{REF}' AND x.c < 50 AND y.c < 50")


@query("analysis_alpha_by_group", f"""WITH {_LV}, dv AS (SELECT *, CASE WHEN day = 0 THEN 'before' ELSE 'after' END AS phase FROM shannon JOIN samples USING (sample)),
    both_variants AS (SELECT *, 'all' AS variant FROM dv UNION ALL SELECT *, 'no outliers' FROM dv WHERE {_OUT}),
    w AS ({sql_wilcox('both_variants', 'variant, phase, sex', 'shannon', 'grp', _SELECTED)})
    SELECT variant, phase, sex, {_TEST}, {_STARS} FROM w""", ["shannon", "samples"])
def _(spark, sf):
    pairs = [("AFRICA", "AMERICA"), ("AMERICA", "ASIA"), ("AFRICA", "ASIA")]
    return rounded(plans.alpha_by_group(abundance(spark, sf), samples(spark, sf), pairs, OUT))


_MEDIANS = "round(m1.med, 6) AS median1, round(m2.med, 6) AS median2"


@query("analysis_alpha_over_time", f"""WITH RECURSIVE dv AS (SELECT * FROM shannon JOIN samples USING (sample) WHERE {_OUT}), {_LV}, {sql_nulls(_sizes('dv', 'sex, timepoint'))},
    w AS ({sql_wilcox('dv', 'sex, timepoint', 'shannon', 'grp', _REFPAIRS, 'less', True)}), adj AS ({sql_bh('w', 'p', 'sex, timepoint')}),
    md AS (SELECT sex, timepoint, grp, median(shannon) AS med FROM dv GROUP BY ALL)
    SELECT adj.sex, adj.timepoint, {_TEST}, round(p_adj, 6) AS p_adj, {_MEDIANS} FROM adj JOIN md m1 ON m1.sex = adj.sex AND m1.timepoint = adj.timepoint AND m1.grp = group1
      JOIN md m2 ON m2.sex = adj.sex AND m2.timepoint = adj.timepoint AND m2.grp = group2""", ["shannon", "samples"])
def _(spark, sf):
    return rounded(plans.alpha_over_time(abundance(spark, sf), samples(spark, sf), REF, LEVELS, OUT))


_DIVERGE = f"""bl AS (SELECT s.*, d FROM samples s JOIN samples z ON s.subject = z.subject AND z.day = 0 AND s.day <> 0
      JOIN bray ON a = least(s.sample, z.sample) AND b = greatest(s.sample, z.sample)),
    dv AS (SELECT *, 'all' AS slice FROM bl UNION ALL SELECT *, 'male' FROM bl WHERE sex = 'M' AND {_OUT} UNION ALL SELECT *, 'female' FROM bl WHERE sex = 'F' AND {_OUT})"""


@query("analysis_divergence_tests", f"""WITH RECURSIVE {_DIVERGE}, {_LV}, {sql_nulls(_sizes('dv', 'slice, timepoint'))},
    w AS ({sql_wilcox('dv', 'slice, timepoint', 'd', 'grp', _REFPAIRS, 'less', True)}), adj AS ({sql_bh('w', 'p', 'slice, timepoint')})
    SELECT slice, timepoint, {_TEST}, round(p_adj, 6) AS p_adj FROM adj""", ["bray", "samples"])
def _(spark, sf):
    out = plans.divergence_from_baseline(abundance(spark, sf), samples(spark, sf), REF, LEVELS, OUT)
    return rounded(out["tests"])


@query("analysis_divergence_trajectory", f"""WITH {_DIVERGE} SELECT slice, timepoint, grp, COUNT(*) AS n, round(median(d), 6) AS median, round(stddev_samp(d), 6) AS sd,
    round(median(d) - 2 * stddev_samp(d), 6) AS y_min, round(median(d) + 2 * stddev_samp(d), 6) AS y_max FROM dv GROUP BY 1, 2, 3""", ["bray", "samples"])
def _(spark, sf):
    out = plans.divergence_from_baseline(abundance(spark, sf), samples(spark, sf), REF, LEVELS, OUT)
    return rounded(out["trajectory"])


@query("analysis_divergence_boxes", f"""WITH {_DIVERGE}, q AS (SELECT slice, timepoint, grp, COUNT(*) AS n, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.75) AS q3 FROM dv GROUP BY 1, 2, 3)
    SELECT slice, timepoint, grp, n, round(MIN(d) FILTER (i), 6) AS lower, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
      round(MAX(d) FILTER (i), 6) AS upper, COUNT(*) FILTER (NOT i) AS outliers
    FROM (SELECT dv.*, n, q1, med, q3, d BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS i FROM dv JOIN q USING (slice, timepoint, grp))
    GROUP BY slice, timepoint, grp, n, q1, med, q3""", ["bray", "samples"])
def _(spark, sf):
    out = plans.divergence_from_baseline(abundance(spark, sf), samples(spark, sf), REF, LEVELS, OUT)
    return rounded(out["boxes"])


_SQUARE = """bray0 AS (SELECT a, b, d FROM bray JOIN samples x ON x.sample = a AND x.day = 0 JOIN samples y ON y.sample = b AND y.day = 0),
    sq AS (SELECT a AS sample, b AS feature, d AS value FROM bray0 UNION ALL SELECT b, a, d FROM bray0), sqt AS (SELECT sample, SUM(value) AS total FROM sq GROUP BY 1),
    bb AS (SELECT p.sample AS a, q.sample AS b, 1 - 2 * SUM(least(p.value, q.value)) / any_value(x.total + y.total) AS d FROM sq p JOIN sq q ON p.feature = q.feature AND p.sample < q.sample
      JOIN sqt x ON x.sample = p.sample JOIN sqt y ON y.sample = q.sample GROUP BY 1, 2)"""


@query("analysis_ordination_permanova", f"""WITH {_SQUARE}, member AS (SELECT 'sex' AS combination, sample, sex AS label FROM samples WHERE day = 0),
    pd AS (SELECT 'sex' AS combination, a, b, d FROM bb), {_sql_permanova(9999)} SELECT combination AS factor, n, df, {_PERM_OUT} FROM tests""", ["bray", "samples"])
def _(spark, sf):
    who = samples(spark, sf).filter("day = 0")
    from quadrat.operators.permanova import permanova
    dist = plans.sample_distances(abundance(spark, sf), who, double=True)
    return rounded(permanova(dist, who, "sex", 9999))


@query("analysis_ordination")
def _(spark, sf):
    who = samples(spark, sf).filter("day != 0")
    dist = plans.sample_distances(abundance(spark, sf), who, double=True)
    o = plans.ordinate(dist, who, "sex", permutations=9999)
    flat = lambda df, kind, name, axis, value: df.select(
        F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.expr(axis).alias("axis"), F.col(value).alias("value"))
    return (flat(o.coords, "sample", "sample", "axis", "value").unionByName(flat(o.centroids, "centroid", "sex", "axis", "value"))
            .unionByName(flat(o.axes, "percent", "axis", "axis", "percent"))
            .unionByName(flat(o.ellipses, "radius", "sex", "0", "radius")).unionByName(flat(o.permanova, "p", "factor", "0", "p")))


def _pairwise_sql(where):
    return f"""WITH sm AS (SELECT * FROM samples WHERE {where}), lv AS (SELECT DISTINCT cohort FROM sm),
    co AS (SELECT x.cohort || '-' || y.cohort AS combination, x.cohort AS level1, y.cohort AS level2 FROM lv x JOIN lv y ON x.cohort < y.cohort),
    member AS (SELECT combination, sample, cohort AS label FROM sm JOIN co ON cohort = level1 OR cohort = level2),
    pd AS (SELECT x.combination, a, b, d FROM bray JOIN member x ON x.sample = a JOIN member y ON y.sample = b AND y.combination = x.combination),
    {_sql_permanova(9999)}, adj AS (SELECT *, least(1, p * COUNT(*) OVER ()) AS p_adj FROM tests)
    SELECT combination, level1, level2, n, df, {_PERM_OUT}, round(p_adj, 6) AS p_adj FROM adj JOIN co USING (combination)"""


@query("analysis_cohort_sensitivity", _pairwise_sql("day < 3"), ["samples", "bray"])
def _(spark, sf):
    from quadrat.operators.permanova import permanova_pairwise
    who = samples(spark, sf).filter("day < 3")
    dist = plans.sample_distances(abundance(spark, sf), who)
    return rounded(permanova_pairwise(dist, who, "cohort", 9999, "bonferroni"))


@query("analysis_cohort_ordinations")
def _(spark, sf):
    everyone, inliers = F.lit(True), ~F.col("cohort").isin(*OUT)
    runs = {"all by cohort": (everyone, "cohort"), "all by sex": (everyone, "sex"), "inliers by cohort": (inliers, "cohort")}
    o = plans.ordinations_by_run(abundance(spark, sf), samples(spark, sf), runs)
    path = scratch_path(spark, "cohorts")
    delimited.write_table(o["points"], path)
    points = delimited.read_delimited(spark, path, "run string, sample string, pcoa1 double, pcoa2 double, level string")
    flat = lambda df, kind, name, axis, value: df.select("run", F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.expr(axis).alias("axis"), F.col(value).alias("value"))
    out = flat(points, "sample", "sample", "1", "pcoa1").unionByName(flat(points, "sample", "sample", "2", "pcoa2"))
    return (out.unionByName(flat(o["centroids"], "centroid", "level", "axis", "value")).unionByName(flat(o["axes"], "percent", "axis", "axis", "percent"))
            .unionByName(flat(o["ellipses"], "radius", "level", "0", "radius")))


WINDOWS = {f"{a}-{b}": (a, b) for a, b in zip(TIMEPOINTS[:-1], TIMEPOINTS[1:])}
_WIN = " UNION ALL ".join(f"SELECT '{w}' AS win, '{t}' AS timepoint" for w, pair in WINDOWS.items() for t in pair)
_WTAXA = f"""ws AS (SELECT win, s.* FROM samples s JOIN ({_WIN}) USING (timepoint)),
    rt AS (SELECT sample, genus AS taxon, 100 * SUM(value) / any_value(total) AS v FROM abundance JOIN totals USING (sample) JOIN taxonomy USING (feature) GROUP BY 1, 2),
    seen AS (SELECT DISTINCT sex, win, taxon FROM ws JOIN rt USING (sample)),
    taxa AS (SELECT ws.sex, ws.win, ws.sample, ws.grp, seen.taxon, COALESCE(rt.v, 0) AS v FROM ws JOIN seen ON seen.sex = ws.sex AND seen.win = ws.win
      LEFT JOIN rt ON rt.sample = ws.sample AND rt.taxon = seen.taxon)"""
_ALPHA = 0.9  # the fixture data has no real group effect; a wide level keeps rows to compare


_DIFFERENTIAL = f"""WITH {_LV}, {_WTAXA}, kw AS ({sql_kruskal('taxa', 'sex, win, taxon', 'v', 'grp')}), ka AS ({sql_bh('kw', 'p', 'sex, win')}),
    hits AS (SELECT sex, win, taxon, p_adj AS p_experiment FROM ka WHERE p_adj < {_ALPHA}), ht AS (SELECT taxa.* FROM taxa JOIN hits USING (sex, win, taxon)),
    w AS ({sql_wilcox('ht', 'sex, win, taxon', 'v', 'grp', _ALLPAIRS)}), wa AS ({sql_bh('w', 'p', 'sex, win, taxon')})
    SELECT sex, win AS window, taxon, group1, group2, round(p_experiment, 6) AS p_experiment, round(p_adj, 6) AS p_adj FROM wa JOIN hits USING (sex, win, taxon)
    WHERE p_adj < {_ALPHA} AND group2 = '{REF}'"""


@query("analysis_differential_taxa", _DIFFERENTIAL, ["totals", "samples", "taxonomy"])
def _(spark, sf):
    return rounded(plans.differential_taxa(abundance(spark, sf), samples(spark, sf), taxonomy(spark, sf), "genus",
                                           WINDOWS, REF, LEVELS, _ALPHA))


_EARLY = tuple(WINDOWS)[:3]


@query("analysis_union_of_windows", f"SELECT DISTINCT taxon FROM ({_DIFFERENTIAL}) WHERE sex = 'M' AND \"window\" IN {_EARLY}", ["totals", "samples", "taxonomy"])
def _(spark, sf):
    hits = plans.differential_taxa(abundance(spark, sf), samples(spark, sf), taxonomy(spark, sf), "genus", WINDOWS, REF,
                                   LEVELS, _ALPHA)
    return plans.union_of_windows(hits, _EARLY, "M")


_MTAXA = """ms AS (SELECT * FROM samples WHERE sex = 'M'),
    taxa AS (SELECT s.*, t.taxon, COALESCE(r.v, 0) AS v FROM ms s CROSS JOIN (SELECT DISTINCT phylum AS taxon FROM taxonomy) t
    LEFT JOIN (SELECT sample, phylum AS taxon, 100 * SUM(value) / any_value(total) AS v FROM abundance JOIN totals USING (sample) JOIN taxonomy USING (feature) GROUP BY 1, 2) r ON r.sample = s.sample AND r.taxon = t.taxon),
    sel AS (SELECT taxon, MAX(m) AS median FROM (SELECT taxon, grp, median(v) AS m FROM taxa GROUP BY 1, 2) GROUP BY 1 HAVING MAX(m) > 17),
    pos AS (SELECT taxon, DENSE_RANK() OVER (ORDER BY median) AS position FROM sel), lt AS (SELECT taxa.* FROM taxa JOIN sel USING (taxon) WHERE timepoint <> '0dpi')"""


def _profiles(spark, sf):
    who = samples(spark, sf).filter("sex = 'M'")
    taxa = taxonomy(spark, sf).select(F.col("phylum").alias("taxon")).distinct()
    return plans.taxon_profiles(abundance(spark, sf), who, taxonomy(spark, sf), "phylum", taxa, F.col("median") > 17,
                                REF, LEVELS, F.col("timepoint") != "0dpi")


@query("analysis_taxon_profile_tests", f"""WITH RECURSIVE {_MTAXA}, {_LV}, {sql_nulls(_sizes('lt', 'taxon'))},
    w AS ({sql_wilcox('lt', 'taxon', 'v', 'grp', _REFPAIRS, 'two.sided', True)}), adj AS ({sql_bh('w', 'p', 'taxon')})
    SELECT taxon, {_TEST}, round(p_adj, 6) AS p_adj, position FROM adj JOIN pos USING (taxon)""", ["totals", "samples", "taxonomy"])
def _(spark, sf):
    return rounded(_profiles(spark, sf)["tests"].withColumn("position", F.col("position").cast("bigint")))


@query("analysis_taxon_profile_boxes", f"""WITH {_MTAXA}, q AS (SELECT taxon, grp, COUNT(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM lt GROUP BY 1, 2)
    SELECT taxon, grp, n, round(MIN(v) FILTER (i), 6) AS lower, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(MAX(v) FILTER (i), 6) AS upper, COUNT(*) FILTER (NOT i) AS outliers, position
    FROM (SELECT lt.taxon, lt.grp, v, n, q1, med, q3, v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS i FROM lt JOIN q USING (taxon, grp)) JOIN pos USING (taxon) GROUP BY taxon, grp, n, q1, med, q3, position""", ["totals", "samples", "taxonomy"])
def _(spark, sf):
    return rounded(_profiles(spark, sf)["boxes"].withColumn("position", F.col("position").cast("bigint")))


@query("analysis_taxon_profile_densities", f"""WITH {_MTAXA}, st AS (SELECT taxon, grp, COUNT(*) AS n, MIN(v) AS lo, MAX(v) AS hi, MAX(abs(v)) AS big, stddev_samp(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr FROM lt GROUP BY 1, 2),
    bw AS (SELECT *, 0.9e0 * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd WHEN big > 0 THEN big ELSE 1 END * pow(n, -0.2) AS bw FROM st),
    ends AS (SELECT *, lo - 3 * bw AS first, (hi + 3 * bw - (lo - 3 * bw)) / 511e0 AS step FROM bw),
    placed AS (SELECT e.*, (v - first) / step AS spot, least(floor((v - first) / step), 510) AS low FROM lt JOIN ends e USING (taxon, grp)),
    bins AS (SELECT taxon, grp, bin, SUM(w) AS w FROM (SELECT taxon, grp, low AS bin, low + 1 - spot AS w FROM placed UNION ALL SELECT taxon, grp, low + 1, spot - low FROM placed) GROUP BY 1, 2, 3)
    SELECT taxon, grp, CAST(point AS INT) AS point, round(first + point * step, 6) AS x, round(SUM(w * exp(-0.5 * pow((point - bin) * step / bw, 2))) / (sqrt(2 * pi()) * bw * n), 6) AS density, position
    FROM bins JOIN ends USING (taxon, grp) JOIN pos USING (taxon), (SELECT unnest(range(0, 512)) AS point) GROUP BY taxon, grp, point, first, step, bw, n, position""", ["totals", "samples", "taxonomy"])
def _(spark, sf):
    return rounded(_profiles(spark, sf)["density"].withColumn("position", F.col("position").cast("bigint")))


def _carbs(spark, sf):
    return plans.carbohydrate_profile(gene_counts(spark, sf), change_groups(spark, sf), ["feature", "change_direction"], suffixes=())


_GH = """gh AS (SELECT feature, change_direction, unnest(string_split(subheader, ', ')) AS subheader, gene_freq FROM gene_counts JOIN change_groups USING (feature)
    WHERE gene_id LIKE 'GH%' AND change_direction <> 'No Change'), pf AS (SELECT feature, change_direction, subheader, SUM(gene_freq) AS total FROM gh GROUP BY 1, 2, 3)"""


def _sql_trees(profile: str, term: str) -> str:
    """Trees of the rows per change direction, and of the columns."""
    return f"""cells AS (SELECT change_direction AS slice, feature AS sample, {term} AS feature, CAST(total AS DOUBLE) AS value FROM {profile}
        UNION ALL SELECT 'columns', {term}, feature, SUM(total) FROM {profile} GROUP BY 2, 3), prs AS ({sql_euclid('cells')}), {sql_linkage('prs')}
    SELECT DISTINCT slice AS change_direction, l AS "left", r AS "right", round(h, 6) AS height FROM tree WHERE step > 0"""


@query("analysis_carbohydrate_trees", f"WITH RECURSIVE {_GH}, {_sql_trees('pf', 'subheader')}", ["gene_counts", "change_groups"])
def _(spark, sf):
    trees = plans.clustered_profile(_carbs(spark, sf), "feature", "subheader", "change_direction")
    return rounded(trees["rows"].unionByName(trees["columns"].withColumn("change_direction", F.lit("columns"))))


@query("analysis_carbohydrate_tests", f"""WITH {_GH}, w AS ({sql_wilcox('pf', 'subheader', 'total', 'change_direction', "SELECT 'Increasing' AS group1, 'Decreasing' AS group2")}),
    adj AS ({sql_bh('w', 'p', 'subheader')}) SELECT subheader, {_TEST}, round(p_adj, 6) AS p_adj FROM adj""", ["gene_counts", "change_groups"])
def _(spark, sf):
    return rounded(plans.carbohydrate_tests(_carbs(spark, sf))["tests"])


@query("analysis_transporter_profile", """SELECT feature, change_direction, module, CAST(SUM(gene_freq) AS BIGINT) AS total FROM gene_counts JOIN change_groups USING (feature)
    WHERE regexp_matches(module, 'PROMO|SMALL|LARGE') GROUP BY 1, 2, 3""", ["gene_counts", "change_groups"])
def _(spark, sf):
    return plans.transporter_profile(gene_counts(spark, sf), change_groups(spark, sf), ["feature", "change_direction"], ["PROMO", "SMALL", "LARGE"])


@query("analysis_transporter_trees", f"""WITH RECURSIVE pf AS (SELECT feature, change_direction, module, SUM(gene_freq) AS total FROM gene_counts JOIN change_groups USING (feature)
    WHERE regexp_matches(module, 'PROMO|SMALL|LARGE') GROUP BY 1, 2, 3), {_sql_trees('pf', 'module')}""", ["gene_counts", "change_groups"])
def _(spark, sf):
    profile = plans.transporter_profile(gene_counts(spark, sf), change_groups(spark, sf), ["feature", "change_direction"], ["PROMO", "SMALL", "LARGE"])
    trees = plans.clustered_profile(profile, "feature", "module", "change_direction")
    return rounded(trees["rows"].unionByName(trees["columns"].withColumn("change_direction", F.lit("columns"))))


@query("analysis_starch_utilisation", """WITH c AS (SELECT feature, change_direction, matches, COUNT(*) AS total_occurrences FROM (
      SELECT feature, change_direction, nullif(concat_ws(', ', CASE WHEN contains(t, 'ring') THEN 'ring' END, CASE WHEN contains(t, 'red') THEN 'red' END), '') AS matches
      FROM (SELECT *, lower(concat_ws(' ', hit_a, hit_b)) AS t FROM annotations JOIN change_groups USING (feature))) WHERE matches IS NOT NULL GROUP BY 1, 2, 3)
    SELECT c.*, position FROM c JOIN (SELECT feature, DENSE_RANK() OVER (ORDER BY AVG(total_occurrences)) AS position FROM c GROUP BY 1) USING (feature)""", ["annotations", "change_groups"])
def _(spark, sf):
    out = plans.starch_utilisation(annotations(spark, sf), change_groups(spark, sf), ["feature", "change_direction"], ["ring", "red"], ["hit_a", "hit_b"])
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("analysis_improved_or_unique", f"""WITH lab AS (SELECT *, {_RULE_SQL} AS s FROM clusters), rp AS (SELECT DISTINCT representative FROM lab WHERE s = 'own' AND member = representative),
    per AS (SELECT d.database, representative, CAST(bool_or(s = d.database) AS INT) AS present FROM lab JOIN rp USING (representative), (VALUES ('alpha'), ('beta'), ('gamma')) d(database)
      WHERE s IN ('own', d.database) GROUP BY 1, 2),
    c AS (SELECT database, CASE present WHEN 1 THEN 'improved' ELSE 'unique' END AS presence, COUNT(*) AS count FROM per GROUP BY 1, 2)
    SELECT database, presence, count, CAST(SUM(count) OVER (PARTITION BY database) AS BIGINT) AS total,
      round(1e2 * SUM(count) OVER (PARTITION BY database) / CAST(CASE database WHEN 'alpha' THEN 1573 WHEN 'gamma' THEN 1296 ELSE 1091 END AS DOUBLE), 2) AS percent FROM c""", ["clusters"])
def _(spark, sf):
    from quadrat.operators.origins import by_pattern
    lab = clusters(spark, sf).withColumn("s", by_pattern(F.col("db"), RULES, "own"))
    own = lab.filter((F.col("s") == "own") & (F.col("member") == F.col("representative"))).select("representative")
    per = lab.join(own, "representative", "left_semi").withColumn(
        "database", F.explode(F.when(F.col("s") == "own", F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))).otherwise(F.array("s"))))
    rules = [("alpha", "alpha"), ("beta", "beta"), ("gamma", "gamma")]
    sizes = spark.createDataFrame([("alpha", 1573), ("gamma", 1296), ("beta", 1091)], "database string, size int")
    return plans.improved_or_unique(per.withColumn("member", F.col("s")), F.lit(True), rules, sizes)


def _doc_taxonomy(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("representative"), F.concat(F.lit("p__"), "lang").alias("phylum"),
                       F.when(F.col("doc_id") % 2 == 0, "o__even").otherwise("").alias("order"))


@query("analysis_presence_matrix", f"""SELECT representative, own, alpha, beta, gamma, lang AS phylum, CASE WHEN representative % 2 = 0 THEN 'even' ELSE 'Unclassified order' END AS "order"
    FROM (SELECT representative, CAST(bool_or(s = 'own') AS INT) AS own, CAST(bool_or(s = 'alpha') AS INT) AS alpha, CAST(bool_or(s = 'beta') AS INT) AS beta, CAST(bool_or(s = 'gamma') AS INT) AS gamma
      FROM (SELECT representative, {_RULE_SQL} AS s FROM clusters) GROUP BY 1) JOIN documents ON doc_id = representative""", ["clusters"])
def _(spark, sf):
    return plans.presence_across_databases(clusters(spark, sf), RULES, "own", ["own", "alpha", "beta", "gamma"],
                                           _doc_taxonomy(spark, sf), ["phylum", "order"], "db")["matrix"]


@query("analysis_presence_trees", f"""WITH RECURSIVE found AS (SELECT DISTINCT representative, {_RULE_SQL} AS s FROM clusters),
    named AS (SELECT representative, list(s ORDER BY s) AS pattern, struct_pack(phylum := any_value(lang), "order" := CASE WHEN representative % 2 = 0 THEN 'even' ELSE 'Unclassified order' END) AS slice
      FROM found JOIN documents ON doc_id = representative GROUP BY representative),
    heads AS (SELECT slice, pattern, representative, MIN(representative) OVER (PARTITION BY slice, pattern) AS head FROM named),
    cells AS (SELECT slice, head AS sample, unnest(pattern) AS feature, 1e0 AS value FROM heads WHERE head = representative), prs AS ({sql_euclid('cells')}), {sql_linkage('prs')}
    SELECT DISTINCT slice.phylum AS phylum, slice."order" AS "order", l AS "left", r AS "right", round(h, 6) AS height FROM tree WHERE step > 0
    UNION ALL SELECT slice.phylum, slice."order", head, representative, 0e0 FROM heads WHERE head <> representative""", ["clusters"])
def _(spark, sf):
    return rounded(plans.presence_across_databases(clusters(spark, sf), RULES, "own", ["own", "alpha", "beta", "gamma"],
                                                   _doc_taxonomy(spark, sf), ["phylum", "order"], "db")["rows"])


@query("analysis_genome_quality", """WITH r AS (SELECT substr(phylum, 4) || ' - ' || substr(family, 4) AS phylum_family, CASE WHEN contamination < 5 THEN 'Less than 5%' WHEN contamination < 10 THEN '5%-10%' END AS contamination_class, completeness FROM quality),
    q AS (SELECT phylum_family, contamination_class, COUNT(*) AS n, quantile_cont(CAST(completeness AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(completeness AS DOUBLE), 0.5) AS med, quantile_cont(CAST(completeness AS DOUBLE), 0.75) AS q3 FROM r GROUP BY 1, 2)
    SELECT phylum_family, contamination_class, n, CAST(MIN(completeness) FILTER (i) AS DOUBLE) AS lower, q1, med AS median, q3, CAST(MAX(completeness) FILTER (i) AS DOUBLE) AS upper, COUNT(*) FILTER (NOT i) AS outliers,
      CAST((SELECT median(completeness) FROM quality) AS DOUBLE) AS overall_median
    FROM (SELECT r.phylum_family, r.contamination_class, completeness, n, q1, med, q3, completeness BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS i FROM r JOIN q ON r.phylum_family = q.phylum_family AND r.contamination_class IS NOT DISTINCT FROM q.contamination_class)
    GROUP BY phylum_family, contamination_class, n, q1, med, q3""", ["quality"])
def _(spark, sf):
    return rounded(plans.genome_quality(quality(spark, sf)))


@query("analysis_mapping_rate", """WITH r AS (SELECT CASE grp_code WHEN 1 THEN 'Lam' WHEN 2 THEN 'T10' ELSE 'T4' END AS injury, CAST(grp_code AS INT) AS injury_ord, CAST(sample % 2 AS INT) AS sex, pct_mapped AS v FROM mapping),
    q AS (SELECT injury, sex, COUNT(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY 1, 2)
    SELECT injury, injury_ord, sex, n, round(MIN(v) FILTER (i), 6) AS lower, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(MAX(v) FILTER (i), 6) AS upper, COUNT(*) FILTER (NOT i) AS outliers,
      round((SELECT AVG(v) FROM r), 6) AS overall_mean FROM (SELECT r.*, n, q1, med, q3, v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS i FROM r JOIN q USING (injury, sex)) GROUP BY injury, injury_ord, sex, n, q1, med, q3""", ["mapping"])
def _(spark, sf):
    rows = mapping(spark, sf).withColumn("sex", (F.col("sample") % 2).cast("int"))
    return rounded(plans.mapping_rate(rows, {1: "Lam", 2: "T10", 3: "T4"}, "sex"))


@query("analysis_subject_scores", f"""WITH v AS (SELECT DISTINCT 'before' AS variant, subject, bms_score, grp, sex FROM samples UNION ALL SELECT DISTINCT 'after', subject, bms_score, grp, sex FROM samples WHERE {_OUT})
    SELECT *, COUNT(*) OVER (PARTITION BY variant) AS n FROM v""", ["samples"])
def _(spark, sf):
    return plans.subject_scores(samples(spark, sf), OUT)


@query("analysis_transit_time", f"""WITH RECURSIVE lg AS (SELECT subject, injury AS grp, '1 week' AS timepoint, d7 AS t FROM transit_wide UNION ALL SELECT subject, injury, '2 weeks', d15 FROM transit_wide UNION ALL SELECT subject, injury, '3 weeks', d21 FROM transit_wide UNION ALL SELECT subject, injury, '4 weeks', d31 FROM transit_wide),
    l2 AS (SELECT * FROM lg WHERE t IS NOT NULL), {sql_nulls("SELECT CAST(x.c AS INT) AS m, CAST(y.c AS INT) AS k FROM (SELECT timepoint, COUNT(*) AS c FROM l2 WHERE grp = 'Lam' GROUP BY 1) x JOIN (SELECT timepoint, COUNT(*) AS c FROM l2 WHERE grp = 'T9' GROUP BY 1) y USING (timepoint) WHERE x.c < 50 AND y.c < 50")},
    w AS ({sql_wilcox('l2', 'timepoint', 't', 'grp', "SELECT 'Lam' AS group1, 'T9' AS group2", 'two.sided', True)}), adj AS ({sql_bh('w', 'p', 'timepoint')}),
    md AS (SELECT timepoint, grp, median(t) AS med FROM l2 GROUP BY 1, 2)
    SELECT adj.timepoint, {_TEST}, round(p_adj, 6) AS p_adj, {_MEDIANS} FROM adj JOIN md m1 ON m1.timepoint = adj.timepoint AND m1.grp = group1 JOIN md m2 ON m2.timepoint = adj.timepoint AND m2.grp = group2""", ["transit_wide"])
def _(spark, sf):
    return rounded(plans.transit_time(transit_wide(spark, sf), ["subject", "injury"], "injury", "Lam", ["Lam", "T9"],
                                      {"d7": "1 week", "d15": "2 weeks", "d21": "3 weeks", "d31": "4 weeks"}))
