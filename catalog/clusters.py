"""Ordination, clustering, dereplication, origins and gene profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (abundance, annotations, change_groups, clusters, embedding_cells, gene_counts,
                          query, rounded, samples, sql_euclid, sql_linkage, table)
from quadrat.operators import clustering, dereplicate, distance, genes, ordination, origins, similarity
from quadrat.plans import analyses
from quadrat.sources import delimited, fasta
from quadrat.storage import scratch_path, settle


@query("pcoa_trace", """SELECT round(SUM(d * d) / (SELECT COUNT(DISTINCT sample) FROM samples), 6) AS trace FROM bray""", ["bray", "samples"])
def _(spark, sf):
    dist = settle(distance.bray_curtis(abundance(spark, sf)), "pairs")
    _, axes = ordination.pcoa(dist, correction="none")
    return rounded(axes.filter("axis = 1").select("trace"))


@query("pcoa_cailliez")
def _(spark, sf):
    dist = settle(distance.bray_curtis(abundance(spark, sf)), "pairs")
    coords, axes = ordination.pcoa(dist)
    who = samples(spark, sf)
    centres = ordination.centroids(coords, who, "grp").select(
        F.lit("centroid").alias("kind"), F.col("grp").alias("name"), "axis", "value")
    return (coords.select(F.lit("sample").alias("kind"), F.col("sample").alias("name"), "axis", "value")
            .unionByName(centres)
            .unionByName(axes.select(F.lit("percent").alias("kind"), F.lit("all").alias("name"), "axis",
                                     F.col("percent").alias("value"))))


@query("pcoa_embedding_distances")
def _(spark, sf):
    dist = settle(distance.euclidean(embedding_cells(spark, sf)), "pairs")
    coords, axes = ordination.pcoa(dist, correction="none")
    return coords


def _full_rank(spark, sf):
    """Coordinates on as many axes as the embeddings have components: distances must come back from them."""
    width = table(spark, sf, "embeddings").select(F.max(F.size("embedding"))).head()[0]
    coords, _ = ordination.pcoa(settle(distance.euclidean(embedding_cells(spark, sf)), "pairs"), k=width, correction="none")
    return settle(coords.select(F.col("sample").cast("bigint").alias("sample"), "axis", "value"), "coords")


@query("pcoa_distances_come_back", """SELECT x.vec_id AS a, y.vec_id AS b, round(list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 5) AS d
    FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id""")
def _(spark, sf):
    cells = _full_rank(spark, sf).select("sample", F.col("axis").alias("feature"), "value")
    return rounded(distance.euclidean(cells), 5)


@query("pcoa_centroid_distances", """WITH c AS (SELECT label, k, AVG(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL) GROUP BY 1, 2)
    SELECT x.label AS a, y.label AS b, round(sqrt(SUM((x.v - y.v) * (x.v - y.v))), 5) AS d FROM c x JOIN c y ON x.k = y.k AND x.label < y.label GROUP BY 1, 2""")
def _(spark, sf):
    who = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "label").where("label IS NOT NULL")
    centres = ordination.centroids(_full_rank(spark, sf), who, "label")
    return rounded(distance.euclidean(centres.select(F.col("label").alias("sample"), F.col("axis").alias("feature"), "value")), 5)


_FULL = "1.4e0"  # weight of a point at the centre, 1 + 2 / nu
_Q = "(({p}syy * dx * dx - 2 * {p}sxy * dx * dy + {p}sxx * dy * dy) / ({p}sxx * {p}syy - {p}sxy * {p}sxy))"


def _sql_weight(old: bool) -> str:
    p = "o" if old else ""
    q = _Q.format(p=p).replace("dx", f"(x - {p}cx)").replace("dy", f"(y - {p}cy)")
    return f"({_FULL} / (1 + {q} / 5))"


@query("group_ellipses", f"""WITH RECURSIVE pts AS (SELECT label AS g, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE label IS NOT NULL),
    start AS (SELECT g, COUNT(*) AS n, AVG(x) AS cx, AVG(y) AS cy, var_pop(x) AS sxx, covar_pop(x, y) AS sxy, var_pop(y) AS syy FROM pts GROUP BY 1),
    it AS (SELECT 0 AS i, *, CAST(NULL AS DOUBLE) AS ocx, CAST(NULL AS DOUBLE) AS ocy, CAST(NULL AS DOUBLE) AS osxx, CAST(NULL AS DOUBLE) AS osxy, CAST(NULL AS DOUBLE) AS osyy,
        0e0 AS fxx, 0e0 AS fxy, 0e0 AS fyy, 1e0 AS moved FROM start WHERE n >= 4 AND sxx * syy - sxy * sxy > 0
      UNION ALL SELECT i + 1, g, n, cx + wx / w, cy + wy / w, xx / w - (wx / w) * (wx / w), xy / w - (wx / w) * (wy / w), yy / w - (wy / w) * (wy / w), cx, cy, sxx, sxy, syy, xx / n, xy / n, yy / n, m FROM (
        SELECT i, g, n, cx, cy, sxx, sxy, syy, SUM(w) AS w, SUM(w * (x - cx)) AS wx, SUM(w * (y - cy)) AS wy, SUM(w * (x - cx) * (x - cx)) AS xx, SUM(w * (x - cx) * (y - cy)) AS xy, SUM(w * (y - cy) * (y - cy)) AS yy,
          MAX(abs(w - w0)) AS m FROM (SELECT it.*, x, y, {_sql_weight(False)} AS w, coalesce({_sql_weight(True)}, {_FULL}) AS w0 FROM it JOIN pts USING (g) WHERE moved >= 0.01 AND i < 25) GROUP BY ALL)),
    last AS (SELECT * FROM it WHERE i > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY g ORDER BY i DESC) = 1)
    SELECT s.g AS label, s.n, round(l.cx, 6) AS cx, round(l.cy, 6) AS cy, round(l.fxx, 6) AS sxx, round(l.fxy, 6) AS sxy, round(l.fyy, 6) AS syy,
      CASE WHEN l.i IS NOT NULL THEN round(sqrt((s.n - 1) * (pow(0.25, -2e0 / (s.n - 1)) - 1)), 6) END AS radius, CAST(coalesce(l.i, 0) AS INT) AS iterations
    FROM start s LEFT JOIN last l ON l.g = s.g""")
def _(spark, sf):
    points = table(spark, sf, "embeddings").select(
        F.col("embedding")[0].cast("double").alias("pcoa1"), F.col("embedding")[1].cast("double").alias("pcoa2"), "label")
    return rounded(ordination.group_ellipse(points, "label", 0.75))


@query("complete_linkage", f"""WITH RECURSIVE cells AS (SELECT 0 AS slice, feature AS sample, sample AS feature, CAST(value AS DOUBLE) AS value FROM abundance), prs AS ({sql_euclid('cells')}), {sql_linkage('prs')}
    SELECT DISTINCT l AS "left", r AS "right", round(h, 6) AS height FROM tree WHERE step > 0""", ["abundance"])
def _(spark, sf):
    dist = distance.euclidean(distance.transpose(abundance(spark, sf)))
    return rounded(clustering.complete_linkage(dist))


@query("complete_linkage_by_slice", f"""WITH RECURSIVE prs AS (SELECT x.grp AS slice, a, b, d FROM bray JOIN samples x ON x.sample = a JOIN samples y ON y.sample = b AND x.grp = y.grp), {sql_linkage('prs')}
    SELECT DISTINCT slice AS grp, l AS "left", r AS "right", round(h, 6) AS height FROM tree WHERE step > 0""", ["bray", "samples"])
def _(spark, sf):
    ab = abundance(spark, sf).join(samples(spark, sf).select("sample", "grp"), "sample")
    return rounded(clustering.complete_linkage(distance.bray_curtis(ab, split="grp"), "grp"))


_SETS = """words AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
    kmers AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words),
    toks AS (SELECT id, len(s) AS n, unnest(s) AS t FROM kmers),
    shared AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, COUNT(*) AS c FROM toks x JOIN toks y ON x.t = y.t AND x.id <> y.id GROUP BY 1, 2),
    sims AS (SELECT a, b, greatest(0, 1 + ln(2 * j / (1 + j)) / 5) AS similarity FROM (SELECT a, b, c / (na + nb - c) AS j FROM shared))"""


def _tokens(spark, sf, distinct=True):
    return similarity.item_sets(table(spark, sf, "documents"), "doc_id", "text", 5, distinct=distinct)


_TO_GOOD = f"""WITH {_SETS} SELECT a AS rep, b AS id, round(similarity, 6) AS similarity FROM sims
    WHERE similarity >= 0.9 AND a IN (SELECT doc_id FROM labels WHERE quality = 1)"""


def _to_good(spark, sf, sketch=None):
    tokens = _tokens(spark, sf)
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return rounded(similarity.similarity_to(good, tokens, 5, 0.9, sketch))


@query("similarity_to_representatives", _TO_GOOD)
def _(spark, sf):
    return _to_good(spark, sf)


@query("similarity_by_sketch", _TO_GOOD)
def _(spark, sf):
    return _to_good(spark, sf, 512)


@query("dereplicate", f"""WITH RECURSIVE {_SETS},
    ord AS (SELECT doc_id AS id, ROW_NUMBER() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents),
    nb AS (SELECT o.i, o.id, COALESCE(list(s.a) FILTER (s.similarity >= 0.95 - 1e-9 AND p.i < o.i), []) AS better
      FROM ord o LEFT JOIN sims s ON s.b = o.id LEFT JOIN ord p ON p.id = s.a GROUP BY 1, 2),
    g AS (SELECT 0 AS i, CAST([] AS BIGINT[]) AS reps UNION ALL
      SELECT nb.i, CASE WHEN list_has_any(reps, better) THEN reps ELSE list_append(reps, id) END FROM g JOIN nb ON nb.i = g.i + 1),
    reps AS (SELECT unnest(reps) AS id FROM (SELECT reps FROM g ORDER BY i DESC LIMIT 1)),
    members AS (SELECT b AS member, a AS representative, similarity, ROW_NUMBER() OVER (PARTITION BY b ORDER BY similarity DESC, o.i) AS k
      FROM sims JOIN reps ON reps.id = a JOIN ord o ON o.id = a WHERE similarity >= 0.95 - 1e-9 AND b NOT IN (SELECT id FROM reps))
    SELECT id AS representative, id AS member, 1e0 AS similarity FROM reps
    UNION ALL SELECT representative, member, round(similarity, 6) FROM members WHERE k = 1""")
def _(spark, sf):
    quality = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("quality"))
    return rounded(dereplicate.dereplicate(_tokens(spark, sf, False), quality, 5, 95.0, precluster=90.0))


_LETTERS, _BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


@query("dereplicate_files", f"""WITH RECURSIVE seqs AS (SELECT 'doc' || doc_id AS id, n_chars, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_BASES}') AS s FROM documents),
    raw AS (SELECT DISTINCT id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS t FROM (SELECT id, substr(s, unnest(range(1, greatest(length(s) - 20, 1) + 1)), 21) AS k FROM seqs)),
    toks AS (SELECT id, t, COUNT(*) OVER (PARTITION BY id) AS n FROM raw),
    shared AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, COUNT(*) AS c FROM toks x JOIN toks y ON x.t = y.t AND x.id <> y.id GROUP BY 1, 2),
    sims AS (SELECT a, b, 1 + ln(2 * j / (1 + j)) / 21 AS similarity FROM (SELECT a, b, c / (na + nb - c) AS j FROM shared) WHERE 1 + ln(2 * j / (1 + j)) / 21 >= 0.95 - 1e-9),
    ord AS (SELECT id, n_chars, ROW_NUMBER() OVER (ORDER BY n_chars DESC, id) AS i FROM seqs),
    nb AS (SELECT o.i, o.id, COALESCE(list(s.a) FILTER (p.i < o.i), []) AS better FROM ord o LEFT JOIN sims s ON s.b = o.id LEFT JOIN ord p ON p.id = s.a GROUP BY 1, 2),
    g AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS reps UNION ALL
      SELECT nb.i, CASE WHEN list_has_any(reps, better) THEN reps ELSE list_append(reps, id) END FROM g JOIN nb ON nb.i = g.i + 1),
    reps AS (SELECT unnest(reps) AS id FROM (SELECT reps FROM g ORDER BY i DESC LIMIT 1)),
    members AS (SELECT b AS member, a AS representative, ROW_NUMBER() OVER (PARTITION BY b ORDER BY round(similarity, 12) DESC, o.i) AS k
      FROM sims JOIN reps ON reps.id = a JOIN ord o ON o.id = a WHERE b NOT IN (SELECT id FROM reps)),
    defined AS (SELECT id AS representative, id AS member FROM reps UNION ALL SELECT representative, member FROM members WHERE k = 1)
    SELECT representative, member, CAST(length(s) AS INT) AS bases FROM defined JOIN seqs ON seqs.id = representative""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("genome"), "text", "n_chars")
    out = scratch_path(spark, "genomes")
    bases = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), _LETTERS, _BASES)
    fasta.write_fasta(docs.select("genome", F.lit("c1").alias("contig"), bases.alias("seq")), f"{out}/all")
    quality = docs.select(F.col("genome").alias("id"), F.col("n_chars").alias("quality"))
    clusters, files = analyses.dereplicate_genomes(spark, f"{out}/all", quality, out, extension="txt")
    defined = delimited.read_delimited(spark, clusters, "representative string, member string", "\t", False)
    kept = fasta.read_fasta(spark, files, "txt").groupBy(F.col("genome").alias("representative")).agg(F.sum(F.length("seq")).cast("int").alias("bases"))
    return defined.join(kept, "representative")


RULES = [("^src1[0-4]$", "alpha"), ("^src1[5-9]$", "beta"), ("^src[5-9]$", "gamma")]
_RULE_SQL = "CASE WHEN regexp_matches(db, '^src1[0-4]$') THEN 'alpha' WHEN regexp_matches(db, '^src1[5-9]$') THEN 'beta' WHEN regexp_matches(db, '^src[5-9]$') THEN 'gamma' ELSE 'own' END"


@query("cluster_origins", f"SELECT DISTINCT representative, {_RULE_SQL} AS source FROM clusters", ["clusters"])
def _(spark, sf):
    return origins.cluster_origins(clusters(spark, sf), RULES, "own", member="db")


@query("presence_matrix", f"""SELECT representative, CAST(bool_or(s = 'own') AS INT) AS own, CAST(bool_or(s = 'alpha') AS INT) AS alpha,
    CAST(bool_or(s = 'beta') AS INT) AS beta, CAST(bool_or(s = 'gamma') AS INT) AS gamma FROM (SELECT representative, {_RULE_SQL} AS s FROM clusters) GROUP BY 1""", ["clusters"])
def _(spark, sf):
    found = origins.cluster_origins(clusters(spark, sf), RULES, "own", member="db")
    return origins.presence_matrix(found, ["own", "alpha", "beta", "gamma"])


@query("functional_profile", """WITH g AS (SELECT feature, unnest(string_split(subheader, ', ')) AS subheader, gene_freq FROM gene_counts WHERE gene_id LIKE 'GH%')
    SELECT feature, change_direction, regexp_replace(subheader, '(?i)ed$', '') AS subheader, CAST(SUM(gene_freq) AS BIGINT) AS total FROM g JOIN change_groups USING (feature)
    WHERE change_direction <> 'No Change' GROUP BY 1, 2, 3""", ["gene_counts", "change_groups"])
def _(spark, sf):
    taxa = change_groups(spark, sf).filter("change_direction != 'No Change'")
    return genes.functional_profile(gene_counts(spark, sf), taxa, F.col("gene_id").startswith("GH"),
                                    ["feature", "change_direction"], strip=["ed$"])


@query("pattern_counts", """SELECT feature, matches, COUNT(*) AS total_occurrences FROM (
    SELECT feature, nullif(concat_ws(', ', CASE WHEN contains(t, 'ring') THEN 'Ring' END, CASE WHEN contains(t, 'red') THEN 'RED' END, CASE WHEN contains(t, 'promo') THEN 'promo' END), '') AS matches
    FROM (SELECT feature, lower(concat_ws(' ', hit_a, hit_b)) AS t FROM annotations)) WHERE matches IS NOT NULL GROUP BY 1, 2""", ["annotations"])
def _(spark, sf):
    return genes.pattern_counts(annotations(spark, sf), ["Ring", "RED", "promo"], ["feature"], ["hit_a", "hit_b"])
