"""Sources, sinks and relational operations, each as a query over the given tables."""

from __future__ import annotations

import os
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import (TIMEPOINTS, abundance, change_groups, clusters, gene_counts, mapping, quality, query,
                          rounded, samples, table, taxonomy, transit_wide)
from quadrat.functions import columns as C
from quadrat.operators import distance, genes, normalize, origins
from quadrat.operators.counts import exact_median, numbered
from quadrat.sources import delimited, fasta, workbook
from quadrat.storage import scratch_path, settle

def _folder(spark, label: str) -> str:
    """A new scratch folder that tasks write to as files; it must be a mounted path."""
    path = re.sub("^file:/*", "/", scratch_path(spark, label))
    os.makedirs(path)
    return path


# ---- sources and sinks -----------------------------------------------------------

_CUST = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
_CUST_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("source_csv", _CUST_SQL)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    delimited.write_table(table(spark, sf, "customer"), path)
    return delimited.read_delimited(spark, path, _CUST)


@query("source_csv_inferred_types", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    delimited.write_table(table(spark, sf, "nation"), path)
    return delimited.read_delimited(spark, path)


@query("source_tsv", _CUST_SQL)
def _(spark, sf):
    path = scratch_path(spark, "tsv")
    delimited.write_table(table(spark, sf, "customer"), path, sep="\t")
    return delimited.read_delimited(spark, path, _CUST, sep="\t")


@query("source_headerless_tsv", "SELECT CAST(representative AS STRING) AS representative, CAST(member AS STRING) AS member FROM clusters", ["clusters"])
def _(spark, sf):
    path = scratch_path(spark, "tsv")
    delimited.write_clusters(clusters(spark, sf), path)
    return delimited.read_delimited(spark, path, "representative string, member string", "\t", False)


@query("source_after_preamble", "SELECT subject, injury, round(d7, 6) AS d7, round(d15, 6) AS d15, round(d21, 6) AS d21, round(d31, 6) AS d31 FROM transit_wide", ["transit_wide"])
def _(spark, sf):
    path = scratch_path(spark, "preamble")
    wide = transit_wide(spark, sf)
    header = ",".join(wide.columns)
    lines = wide.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wide.columns]).alias("value"))

    def with_head(batches):  # every file starts with two lines of notes and a header
        first = True
        for pdf in batches:
            head = ["notes", "more notes", header] if first else []
            first = False
            yield pd.DataFrame({"value": head + list(pdf["value"])})

    lines.repartition(4).mapInPandas(with_head, "value string").write.text(path)
    out = delimited.read_after_preamble(spark, path, 2, "subject bigint, injury string, d7 double, d15 double, d21 double, d31 double")
    return rounded(out)


def _book(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A minimal workbook with inline strings."""
    import io
    from xml.sax.saxutils import escape
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        tags = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{tags}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        for i, pdf in enumerate(sheets.values(), 1):
            rows = [list(pdf.columns), *pdf.astype(str).values.tolist()]
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@query("source_workbook_sheets", """SELECT CAST(DENSE_RANK() OVER (PARTITION BY feature ORDER BY module) AS STRING) AS sheet_name, feature, gene_id, module, subheader, gene_freq
    FROM gene_counts""", ["gene_counts"])
def _(spark, sf):
    path = _folder(spark, "books")

    def save(pdf):  # one workbook per feature, one sheet per module
        name = pdf["feature"].iloc[0]
        sheets = {m: g[["gene_id", "subheader", "gene_freq"]].rename(columns={"gene_freq": name})
                  for m, g in pdf.sort_values("module").groupby("module")}
        with open(f"{path}/{name.replace('#', '_')}.xlsx", "wb") as f:
            f.write(_book(sheets))
        return pd.DataFrame([(name, i, m) for i, m in enumerate(sheets, 1)], columns=["feature", "no", "module"])

    modules = gene_counts(spark, sf).groupBy("feature").applyInPandas(save, "feature string, no int, module string")
    modules = settle(modules, "modules")
    long = workbook.read_sheets_long(spark, path, ["gene_id", "subheader"])
    return long.select("sheet_name", F.col("column").alias("feature"), "gene_id", "subheader", F.col("value").cast("bigint").alias("gene_freq")).join(
        modules.select("feature", F.col("no").cast("string").alias("sheet_name"), "module"), ["feature", "sheet_name"])


@query("source_clean_names", "SELECT s_suppkey AS \"Bin.Id\", s_acctbal AS \"Percentage.Mapped\" FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Bin Id"), F.col("s_acctbal").alias("Percentage Mapped"))
    delimited.write_table(supplier, path)
    return C.clean_names(delimited.read_delimited(spark, path, "`Bin Id` bigint, `Percentage Mapped` double"))


@query("source_wide_matrix", "SELECT sample, genus AS feature, SUM(value) AS value FROM abundance JOIN taxonomy USING (feature) GROUP BY 1, 2", ["abundance", "taxonomy"])
def _(spark, sf):
    path = scratch_path(spark, "wide")
    by_genus = normalize.collapse(abundance(spark, sf), taxonomy(spark, sf), "genus")
    wide = genes.pivot_profile(by_genus.withColumnRenamed("sample", "Sample"), ["Sample"], "taxon", value="value", fill=0.0)
    delimited.write_table(wide, path)
    return delimited.read_abundance_matrix(spark, path)


@query("source_fasta", "SELECT genome, contig, seq FROM (SELECT 'doc' || doc_id AS genome, 'c1' AS contig, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)")
def _(spark, sf):
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("genome"), F.lit("c1").alias("contig"),
        F.regexp_replace("text", "[^A-Za-z]", "").alias("seq")), path)
    return fasta.read_fasta(spark, path, "txt")


@query("source_database_list", """SELECT database, 'r' || representative AS representative, 'm' || member AS member
    FROM (SELECT *, CASE WHEN db LIKE 'src1%' THEN 'alpha' ELSE 'beta' END AS database FROM clusters)""", ["clusters"])
def _(spark, sf):
    root = scratch_path(spark, "databases")
    which = F.when(F.col("db").startswith("src1"), "alpha").otherwise("beta")
    rows = clusters(spark, sf).withColumn("database", which)
    paths = []
    for db in ("alpha", "beta"):
        named = lambda c, p: F.concat(F.lit(f"./{db}/{p}"), F.col(c).cast("string"), F.lit(".fa")).alias(c)
        paths.append(f"{root}/{db}_representative_genomes.tsv")
        delimited.write_clusters(rows.filter(F.col("database") == db).select(named("representative", "r"), named("member", "m")), paths[-1])
    return delimited.read_clusters(spark, paths)


@query("sink_result_table", "SELECT sample, grp_code, round(pct_mapped, 6) AS pct_mapped FROM mapping", ["mapping"])
def _(spark, sf):
    path = scratch_path(spark, "results")
    delimited.write_table(mapping(spark, sf), path)
    return rounded(delimited.read_delimited(spark, path, "sample bigint, grp_code int, pct_mapped double"))


@query("sink_representative_sequences", "SELECT doc_id AS genome, n_chars FROM documents WHERE doc_id IN (SELECT representative FROM clusters)", ["clusters"])
def _(spark, sf):
    path = scratch_path(spark, "sequences")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("genome"), "n_chars")
    reps = clusters(spark, sf).select(F.col("representative").alias("genome"))
    delimited.write_representatives(docs, reps, path, shelves=16)
    return spark.read.parquet(path).select("genome", "n_chars")


@query("sink_figure_tables", "SELECT source, COUNT(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "figures")
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    delimited.write_tables({"bars": counts}, path)
    return spark.read.parquet(f"{path}/bars")


# ---- projections -------------------------------------------------------------------

@query("select_by_name", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")


@query("keep_abundance_columns_of_known_samples", "SELECT sample, feature, value FROM abundance WHERE sample IN (SELECT sample FROM samples WHERE sex = 'M')", ["abundance", "samples"])
def _(spark, sf):
    return abundance(spark, sf).join(samples(spark, sf).filter("sex = 'M'"), "sample", "left_semi")


@query("select_columns_containing", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def _(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(C.columns_containing(line, ["KEY", "ship"]))


@query("filter_features_containing", "SELECT sample, feature, value FROM abundance WHERE lower(feature) LIKE '%promo%' OR lower(feature) LIKE '%small%'", ["abundance"])
def _(spark, sf):
    return abundance(spark, sf).filter(F.lower("feature").rlike("promo|small"))


@query("keep_nonzero_columns", "SELECT gene_id, feature, CAST(SUM(gene_freq) AS BIGINT) AS total FROM gene_counts GROUP BY 1, 2 HAVING gene_id IN (SELECT gene_id FROM gene_counts GROUP BY 1 HAVING MAX(gene_freq) > 1)", ["gene_counts"])
def _(spark, sf):
    g = gene_counts(spark, sf)
    live = g.groupBy("gene_id").agg(F.bool_or(F.col("gene_freq") - 1 != 0).alias("live")).filter("live")
    return g.join(live, "gene_id", "left_semi").groupBy("gene_id", "feature").agg(F.sum("gene_freq").alias("total"))


@query("drop_columns", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").drop("c_name", "c_nationkey", "c_mktsegment")


@query("rename_columns", "SELECT r_regionkey AS region_key, r_name AS region_name, COUNT(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 2")
def _(spark, sf):
    df = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(
        "r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("nations"))
    return df.withColumnsRenamed({c: c.replace("r_region", "region_").replace("r_", "region_") for c in df.columns})


@query("arithmetic_columns", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(100 * o_totalprice / 555555e0, 6) AS percent, round(o_totalprice - 2 * 1e3, 6) AS low FROM orders")
def _(spark, sf):
    price = F.col("o_totalprice")
    return rounded(table(spark, sf, "orders").select("o_orderkey", F.sqrt(price).alias("root"), C.ratio(100 * price, F.lit(555555.0)).alias("percent"), (price - 2 * F.lit(1e3)).alias("low")))


@query("same_expression_across_columns", "SELECT feature, phylum || '@phylum' AS phylum, genus || '@genus' AS genus, species || '@species' AS species FROM taxonomy", ["taxonomy"])
def _(spark, sf):
    t = taxonomy(spark, sf)
    return t.select("feature", *[F.concat(F.col(c), F.lit("@" + c)).alias(c) for c in t.columns if c != "feature"])


@query("ordered_factor", """SELECT sample, CASE timepoint WHEN '0dpi' THEN 'Day0' WHEN '1dpi' THEN '1 year' WHEN '6_months' THEN 'last' END AS timepoint,
    CAST(CASE timepoint WHEN '0dpi' THEN 1 WHEN '1dpi' THEN 2 WHEN '6_months' THEN 3 END AS INT) AS timepoint_ord FROM samples""", ["samples"])
def _(spark, sf):
    return C.ordered_levels(samples(spark, sf).select("sample", "timepoint"), "timepoint",
                            ["0dpi", "1dpi", "6_months"], ["Day0", "1 year", "last"])


@query("code_to_label", "SELECT sample, CASE grp_code WHEN 1 THEN 'Lam' WHEN 2 THEN 'T10' WHEN 3 THEN 'T4' END AS injury FROM mapping", ["mapping"])
def _(spark, sf):
    return mapping(spark, sf).select("sample", C.lookup(F.col("grp_code"), {1: "Lam", 2: "T10", 3: "T4"}).alias("injury"))


@query("conditional_without_else", "SELECT genome, CASE WHEN contamination < 5 THEN 'Less than 5%' WHEN contamination >= 5 AND contamination < 10 THEN '5%-10%' END AS class FROM quality", ["quality"])
def _(spark, sf):
    c = F.col("contamination")
    return quality(spark, sf).select("genome", F.when(c < 5, "Less than 5%").when((c >= 5) & (c < 10), "5%-10%").alias("class"))


@query("conditional_two_branches", "SELECT doc_id, CASE WHEN regexp_matches(source, '1') THEN 'one' ELSE source END AS label FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("source").rlike("1"), "one").otherwise(F.col("source")).alias("label"))


@query("align_by_key", "SELECT sample, grp, SUM(value) AS total FROM abundance JOIN samples USING (sample) GROUP BY 1, 2", ["abundance", "samples"])
def _(spark, sf):
    totals = abundance(spark, sf).groupBy("sample").agg(F.sum("value").alias("total"))
    return totals.join(samples(spark, sf).select("sample", "grp"), "sample")


# ---- filters -----------------------------------------------------------------------

@query("filter_conditions", "SELECT sample FROM samples WHERE (timepoint = '0dpi' OR timepoint = '1dpi') AND cohort <> 'M_Day1' AND cohort <> 'F_Day4'", ["samples"])
def _(spark, sf):
    return samples(spark, sf).filter((F.col("timepoint") == "0dpi") | (F.col("timepoint") == "1dpi")).filter(
        (F.col("cohort") != "M_Day1") & (F.col("cohort") != "F_Day4")).select("sample")


@query("exclude_replicates", "SELECT sample, day FROM (SELECT CASE WHEN day = 3 THEN sample || '_Repeat' ELSE sample END AS sample, day FROM samples) WHERE NOT contains(sample, 'Repeat')", ["samples"])
def _(spark, sf):
    marked = samples(spark, sf).withColumn("sample", F.when(F.col("day") == 3, F.concat("sample", F.lit("_Repeat"))).otherwise(F.col("sample")))
    return C.exclude_replicates(marked).select("sample", "day")


@query("predicate_argument", "SELECT sample, sex FROM samples WHERE sex = 'M' AND (timepoint = '2dpi' OR timepoint = '3dpi')", ["samples"])
def _(spark, sf):
    def window(df, when):
        return df.filter(when & (F.col("sex") == "M")).select("sample", "sex")
    return samples(spark, sf).transform(window, (F.col("timepoint") == "2dpi") | (F.col("timepoint") == "3dpi"))


@query("in_computed_set", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING AVG(n_chars) > 2300)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    long = docs.groupBy("source").agg(F.avg("n_chars").alias("m")).filter("m > 2300")
    return docs.join(long, "source", "left_semi").select("doc_id", "source")


@query("aggregate_threshold", "SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY 1 HAVING MAX(o_totalprice) >= 300000")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")).filter("top >= 300000")


@query("drop_null_and_blank", "SELECT subject, d7 IS NOT NULL AS early, d31 IS NOT NULL AS late FROM transit_wide WHERE d21 IS NOT NULL AND injury <> ''", ["transit_wide"])
def _(spark, sf):
    return transit_wide(spark, sf).filter(F.col("d21").isNotNull() & (F.col("injury") != "")).select("subject", F.col("d7").isNotNull().alias("early"), F.col("d31").isNotNull().alias("late"))


@query("prefix_filter", "SELECT gene_id, feature, gene_freq FROM gene_counts WHERE starts_with(gene_id, 'GH')", ["gene_counts"])
def _(spark, sf):
    return gene_counts(spark, sf).filter(F.col("gene_id").startswith("GH")).select("gene_id", "feature", "gene_freq")


@query("regex_alternation", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'small ring|red|blue wid')")
def _(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_name").rlike("small ring|red|blue wid")).select("p_partkey", "p_name")


@query("any_column_matches", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)RED|promo') OR regexp_matches(p_type, '(?i)RED|promo') OR regexp_matches(p_brand, '(?i)RED|promo')")
def _(spark, sf):
    return table(spark, sf, "part").filter(C.any_column_matches(["p_name", "p_type", "p_brand"], "RED|promo")).select("p_partkey")


@query("drop_all_zero_groups", "SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING bool_and(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END = 0))")
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("v"))
    live = events.groupBy("user_id").agg(F.bool_or(F.col("v") != 0).alias("live")).filter("live")
    return events.join(live, "user_id", "left_semi").select("user_id", "event_id")


@query("cross_side_predicate", "SELECT y.sample AS a, x.sample AS b FROM samples x JOIN samples y ON x.subject = y.subject AND y.day = 0 AND x.day <> 0", ["samples"])
def _(spark, sf):
    x = samples(spark, sf).select(F.col("sample").alias("b"), "subject", F.col("day").alias("day_b"))
    y = samples(spark, sf).select(F.col("sample").alias("a"), "subject", F.col("day").alias("day_a"))
    return y.filter("day_a = 0").join(x.filter("day_b != 0"), "subject").select("a", "b")


@query("one_triangle_of_pairs", "SELECT x.sample AS a, y.sample AS b FROM samples x JOIN samples y ON x.subject = y.subject AND x.sample < y.sample", ["samples"])
def _(spark, sf):
    x, y = (samples(spark, sf).select(F.col("sample").alias(c), "subject") for c in "ab")
    return x.join(y, "subject").filter("a < b").select("a", "b")


@query("manual_exclusion", "SELECT DISTINCT genus, species FROM taxonomy WHERE species NOT IN ('s__Brand#1 PROMO', 's__Brand#2 SMALL')", ["taxonomy"])
def _(spark, sf):
    return taxonomy(spark, sf).filter(~F.col("species").isin("s__Brand#1 PROMO", "s__Brand#2 SMALL")).select("genus", "species").distinct()


# ---- joins -------------------------------------------------------------------------

@query("inner_join", "SELECT sample, feature, value, grp FROM abundance JOIN samples USING (sample)", ["abundance", "samples"])
def _(spark, sf):
    return abundance(spark, sf).join(samples(spark, sf).select("sample", "grp"), "sample")


@query("natural_join", "SELECT feature, gene_id, gene_freq, change_direction FROM gene_counts NATURAL JOIN change_groups", ["gene_counts", "change_groups"])
def _(spark, sf):
    return C.natural_join(gene_counts(spark, sf).select("feature", "gene_id", "gene_freq"), change_groups(spark, sf))


@query("same_dimension_twice", "SELECT a, b, round(d, 6) AS d, x.day AS day_a, y.day AS day_b FROM bray JOIN samples x ON x.sample = a JOIN samples y ON y.sample = b", ["bray", "samples"])
def _(spark, sf):
    who = samples(spark, sf).select("sample", "day")
    pairs = distance.bray_curtis(abundance(spark, sf))
    return rounded(pairs.join(who.withColumnsRenamed({"sample": "a", "day": "day_a"}), "a").join(
        who.withColumnsRenamed({"sample": "b", "day": "day_b"}), "b"))


@query("natural_full_join_chain", """SELECT text, x, y, z FROM (SELECT n_chars AS text, COUNT(*) AS x FROM documents WHERE source = 'src1' GROUP BY 1) FULL JOIN
    (SELECT n_chars AS text, COUNT(*) AS y FROM documents WHERE source = 'src2' GROUP BY 1) USING (text) FULL JOIN (SELECT n_chars AS text, COUNT(*) AS z FROM documents WHERE source = 'src3' GROUP BY 1) USING (text)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("n_chars").alias("text"), "source")
    one = lambda s, c: docs.filter(F.col("source") == s).groupBy("text").agg(F.count(F.lit(1)).alias(c))
    first = C.natural_join(one("src1", "x"), one("src2", "y"), "full")
    return C.natural_join(first, one("src3", "z"), "full")


@query("one_to_many_join", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def _(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_suppkey")


@query("semi_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi")


_SIZES = [("src0", 1573), ("src1", 1296), ("src2", 1091)]


@query("join_literal_dimension", "SELECT source, n, round(100 * n / CAST(size AS DOUBLE), 2) AS percent FROM (SELECT source, COUNT(*) AS n FROM documents GROUP BY 1) JOIN (VALUES ('src0', 1573), ('src1', 1296), ('src2', 1091)) t(source, size) USING (source)")
def _(spark, sf):
    sizes = spark.createDataFrame(_SIZES, "source string, size int")
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sizes, "source").select("source", "n", F.round(C.ratio(100 * F.col("n"), F.col("size")), 2).alias("percent"))


# ---- reshape -----------------------------------------------------------------------

@query("unpivot_all_but_ids", "SELECT subject, injury, timepoint, round(t, 6) AS t FROM (SELECT subject, injury, 'd7' AS timepoint, d7 AS t FROM transit_wide UNION ALL SELECT subject, injury, 'd15', d15 FROM transit_wide UNION ALL SELECT subject, injury, 'd21', d21 FROM transit_wide UNION ALL SELECT subject, injury, 'd31', d31 FROM transit_wide)", ["transit_wide"])
def _(spark, sf):
    return rounded(transit_wide(spark, sf).unpivot(["subject", "injury"], None, "timepoint", "t"))


@query("unpivot_ranks", "SELECT feature, 'phylum' AS level, phylum AS taxon FROM taxonomy UNION ALL SELECT feature, 'genus', genus FROM taxonomy UNION ALL SELECT feature, 'species', species FROM taxonomy", ["taxonomy"])
def _(spark, sf):
    return normalize.taxonomy_long(taxonomy(spark, sf), ["phylum", "genus", "species"])


_PHYLA = [f"p__{t}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
_LANGS = ["de", "en", "es", "fr"]


@query("pivot_wider", "SELECT sample, " + ", ".join(f"SUM(value) FILTER (phylum = '{p}') AS {p}" for p in _PHYLA) + " FROM abundance JOIN taxonomy USING (feature) GROUP BY 1", ["abundance", "taxonomy"])
def _(spark, sf):
    taxa = normalize.collapse(abundance(spark, sf), taxonomy(spark, sf), "phylum")
    return genes.pivot_profile(taxa, ["sample"], "taxon", _PHYLA, "value")


@query("pivot_wider_fill_zero", "SELECT doc_id % 97 AS k, " + ", ".join(f"COUNT(*) FILTER (lang = '{g}') AS {g}" for g in _LANGS) + " FROM documents GROUP BY 1")
def _(spark, sf):
    counts = table(spark, sf, "documents").groupBy((F.col("doc_id") % 97).alias("k"), "lang").agg(F.count(F.lit(1)).alias("n"))
    return genes.pivot_profile(counts, ["k"], "lang", _LANGS, "n", fill=0)


@query("spread_members_and_back", "SELECT representative, CAST(ROW_NUMBER() OVER (PARTITION BY representative ORDER BY member) AS INT) AS no, member FROM clusters", ["clusters"])
def _(spark, sf):
    # a column per member number, filled by number; only the numbers of the widest cluster reach the driver
    rows = settle(numbered(clusters(spark, sf).select("representative", "member"), ["representative"], "member"), "members")
    width = rows.agg(F.max("no")).head()[0] or 0
    block = F.floor((F.col("no") - 1) / 100).cast("int")  # a hundred members in a row, however large the cluster
    spread = rows.withColumns({"block": block, "place": ((F.col("no") - 1) % 100).cast("int")}).groupBy("representative", "block").agg(
        *[F.max(F.when(F.col("place") == i, F.col("member"))).alias(f"m{i}") for i in range(min(width, 100))])
    back = spread.unpivot(["representative", "block"], [f"m{i}" for i in range(min(width, 100))], "place", "member").where("member IS NOT NULL")
    return back.select("representative", (F.col("block") * 100 + F.substring("place", 2, 3).cast("int") + 1).cast("int").alias("no"), "member")


@query("split_to_rows_keep_null", "SELECT gene_id, feature, unnest(CASE WHEN subheader IS NULL THEN [NULL] ELSE string_split(subheader, ', ') END) AS term FROM (SELECT gene_id, feature, CASE WHEN gene_id = 'AA30' THEN NULL ELSE subheader END AS subheader FROM gene_counts)", ["gene_counts"])
def _(spark, sf):
    g = gene_counts(spark, sf).withColumn("subheader", F.when(F.col("gene_id") != "AA30", F.col("subheader")))
    return g.select("gene_id", "feature", F.explode_outer(F.split("subheader", ", ")).alias("term"))


@query("collapse_and_split", "SELECT representative, CAST(member AS STRING) AS member FROM clusters", ["clusters"])
def _(spark, sf):
    joined = clusters(spark, sf).groupBy("representative").agg(F.concat_ws(",", F.array_sort(F.collect_list("member")).cast("array<string>")).alias("members"))
    return joined.select("representative", F.explode(F.split("members", ",")).alias("member"))


@query("nest_and_unnest", "SELECT l_suppkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    nested = counts.groupBy("l_suppkey").agg(F.collect_list(F.struct("l_linenumber", "n")).alias("data"))
    return nested.select("l_suppkey", F.inline("data"))


# ---- aggregates --------------------------------------------------------------------

@query("grouped_sum", "SELECT feature, SUM(value) AS total FROM abundance GROUP BY 1", ["abundance"])
def _(spark, sf):
    return abundance(spark, sf).groupBy("feature").agg(F.sum("value").alias("total"))


@query("grouped_count", "SELECT source, lang, COUNT(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("grouped_mean", "SELECT label, round(AVG(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(AVG(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY 1")
def _(spark, sf):
    at = lambda i: F.avg(F.col("embedding")[i].cast("double"))
    return rounded(table(spark, sf, "embeddings").groupBy("label").agg(at(0).alias("x"), at(1).alias("y")))


@query("grouped_median", "SELECT l_suppkey, round(median(l_quantity), 6) AS median, COUNT(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(exact_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity"))


@query("grouped_sd", "SELECT c_nationkey, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1")
def _(spark, sf):
    return rounded(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.stddev_samp("c_acctbal").alias("sd")))


@query("largest_group_median", "SELECT l_returnflag, MAX(m) AS top FROM (SELECT l_returnflag, l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    medians = exact_median(table(spark, sf, "lineitem"), ["l_returnflag", "l_suppkey"], "l_quantity")
    return medians.groupBy("l_returnflag").agg(F.max("median").alias("top"))


@query("boolean_aggregates", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS some_p, bool_and(o_totalprice > 50000) AS all_big, MAX(o_totalprice) >= 400000 AS top FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("some_p"), F.bool_and(F.col("o_totalprice") > 50000).alias("all_big"),
        (F.max("o_totalprice") >= 400000).alias("top"))


@query("presence_marker", "SELECT DISTINCT representative, db, CAST(1 AS INT) AS present FROM clusters", ["clusters"])
def _(spark, sf):
    return clusters(spark, sf).select("representative", "db").distinct().withColumn("present", F.lit(1))


@query("string_collapse", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def _(spark, sf):
    both = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("global_aggregates", "SELECT round(AVG(l_quantity), 6) AS mean, MIN(l_quantity) AS low, MAX(l_quantity) AS high, round((SELECT median(l_extendedprice) FROM lineitem), 6) AS median FROM lineitem")
def _(spark, sf):
    line = table(spark, sf, "lineitem")
    middle = exact_median(line, [], "l_extendedprice").select("median")
    return rounded(line.agg(F.avg("l_quantity").alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")).withColumn("median", middle.scalar()))


@query("distinct_rows_counted", "SELECT subject, bms_score, grp, sex, COUNT(*) OVER () AS n FROM (SELECT DISTINCT subject, bms_score, grp, sex FROM samples)", ["samples"])
def _(spark, sf):
    rows = samples(spark, sf).select("subject", "bms_score", "grp", "sex").distinct()
    return rows.withColumn("n", rows.agg(F.count(F.lit(1))).scalar())


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_type").distinct()


@query("group_by_parameter", "SELECT cohort, COUNT(*) AS n FROM samples GROUP BY 1", ["samples"])
def _(spark, sf):
    def sizes(df, factor):
        return df.groupBy(F.col(factor)).agg(F.count(F.lit(1)).alias("n"))
    return samples(spark, sf).transform(sizes, "cohort")


# ---- windows, order, sets ------------------------------------------------------------

@query("share_of_group_total", "SELECT l_orderkey, l_linenumber, round(l_quantity / SUM(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def _(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), "l_linenumber", F.col("l_quantity").alias("value"))
    out = normalize.relative_abundance(line, out="share")
    return rounded(out.select(F.col("sample").alias("l_orderkey"), "l_linenumber", "share"))


@query("row_number_in_group", "SELECT representative, member, ROW_NUMBER() OVER (PARTITION BY representative ORDER BY member) AS no FROM clusters", ["clusters"])
def _(spark, sf):
    return numbered(clusters(spark, sf).select("representative", "member"), ["representative"], "member")


@query("group_predicate_on_rows", "SELECT o_orderkey, bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS settled FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    flags = orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("settled"))
    return orders.join(flags, "o_custkey").select("o_orderkey", "settled")


@query("mid_ranks", "SELECT l_suppkey, l_quantity, RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (n - 1) / 2e0 AS rank, n FROM (SELECT l_suppkey, l_quantity, l_orderkey, COUNT(*) OVER (PARTITION BY l_suppkey, l_quantity) AS n FROM lineitem) QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_quantity) = 1")
def _(spark, sf):
    from quadrat.operators.counts import midrank, positions, value_counts
    counts = value_counts(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")
    return positions(counts, ["l_suppkey"], "l_quantity").select("l_suppkey", "l_quantity", midrank().alias("rank"), "n")


@query("sort_rows", "SELECT phylum, family, genome FROM quality ORDER BY phylum, family, genome", ["quality"])
def _(spark, sf):
    return quality(spark, sf).select("phylum", "family", "genome").orderBy("phylum", "family", "genome")


@query("sorted_unique_values", "SELECT DISTINCT family FROM quality ORDER BY 1", ["quality"])
def _(spark, sf):
    return quality(spark, sf).select("family").distinct().orderBy("family")


@query("first_k", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 2")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(2)


@query("union_by_name", " UNION ALL ".join(f"SELECT subject, round({d}, 6) AS t FROM transit_wide WHERE {d} > 20" for d in ("d7", "d15", "d21", "d31")), ["transit_wide"])
def _(spark, sf):
    first, *others = [transit_wide(spark, sf).filter(F.col(d) > 20).select("subject", F.round(d, 6).alias("t")) for d in ("d7", "d15", "d21", "d31")]
    for other in others:
        first = first.unionByName(other.select("t", "subject"))
    return first


@query("union_with_source_and_missing", "SELECT '1' AS sheet, s_suppkey AS k, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT '2', c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    a = table(spark, sf, "supplier").select(F.lit("1").alias("sheet"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    b = table(spark, sf, "customer").select(F.lit("2").alias("sheet"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def _(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf, "customer").select("c_nationkey")).distinct()


# ---- scalar functions ----------------------------------------------------------------

@query("strip_rank_prefixes", "SELECT feature, substr(phylum, 4) AS phylum, substr(genus, 4) AS genus, substr(species, 4) AS species FROM taxonomy", ["taxonomy"])
def _(spark, sf):
    return C.strip_rank_prefixes(taxonomy(spark, sf))


@query("remove_all_matches", "SELECT DISTINCT p_name, regexp_replace(p_name, '(?i)E[DN]| widget', '', 'g') AS cleaned FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_name", F.regexp_replace("p_name", "(?i)E[DN]| widget", "").alias("cleaned")).distinct()


@query("ordered_replacements", "SELECT sample, replace(replace(timepoint, '6_months', '180'), 'dpi', '') AS t FROM samples", ["samples"])
def _(spark, sf):
    return samples(spark, sf).select("sample", C.replace_each(F.col("timepoint"), {"6_months": "180", "dpi": ""}).alias("t"))


@query("regex_and_substring_tests", "SELECT doc_id, regexp_matches(source, '^src[0-3]$') AS low, contains(text, 'que') AS q FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("source").rlike("^src[0-3]$").alias("low"), F.col("text").contains("que").alias("q"))


@query("text_to_number", "SELECT DISTINCT p_brand, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS no, TRY_CAST(p_brand AS DOUBLE) AS bad FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_brand", F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double").alias("no"), F.col("p_brand").try_cast("double").alias("bad")).distinct()


@query("concatenate", "SELECT genome, concat_ws(' - ', phylum, family) AS phylum_family FROM quality", ["quality"])
def _(spark, sf):
    return quality(spark, sf).select("genome", F.concat_ws(" - ", "phylum", "family").alias("phylum_family"))


@query("lower_case", "SELECT p_partkey, lower(p_type) AS t FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("t"))


@query("matched_terms", "SELECT p_partkey, nullif(concat_ws(', ', CASE WHEN contains(t, 'ring') THEN 'ring' END, CASE WHEN contains(t, 'small') THEN 'SMALL' END), '') AS matches FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type)) AS t FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.matched_terms(["p_name", "p_type"], ["ring", "SMALL"]).alias("matches"))


@query("round_and_format", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) AS r, printf('%.1f', l_quantity) AS f FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 7, 2).alias("r"), F.format_string("%.1f", "l_quantity").alias("f"))


@query("numeric_functions", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS root, round(ln(abs(s_acctbal) + 1), 6) AS log, round(s_acctbal / nullif(s_suppkey, 0), 6) AS ratio FROM supplier")
def _(spark, sf):
    x = F.col("s_acctbal")
    return rounded(table(spark, sf, "supplier").select("s_suppkey", F.sqrt(F.abs(x)).alias("root"), F.ln(F.abs(x) + 1).alias("log"), C.ratio(x, F.col("s_suppkey")).alias("ratio")))


@query("timepoint_to_day", "SELECT sample, CASE WHEN timepoint = '6_months' THEN 180e0 ELSE CAST(replace(timepoint, 'dpi', '') AS DOUBLE) END AS day FROM samples", ["samples"])
def _(spark, sf):
    return samples(spark, sf).select("sample", C.day_number(F.col("timepoint")).alias("day"))


@query("label_blank_cells", "SELECT p_partkey, CASE WHEN b = '' THEN 'Unclassified genus' ELSE b END AS genus FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS b FROM part)")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand")).alias("genus"))
    return C.label_blank(part, ["genus"])
