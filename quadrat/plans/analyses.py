"""Complete analyses, composed from the operators.

The sample table has ``sample, subject, day, timepoint, grp, sex, cohort, bms_score``;
abundance is ``sample, feature, value``. Subsets, cohorts to leave out, time windows and
taxa are arguments; variants of an analysis run as one job with the variant as a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.columns import lookup, natural_join, ordered_levels, p_symbol, strip_prefix
from quadrat.operators import (clustering, dereplicate, distance, diversity, genes, normalize, ordination,
                               origins, permanova, ranktests, similarity, summaries)
from quadrat.operators.counts import exact_median
from quadrat.operators.multitest import p_adjust
from quadrat.sources import delimited, fasta
from quadrat.storage import settle


def with_variants(df: DataFrame, variants: Mapping[str, Column], name: str = "variant") -> DataFrame:
    """One copy of a row for every variant whose predicate it meets."""
    tags = F.array_compact(F.array(*[F.when(p, F.lit(v)) for v, p in variants.items()]))
    return df.withColumn(name, F.explode(tags))


def _medians(df, keys, group, value):
    return settle(exact_median(df, [*keys, group], value).select(*keys, F.col(group).alias("_g"), "median"),
                  "medians")


def _with_medians(tests, medians, keys):
    for side in ("1", "2"):
        tests = tests.join(medians.withColumnsRenamed({"_g": "group" + side, "median": "median" + side}),
                           [*keys, "group" + side], "left")
    return tests


# ---- diversity ---------------------------------------------------------------------

def alpha_by_group(ab: DataFrame, samples: DataFrame, pairs: Sequence[tuple[str, str]],
                   outliers: Sequence[str], metric: str = "shannon") -> DataFrame:
    """Diversity compared between groups per phase (day 0, later), sex, and with or
    without the outlier cohorts; uncorrected, with significance stars."""
    div = diversity.alpha_diversity(ab, [metric]).join(samples, "sample")
    div = div.withColumn("phase", F.when(F.col("day") == 0, "before").otherwise("after"))
    div = with_variants(div, {"all": F.lit(True), "no outliers": ~F.col("cohort").isin(*outliers)})
    tests = ranktests.rank_sum(div, ["variant", "phase", "sex"], metric, "grp", pairs, correction=None, exact=False)
    return tests.withColumn("label", p_symbol(F.col("p")))


def alpha_over_time(ab: DataFrame, samples: DataFrame, reference: str, levels: Sequence[str],
                    outliers: Sequence[str], metric: str = "shannon") -> DataFrame:
    """Diversity over time by sex: medians and tests of "reference is lower"."""
    div = diversity.alpha_diversity(ab, [metric]).join(samples.filter(~F.col("cohort").isin(*outliers)), "sample")
    keys = ["sex", "timepoint"]
    tests = ranktests.rank_sum(div, keys, metric, "grp", reference, levels, "less", "fdr")
    return _with_medians(tests, _medians(div, keys, "grp", metric), keys)


def divergence_from_baseline(ab: DataFrame, samples: DataFrame, reference: str, levels: Sequence[str],
                             outliers: Sequence[str]) -> dict[str, DataFrame]:
    """Dissimilarity of later samples to their subject's day 0: values, tests, trajectory, boxes.

    Slices are ``all`` samples, and males and females without the outlier cohorts.
    """
    values = distance.baseline_dissimilarity(ab, samples)
    values = values.join(samples.select("sample", "timepoint", "grp", "sex", "cohort"), "sample")
    inlier = ~F.col("cohort").isin(*outliers)
    values = settle(with_variants(values, {"all": F.lit(True), "male": inlier & (F.col("sex") == "M"),
                                           "female": inlier & (F.col("sex") == "F")}, "slice"), "divergence")
    keys = ["slice", "timepoint"]
    return {
        "values": values,
        "tests": ranktests.rank_sum(values, keys, "d", "grp", reference, levels, "less", "fdr"),
        "trajectory": summaries.trajectory(values, "timepoint", "grp", "d", by=["slice"]),
        "boxes": summaries.box_stats(values, [*keys, "grp"], "d"),
    }


# ---- ordination --------------------------------------------------------------------

@dataclass
class Ordination:
    coords: DataFrame
    axes: DataFrame
    centroids: DataFrame
    ellipses: DataFrame
    permanova: DataFrame


def sample_distances(ab: DataFrame, samples: DataFrame, double: bool = False) -> DataFrame:
    """Bray-Curtis distances of the chosen samples; ``double`` takes them once more of the
    distance matrix itself."""
    dist = distance.bray_curtis(ab.join(samples, "sample", "left_semi"))
    if double:
        dist = distance.bray_curtis(distance.dist_as_abundance(settle(dist, "pairs")))
    return settle(dist, "pairs")


def ordinate(dist: DataFrame, samples: DataFrame, factor: str, level: float = 0.75,
             permutations: int = 9999, seed: int = 1, correction: str = "cailliez") -> Ordination:
    """Principal coordinates with centroids and ellipses of a factor, and its PERMANOVA."""
    coords, axes = ordination.pcoa(dist, correction=correction)
    points = ordination.coords_wide(coords).join(samples.select("sample", factor), "sample")
    return Ordination(coords, axes, ordination.centroids(coords, samples, factor),
                      ordination.group_ellipse(points, factor, level),
                      permanova.permanova(dist, samples, factor, permutations, seed))


def ordinations_by_run(ab: DataFrame, samples: DataFrame, runs: Mapping[str, tuple[Column, str]], level: float = 0.7) -> dict[str, DataFrame]:
    """Ordinations of several choices of samples, each coloured by a factor: points, centroids, ellipses and axes by ``run``.

    ``runs`` names the predicate on the samples and the factor of each. Runs of one choice share their distances and
    coordinates; different choices are ordinated one after another.
    """
    done: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = {}
    tables: dict[str, list[DataFrame]] = {"points": [], "centroids": [], "ellipses": [], "axes": []}
    for run, (chosen, factor) in runs.items():
        who = samples.filter(chosen)
        if str(chosen) not in done:
            coords, axes = ordination.pcoa(sample_distances(ab, who))
            done[str(chosen)] = (coords, axes, settle(ordination.coords_wide(coords), "points"))
        coords, axes, wide = done[str(chosen)]
        points = wide.join(who.select("sample", F.col(factor).cast("string").alias("level")), "sample")
        named = lambda df: df.select(F.lit(run).alias("run"), "*")
        tables["points"].append(named(points))
        tables["centroids"].append(named(ordination.centroids(coords, who.withColumn("level", F.col(factor).cast("string")), "level")))
        tables["ellipses"].append(named(ordination.group_ellipse(points, "level", level)))
        tables["axes"].append(named(axes.select("axis", "percent", "constant")))
    return {name: reduce(DataFrame.unionByName, parts) for name, parts in tables.items()}


# ---- taxa --------------------------------------------------------------------------

def taxon_values(ab: DataFrame, samples: DataFrame, taxonomy: DataFrame, level: str,
                 context: Sequence[str]) -> DataFrame:
    """Weighted relative abundances (%) per context, taxon and group, zeros included.

    ``samples`` may list a sample under several contexts.
    """
    chosen = ab.join(samples.select("sample"), "sample", "left_semi")
    taxa = normalize.taxon_shares(chosen, taxonomy, level, 100.0)
    placed = taxa.join(samples.select("sample", "grp", *context), "sample")
    counts = ranktests.group_counts(placed, [*context, "taxon"], "rel_abund", "grp")
    sizes = samples.groupBy(*context, "grp").agg(F.count(F.lit(1)).alias("size"))
    return ranktests.add_implicit_zeros(counts, sizes, list(context), "taxon", "rel_abund", "grp")


def differential_taxa(ab: DataFrame, samples: DataFrame, taxonomy: DataFrame, level: str,
                      windows: Mapping[str, Sequence[str]], reference: str, levels: Sequence[str],
                      alpha: float = 0.05) -> DataFrame:
    """Taxa that differ between groups within time windows, per sex.

    Kruskal-Wallis per taxon, BH over the taxa of a window, then pairwise tests of the
    survivors with BH within the taxon; rows are the significant pairs with the
    reference. All windows run together.
    """
    inside = with_variants(samples, {w: F.col("timepoint").isin(*t) for w, t in windows.items()}, "window")
    context = ["sex", "window"]
    counts = taxon_values(ab, inside, taxonomy, level, context)
    overall = p_adjust(ranktests.kruskal(counts, [*context, "taxon"], "rel_abund", "grp", "n"),
                       family=context, out="p_experiment")
    hits = settle(overall.filter(F.col("p_experiment") < alpha).select(*context, "taxon", "p_experiment"), "hits")
    chosen = counts.join(hits, [*context, "taxon"], "left_semi")
    pairs = ranktests.rank_sum(chosen, [*context, "taxon"], "rel_abund", "grp", "all", levels,
                               exact=False, weight="n")
    return (pairs.filter((F.col("p_adj") < alpha) & (F.col("group2") == reference))
            .join(hits, [*context, "taxon"])
            .select(*context, "taxon", "group1", "group2", "p_experiment", "p_adj"))


def union_of_windows(hits: DataFrame, windows: Sequence[str], sex: str | None = None) -> DataFrame:
    """Distinct taxa found in any of the windows."""
    hits = hits.filter(F.col("window").isin(*windows))
    return (hits.filter(F.col("sex") == sex) if sex else hits).select("taxon").distinct()


def taxon_profiles(ab: DataFrame, samples: DataFrame, taxonomy: DataFrame, level: str, taxa: DataFrame,
                   keep: Column, reference: str, levels: Sequence[str], when: Column,
                   exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Profiles of selected taxa by group: selection, tests, boxes and densities.

    A taxon is kept by the largest group median over all samples (``keep`` is a predicate
    on ``median``); tests, boxes and densities use the samples that meet ``when``. Tables
    carry ``position``, the order of the taxa by that median.
    """
    counts = taxon_values(ab, samples, taxonomy, level, []).join(taxa, "taxon", "left_semi")
    chosen = summaries.select_taxa(counts, "grp", keep, weight="n").filter(~F.col("taxon").isin(*exclude))
    chosen = settle(chosen, "taxa")
    order = summaries.order_by_statistic(chosen, "taxon", F.max("median")).select("taxon", "position")
    later = taxon_values(ab, samples.filter(when), taxonomy, level, []).join(chosen, "taxon", "left_semi")
    tests = ranktests.rank_sum(later, ["taxon"], "rel_abund", "grp", reference, levels, correction="fdr",
                               weight="n")
    return {
        "selection": chosen.join(order, "taxon"),
        "tests": tests.join(order, "taxon"),
        "boxes": summaries.box_stats(later, ["taxon", "grp"], "rel_abund", "n").join(order, "taxon"),
        "density": summaries.kde(later, ["taxon", "grp"], "rel_abund", weight="n", binned=True).join(order, "taxon"),
    }


# ---- genes -------------------------------------------------------------------------

# fixed values: name patterns of the sugar transport modules
SUGAR_TRANSPORT = (
    "Arabinosaccharide transport system", "Putative multiple sugar transport system",
    "D-Allose transport system", "D-Xylose transport system", "Erythritol transport system",
    "Fructose transport system", "Glucose/arabinose transport system",
    "Glucose/mannose transport system", "Inositol transport system",
    "Inositol-phosphate transport system", "L-Arabinose transport system",
    "L-Arabinose/lactose transport system", "Maltose/maltodextrin transport system", "PTS system",
    "Multiple sugar transport system", "Oligogalacturonide transport system",
    "Putative simple sugar transport system", "Putative sorbitol/mannitol transport system",
    "Putative xylitol transport system", "Raffinose/stachyose/melibiose transport system",
    "Rhamnose transport system", "Ribose transport system", "Trehalose transport system",
    "Trehalose/maltose transport system", "Putative chitobiose transport system",
    "Putative fructooligosaccharide transport system")
STARCH_UTILISATION = ("susR", "susA", "susB", "susC", "susD", "susE", "susF", "susG")
SUBSTRATE_SUFFIXES = (" Oligo| Backbone", " Cleavage*")


def clustered_profile(profile: DataFrame, row: str, term: str, split: str | None = None) -> dict[str, DataFrame]:
    """Trees of the rows (apart per ``split``) and of the columns of a profile."""
    keys = [split] if split else []
    cells = settle(profile.select(*keys, F.col(row).alias("sample"), F.col(term).alias("feature"),
                                  F.col("total").cast("double").alias("value")), "cells")
    flat = cells.groupBy("feature", "sample").agg(F.sum("value").alias("value"))
    return {"rows": clustering.complete_linkage(distance.euclidean(cells, split=split), split),
            "columns": clustering.complete_linkage(distance.euclidean(distance.transpose(flat)))}


def carbohydrate_profile(genes_: DataFrame, taxa: DataFrame, by: Sequence[str], family: str = "GH",
                         exclude: Sequence[str] = (), suffixes: Sequence[str] = SUBSTRATE_SUFFIXES) -> DataFrame:
    """Glycoside hydrolase counts by substrate; taxa without change are left out."""
    changing = taxa.filter(F.col("change_direction") != "No Change")
    out = genes.functional_profile(genes_, changing, F.col("gene_id").startswith(family), by, strip=suffixes)
    return out.filter(~F.col("subheader").isin(*exclude)) if exclude else out


def carbohydrate_tests(profile: DataFrame) -> dict[str, DataFrame]:
    """Counts per substrate compared between change directions, and boxes."""
    profile = profile.withColumn("sqrt_total", F.sqrt("total"))
    keys = ["subheader"]
    return {"values": profile,
            "tests": ranktests.rank_sum(profile, keys, "total", "change_direction", "all", correction="fdr", exact=False),
            "boxes": summaries.box_stats(profile, [*keys, "change_direction"], "total")}


def transporter_profile(genes_: DataFrame, taxa: DataFrame, by: Sequence[str],
                        modules: Sequence[str] = SUGAR_TRANSPORT) -> DataFrame:
    """Gene counts of the transport modules per taxon."""
    pattern = "|".join(modules)
    return genes.functional_profile(genes_, taxa, F.col("module").rlike(pattern), by, term="module", separator=None)


def starch_utilisation(annotations: DataFrame, taxa: DataFrame, by: Sequence[str],
                       terms: Sequence[str] = STARCH_UTILISATION, columns: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of the components per taxon, with the order of taxa by mean count."""
    counts = genes.pattern_counts(natural_join(annotations, taxa), terms, by, columns)
    order = summaries.order_by_statistic(counts, by[0], F.avg("total_occurrences")).select(by[0], "position")
    return counts.join(order, by[0])


# ---- genomes -----------------------------------------------------------------------

def dereplicate_genomes(spark: SparkSession, fasta_path: str, quality: DataFrame, out: str, k: int = 21, threshold: float = 95.0,
                        precluster: float | None = 90.0, extension: str = "fa") -> tuple[str, str]:
    """From genome files to a cluster definition and the representatives' files.

    Reads FASTA, dereplicates (see ``operators.dereplicate``; ``quality`` is ``id, quality``), and writes
    ``out/clusters.tsv`` and ``out/representatives``. Returns both paths.
    """
    sequences = fasta.read_fasta(spark, fasta_path, extension)
    tokens = similarity.genome_sets(sequences, k)
    clusters = settle(dereplicate.dereplicate(tokens, quality, k, threshold, precluster), "clusters")
    table, folder = f"{out}/clusters.tsv", f"{out}/representatives"
    delimited.write_clusters(clusters, table)
    chosen = clusters.select(F.col("representative").alias("genome")).distinct()
    fasta.write_fasta(sequences.join(chosen, "genome", "left_semi"), folder)
    return table, folder


def improved_or_unique(clusters: DataFrame, own: Column, rules: Sequence[tuple[str, str]],
                       sizes: DataFrame) -> DataFrame:
    """Own representatives shared with, or unique against, each database."""
    return origins.origin_counts(origins.shared_or_unique(clusters, own, rules), sizes)


def presence_across_databases(clusters: DataFrame, rules: Sequence[tuple[str, str]], default: str | None,
                              sources: Sequence[str], taxonomy: DataFrame, ranks: Sequence[str],
                              member: str = "member") -> dict[str, DataFrame]:
    """Presence matrix with cleaned taxonomy, and a tree per combination of the ranks.

    Copies of a pattern join the first of them at height 0, so the work grows with patterns, not with pairs of copies.

    ``taxonomy`` has ``representative`` and the rank columns.
    """
    from quadrat.functions.columns import label_blank, strip_rank_prefixes
    found = settle(origins.cluster_origins(clusters, rules, default, member), "origins")
    clean = label_blank(strip_rank_prefixes(taxonomy), ranks)
    matrix = origins.presence_matrix(found, sources).join(clean, "representative")
    # representatives of one pattern are copies: only the first of them is compared
    held = (found.filter(F.col("source").isin(*sources)).join(clean.select("representative", F.struct(*ranks).alias("ranks")), "representative")
            .groupBy("ranks", "representative").agg(F.array_sort(F.collect_set("source")).alias("pattern")))
    firsts = held.groupBy("ranks", "pattern").agg(F.min("representative").alias("head"))
    firsts = settle(firsts.withColumn("slice", F.to_json("ranks", {"ignoreNullFields": "false"})), "heads")
    copies = held.join(firsts, ["ranks", "pattern"]).select("slice", "head", F.col("representative").alias("item"))
    cells = firsts.select("slice", F.col("head").alias("sample"), F.explode("pattern").alias("feature"), F.lit(1.0).alias("value"))
    tree = clustering.complete_linkage(distance.euclidean(cells, split="slice"), "slice")
    rows = clustering.attach_copies(tree, copies, "slice").join(firsts.select("slice", "ranks.*").distinct(), "slice")
    return {"matrix": matrix, "rows": rows.select(*ranks, "left", "right", "height")}


def genome_quality(quality: DataFrame) -> DataFrame:
    """Completeness boxes by phylum-family and contamination class, with the overall median."""
    c = F.col("contamination")
    level = F.when(c < 5, "Less than 5%").when((c >= 5) & (c < 10), "5%-10%")
    rows = quality.withColumns({
        "phylum_family": F.concat_ws(" - ", strip_prefix(F.col("phylum"), "p__"), strip_prefix(F.col("family"), "f__")),
        "contamination_class": F.coalesce(level, F.lit("not classified"))})
    boxes = summaries.box_stats(rows, ["phylum_family", "contamination_class"], "completeness")
    overall = exact_median(rows, [], "completeness").select("median").scalar()
    boxes = boxes.withColumn("overall_median", overall)
    unclassified = F.col("contamination_class") == "not classified"
    return boxes.withColumn("contamination_class", F.when(~unclassified, F.col("contamination_class")))


def mapping_rate(mapped: DataFrame, labels: Mapping[int, str], facet: str) -> DataFrame:
    """Mapping rate boxes by injury and facet, with the overall mean."""
    rows = ordered_levels(mapped.withColumn("injury", lookup(F.col("grp_code"), labels)), "injury",
                          list(labels.values()))
    mean = rows.agg(F.avg("pct_mapped")).scalar()
    return summaries.box_stats(rows, ["injury", "injury_ord", facet], "pct_mapped").withColumn("overall_mean", mean)


def subject_scores(samples: DataFrame, outliers: Sequence[str]) -> DataFrame:
    """Distinct subject scores before and after leaving out cohorts, with the number of rows."""
    rows = with_variants(samples, {"before": F.lit(True), "after": ~F.col("cohort").isin(*outliers)})
    rows = rows.select("variant", "subject", "bms_score", "grp", "sex").distinct()
    sizes = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "variant")


def transit_time(wide: DataFrame, ids: Sequence[str], arm: str, reference: str, arms: Sequence[str],
                 labels: Mapping[str, str]) -> DataFrame:
    """Transit time by timepoint compared between two arms, with the medians of both."""
    long = wide.unpivot(list(ids), list(labels), "timepoint", "time")
    long = ordered_levels(long, "timepoint", list(labels), list(labels.values()))
    tests = ranktests.rank_sum(long, ["timepoint"], "time", arm, reference, arms, correction="fdr")
    return _with_medians(tests, _medians(long, ["timepoint"], arm, "time"), ["timepoint"])
