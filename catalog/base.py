"""Query registry, fixture views in both languages, and SQL text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REF = "AFRICA"  # reference level of the group factor in the fixture data
LEVELS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TIMEPOINTS = ["0dpi", "1dpi", "2dpi", "3dpi", "4dpi", "5dpi", "6_months"]


def query(name: str, sql: str | None = None, views: Iterable[str] = ()):
    """Register a query; ``views`` are fixture views the SQL refers to."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return add


def with_views(views: Iterable[str], sql: str) -> str:
    """Put the named fixture views (and what they need) in front of a SELECT."""
    wanted: list[str] = []
    for v in views:
        for w in (*_NEEDS.get(v, ()), v):
            if w not in wanted:
                wanted.append(w)
    if not wanted:
        return sql.strip()
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# ---- fixture views -------------------------------------------------------------

VIEW_SQL = {
    "abundance": """SELECT n_name || '_' || CAST(year(l_shipdate) AS STRING) AS sample, p_brand || '/' || p_type AS feature, SUM(l_quantity) AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "samples": """SELECT DISTINCT n_name || '_' || CAST(year(l_shipdate) AS STRING) AS sample, n_name AS subject, year(l_shipdate) - 1995 AS day,
        CASE WHEN year(l_shipdate) = 2001 THEN '6_months' ELSE CAST(year(l_shipdate) - 1995 AS STRING) || 'dpi' END AS timepoint,
        r_name AS grp, CASE WHEN n_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
        CASE WHEN n_nationkey % 2 = 0 THEN 'M_Day' ELSE 'F_Day' END || CAST(n_nationkey % 5 AS STRING) AS cohort, n_nationkey % 10 AS bms_score
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "taxonomy": """SELECT DISTINCT p_brand || '/' || p_type AS feature, 'p__' || p_type AS phylum, 'g__' || p_brand AS genus, 's__' || p_brand || ' ' || p_type AS species FROM part""",
    "change_groups": """SELECT DISTINCT p_brand AS feature, CASE CAST(replace(p_brand, 'Brand#', '') AS INT) % 3 WHEN 0 THEN 'Increasing' WHEN 1 THEN 'Decreasing' ELSE 'No Change' END AS change_direction FROM part""",
    "gene_counts": """SELECT CASE WHEN p_size <= 25 THEN 'GH' ELSE 'AA' END || CAST(p_size AS STRING) AS gene_id, p_type AS module,
        replace(p_name, ' ', ', ') AS subheader, p_brand AS feature, COUNT(*) AS gene_freq FROM part GROUP BY 1, 2, 3, 4""",
    "annotations": "SELECT p_brand AS feature, p_name AS hit_a, p_type AS hit_b FROM part",
    "clusters": "SELECT MIN(doc_id) OVER (PARTITION BY text) AS representative, doc_id AS member, source AS db FROM documents",
    "quality": """SELECT s_name AS genome, 'p__' || r_name AS phylum, 'f__' || n_name AS family, 50 + s_suppkey % 50 AS completeness, abs(s_acctbal) / 800 AS contamination
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "mapping": """SELECT c_custkey AS sample, 1 + c_nationkey % 3 AS grp_code, 1e2 * AVG(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS pct_mapped
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
    "transit_wide": """SELECT user_id AS subject, CASE WHEN user_id % 2 = 0 THEN 'Lam' ELSE 'T9' END AS injury,
        AVG(CASE WHEN day(ts) <= 7 THEN value END) AS d7, AVG(CASE WHEN day(ts) BETWEEN 8 AND 15 THEN value END) AS d15, AVG(CASE WHEN day(ts) BETWEEN 16 AND 21 THEN value END) AS d21,
        AVG(CASE WHEN day(ts) > 21 THEN value END) AS d31
        FROM events GROUP BY 1, 2""",
    "rel": "SELECT sample, feature, 100 * value / SUM(value) OVER (PARTITION BY sample) AS rel_abund FROM abundance",
    "totals": "SELECT sample, SUM(value) AS total FROM abundance GROUP BY 1",
    "shannon": """SELECT a.sample, -SUM(value / total * ln(value / total)) AS shannon, 1 - SUM(value / total * value / total) AS simpson, COUNT(*) AS richness
        FROM abundance a JOIN totals t ON a.sample = t.sample WHERE value > 0 GROUP BY 1""",
    "bray": """SELECT x.sample AS a, y.sample AS b, 1 - 2 * COALESCE(m.shared, 0) / (x.total + y.total) AS d
        FROM totals x JOIN totals y ON x.sample < y.sample LEFT JOIN (
          SELECT p.sample AS a, q.sample AS b, SUM(least(p.value, q.value)) AS shared
          FROM abundance p JOIN abundance q ON p.feature = q.feature AND p.sample < q.sample GROUP BY 1, 2) m
        ON m.a = x.sample AND m.b = y.sample""",
}
_NEEDS = {"rel": ("abundance",), "totals": ("abundance",), "shannon": ("abundance", "totals"),
          "bray": ("abundance", "totals")}


def _shipments(spark, sf):
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity")
    where = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return line.join(where, F.col("l_suppkey") == F.col("s_suppkey"))


def _sample_name():
    return F.concat_ws("_", "n_name", F.year("l_shipdate").cast("string"))


def abundance(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("feature"))
    return (_shipments(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(_sample_name().alias("sample"), "feature")
            .agg(F.sum("l_quantity").alias("value")))


def samples(spark, sf):
    day = F.year("l_shipdate") - 1995
    key = F.col("n_nationkey")
    male = key % 2 == 0
    seen = _shipments(spark, sf).select("n_name", "n_nationkey", "n_regionkey",
                                        F.year("l_shipdate").alias("year")).distinct()
    region = table(spark, sf, "region")
    day = F.col("year") - 1995
    return seen.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("_", "n_name", F.col("year").cast("string")).alias("sample"),
        F.col("n_name").alias("subject"), day.alias("day"),
        F.when(F.col("year") == 2001, "6_months").otherwise(F.concat(day.cast("string"), F.lit("dpi")))
        .alias("timepoint"),
        F.col("r_name").alias("grp"), F.when(male, "M").otherwise("F").alias("sex"),
        F.concat(F.when(male, "M_Day").otherwise("F_Day"), (key % 5).cast("string")).alias("cohort"),
        (key % 10).alias("bms_score"))


def taxonomy(spark, sf):
    return table(spark, sf, "part").select(
        F.concat_ws("/", "p_brand", "p_type").alias("feature"),
        F.concat(F.lit("p__"), "p_type").alias("phylum"),
        F.concat(F.lit("g__"), "p_brand").alias("genus"),
        F.concat(F.lit("s__"), "p_brand", F.lit(" "), "p_type").alias("species")).distinct()


def change_groups(spark, sf):
    code = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int") % 3
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("feature"),
        F.when(code == 0, "Increasing").when(code == 1, "Decreasing").otherwise("No Change")
        .alias("change_direction")).distinct()


def gene_counts(spark, sf):
    return table(spark, sf, "part").groupBy(
        F.concat(F.when(F.col("p_size") <= 25, "GH").otherwise("AA"),
                 F.col("p_size").cast("string")).alias("gene_id"),
        F.col("p_type").alias("module"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("subheader"),
        F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).alias("gene_freq"))


def annotations(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("feature"), F.col("p_name").alias("hit_a"), F.col("p_type").alias("hit_b"))


def clusters(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("representative"))
    return docs.join(first, "text").select("representative", F.col("doc_id").alias("member"),
                                           F.col("source").alias("db"))


def quality(spark, sf):
    return (table(spark, sf, "supplier")
            .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_name").alias("genome"), F.concat(F.lit("p__"), "r_name").alias("phylum"),
                    F.concat(F.lit("f__"), "n_name").alias("family"),
                    (F.lit(50) + F.col("s_suppkey") % 50).alias("completeness"),
                    (F.abs("s_acctbal") / 800).alias("contamination")))


def mapping(spark, sf):
    done = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return (table(spark, sf, "customer").join(table(spark, sf, "orders"),
                                              F.col("c_custkey") == F.col("o_custkey"))
            .groupBy(F.col("c_custkey").alias("sample"), (F.col("c_nationkey") % 3 + 1).alias("grp_code"))
            .agg((F.lit(100.0) * F.avg(done)).alias("pct_mapped")))


def transit_wide(spark, sf):
    day = F.day("ts")
    mean = lambda when: F.avg(F.when(when, F.col("value")))
    return table(spark, sf, "events").groupBy(
        F.col("user_id").alias("subject"),
        F.when(F.col("user_id") % 2 == 0, "Lam").otherwise("T9").alias("injury")).agg(
        mean(day <= 7).alias("d7"), mean(day.between(8, 15)).alias("d15"),
        mean(day.between(16, 21)).alias("d21"), mean(day > 21).alias("d31"))


def embedding_cells(spark, sf):
    """Embeddings as long cells: sample, feature, value."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "value")
    ).withColumn("value", F.col("value").cast("double"))


def customer_abundance(spark, sf):
    """A table whose number of samples grows with the data: order part types per customer."""
    return (table(spark, sf, "orders")
            .join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("o_custkey").alias("sample"), F.concat_ws("/", "p_brand", "p_type").alias("feature"))
            .agg(F.sum("l_quantity").alias("value")))


# ---- SQL text helpers ----------------------------------------------------------

def sql_tail(z: str) -> str:
    """P(Z > z) as DuckDB text: the odd-power series for the normal distribution."""
    a = f"greatest(abs({z}), 1e-12)"
    series = (f"list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln({a})"
              f" - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1))))")
    half = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series}"
    return f"(0.5 - sign({z}) * least(0.5, {half}))"


def sql_chi2(h: str, df: str) -> str:
    """Chi-square tail for even or odd whole degrees of freedom."""
    even = (f"exp(-({h}) / 2) * list_sum(list_transform(range(0, CAST({df} / 2 AS BIGINT)), "
            f"lambda i: exp(i * ln(greatest({h}, 1e-300) / 2) - lgamma(i + 1))))")
    odd = (f"(2 * {sql_tail(f'sqrt({h})')} + COALESCE(exp(-({h}) / 2) * list_sum(list_transform("
           f"range(1, CAST(({df} - 1) / 2 AS BIGINT) + 1), lambda i: exp((i - 0.5) * "
           f"ln(greatest({h}, 1e-300) / 2) - lgamma(i + 0.5)))), 0))")
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


def sql_bh(source: str, p: str, family: str) -> str:
    """SELECT text that adds p_adj to ``source``; family is a comma-separated list or ''."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""SELECT * EXCLUDE (_q), CASE WHEN {p} IS NOT NULL THEN least(1, MIN(_q) OVER ({part} ORDER BY {p} DESC NULLS LAST)) END AS p_adj
        FROM (SELECT *, CASE WHEN {p} IS NOT NULL THEN COUNT({p}) OVER ({part}) * {p} / COUNT({p}) OVER ({part} ORDER BY {p}) END AS _q FROM {source})"""


def sql_ranked(source: str, keys: str, value: str) -> str:
    """SELECT text that adds mid-ranks ``rk`` and tie counts ``ties`` within keys."""
    return f"""SELECT *, RANK() OVER (PARTITION BY {keys} ORDER BY {value}) + (COUNT(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0e0 AS rk,
        COUNT(*) OVER (PARTITION BY {keys}, {value}) AS ties FROM {source}"""


def sql_kruskal(source: str, keys: str, value: str, group: str) -> str:
    """SELECT text for the Kruskal-Wallis test of ``source`` per keys."""
    return f"""SELECT {keys}, n, groups, statistic, CAST(groups - 1 AS INT) AS df, CASE WHEN statistic IS NOT NULL THEN {sql_chi2('statistic', '(groups - 1)')} END AS p FROM (
      SELECT {keys}, n, groups, CASE WHEN groups > 1 AND n > 1 AND 1 - tie / (n * n * n - n) > 0 THEN greatest(0, (12 * s / (n * (n + 1)) - 3 * (n + 1)) / (1 - tie / (n * n * n - n))) END AS statistic FROM (
        SELECT {keys}, CAST(SUM(c) AS DOUBLE) AS n, COUNT(*) AS groups, SUM(r * r / c) AS s, SUM(tt) AS tie FROM (
          SELECT {keys}, {group}, SUM(rk) AS r, COUNT(*) AS c, SUM(CAST(ties AS DOUBLE) * ties - 1) AS tt
          FROM ({sql_ranked(source, keys, value)}) GROUP BY {keys}, {group}) GROUP BY {keys}))"""


def sql_wilcox(source: str, keys: str, value: str, group: str, pairs: str,
               alternative: str = "two.sided", exact: bool = False) -> str:
    """SELECT text for Mann-Whitney tests; ``pairs`` is a SELECT of group1, group2.

    With ``exact`` the statement needs the CTE ``nulls(nm, nk, nu, cdf)``.
    """
    c = {"two.sided": "0.5 * sign(u - m * k / 2)", "less": "-0.5", "greater": "0.5"}[alternative]
    z = f"(u - m * k / 2 - ({c})) / sigma"
    normal = {"two.sided": f"least(1, 2 * {sql_tail('abs(z)')})", "less": sql_tail("-z"),
              "greater": sql_tail("z")}[alternative]
    at = {"two.sided": "least(u, m * k - u)", "less": "u", "greater": "m * k - u"}[alternative]
    sided = "least(1, 2 * cdf)" if alternative == "two.sided" else "cdf"
    approx = f"CASE WHEN sigma > 0 THEN {normal} END"
    core = f"""SELECT *, CASE WHEN sigma > 0 THEN {z} END AS z FROM (
      SELECT {keys}, group1, group2, m, k, tie, r - m * (m + 1) / 2 AS u,
        sqrt(m * k / 12 * (m + k + 1 - tie / ((m + k) * (m + k - 1)))) AS sigma FROM (
        SELECT {keys}, group1, group2, CAST(COUNT(*) FILTER (first) AS DOUBLE) AS m, CAST(COUNT(*) FILTER (NOT first) AS DOUBLE) AS k,
          SUM(rk) FILTER (first) AS r, SUM(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM (
          {sql_ranked(f'(SELECT s.*, group1, group2, {group} = group1 AS first FROM {source} s JOIN ({pairs}) pp ON {group} = group1 OR {group} = group2 WHERE {value} IS NOT NULL)', f'{keys}, group1, group2', value)})
        GROUP BY {keys}, group1, group2) WHERE m > 0 AND k > 0)"""
    columns = f"{keys}, group1, group2, CAST(m AS BIGINT) AS n1, CAST(k AS BIGINT) AS n2, u AS statistic"
    if not exact:
        return f"SELECT {columns}, {approx} AS p, 'normal' AS method FROM ({core})"
    small = "(m < 50 AND k < 50 AND tie = 0)"
    return f"""SELECT {columns}, CASE WHEN {small} THEN {sided} ELSE {approx} END AS p,
      CASE WHEN {small} THEN 'exact' ELSE 'normal' END AS method
      FROM ({core}) LEFT JOIN nulls ON {small} AND nm = m AND nk = k AND nu = {at}"""


def sql_nulls(sizes: str) -> str:
    """Recursive CTE text ``ways``/``nulls``: exact null distribution of U.

    ``sizes`` is a SELECT of the (m, k) that occur. Counts subsets of the ranks
    1..m+k by size and sum.
    """
    return f"""ways AS (
        SELECT 0 AS i, 0 AS c, 0 AS s, 1e0 AS w
        UNION ALL
        SELECT i + 1, c + d, s + d * (i + 1), SUM(w) FROM ways, (VALUES (0), (1)) t(d)
        WHERE i < (SELECT MAX(m + k) FROM ({sizes})) AND c + d <= (SELECT MAX(m) FROM ({sizes})) GROUP BY 1, 2, 3),
      nulls AS (SELECT m AS nm, k AS nk, u AS nu, SUM(w) OVER (PARTITION BY m, k ORDER BY u) / SUM(w) OVER (PARTITION BY m, k) AS cdf FROM (
        SELECT m, k, s - m * (m + 1) / 2 AS u, w FROM (SELECT DISTINCT m, k FROM ({sizes})) z JOIN ways ON i = m + k AND c = m))"""


def sql_euclid(cells: str) -> str:
    """SELECT text for the distances of all pairs; ``cells`` has slice, sample, feature, value."""
    return f"""SELECT x.slice, x.sample AS a, y.sample AS b, sqrt(greatest(0, x.n + y.n - 2 * coalesce(dot, 0))) AS d
      FROM (SELECT slice, sample, SUM(value * value) AS n FROM {cells} GROUP BY 1, 2) x JOIN (SELECT slice, sample, SUM(value * value) AS n FROM {cells} GROUP BY 1, 2) y
        ON x.slice = y.slice AND x.sample < y.sample
      LEFT JOIN (SELECT p.slice, p.sample AS a, q.sample AS b, SUM(p.value * q.value) AS dot FROM {cells} p JOIN {cells} q ON p.slice = q.slice AND p.feature = q.feature AND p.sample < q.sample
        GROUP BY 1, 2, 3) m ON m.slice = x.slice AND m.a = x.sample AND m.b = y.sample"""


def sql_linkage(pairs: str) -> str:
    """Recursive CTE text ``tree``: complete linkage of ``pairs`` (slice, a, b, d), compared by distance, then names.

    One merge of every slice per step; rows with ``step`` > 0 name it: l, r, h.
    """
    return f"""ways AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY slice ORDER BY d, a, b) AS k FROM {pairs}),
      both_ways AS MATERIALIZED (SELECT slice, a, b, d, k FROM ways UNION ALL SELECT slice, b, a, d, k FROM ways),
      tree AS (SELECT 0 AS step, slice, name, name AS cl, name AS l, name AS r, CAST(NULL AS DOUBLE) AS h FROM (SELECT DISTINCT slice, a AS name FROM both_ways)
        UNION ALL SELECT t.step + 1, t.slice, t.name, CASE WHEN t.cl = m.r THEN m.l ELSE t.cl END, m.l, m.r, m.h FROM tree t JOIN (
          SELECT slice, arg_min(lo, k) AS l, arg_min(hi, k) AS r, arg_min(h, k) AS h FROM (
            SELECT x.slice, x.cl AS lo, y.cl AS hi, MAX(w.k) AS k, MAX(w.d) AS h FROM tree x JOIN both_ways w ON w.slice = x.slice AND w.a = x.name
              JOIN tree y ON y.slice = w.slice AND y.name = w.b WHERE x.cl < y.cl GROUP BY 1, 2, 3) GROUP BY 1) m ON m.slice = t.slice)"""


def rounded(df: DataFrame, places: int = 6, **more: int) -> DataFrame:
    """Round the double columns, as the SQL does; other columns stay."""
    from pyspark.sql.types import DoubleType
    return df.select(*[
        (F.round(f.name, more.get(f.name, places)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])
