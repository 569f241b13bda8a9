"""Delimited text in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quadrat.operators.normalize import wide_to_long


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema=None, sep: str = ",",
                   header: bool = True) -> DataFrame:
    """Delimited text. Without a schema the types are inferred, which costs a second read."""
    reader = spark.read.options(sep=sep, header=header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_after_preamble(spark: SparkSession, path: str | Sequence[str], skip: int, schema=None,
                        sep: str = ",") -> DataFrame:
    """Delimited text whose header follows ``skip`` lines, in every file of ``path``.

    Row ids grow by one along a file block, so the distance to the first id of a
    file's first block is the line number; only one row per file is aggregated
    and no file is sorted. Without a schema all columns are strings named by the header.
    """
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"))
    firsts = lines.groupBy("_file").agg(
        F.min(F.when(F.col("_start") == 0, F.col("_id"))).alias("_first"))
    lines = lines.join(firsts, "_file").withColumn(
        "_line", F.when(F.col("_start") == 0, F.col("_id") - F.col("_first")))
    if schema is None:
        names = lines.filter(F.col("_line") == skip).select("value").head()[0].split(sep)
        schema = StructType([StructField(n.strip().strip('"'), StringType()) for n in names])
    if isinstance(schema, StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    body = lines.filter(F.col("_line").isNull() | (F.col("_line") > skip)).filter(F.col("value") != "")
    return body.select(F.from_csv("value", schema, {"sep": sep}).alias("_row")).select("_row.*")


def read_clusters(spark: SparkSession, paths: Sequence[str],
                  suffix: str = "_representative_genomes.tsv") -> DataFrame:
    """Cluster definitions of several databases in one read.

    The files have no header. The database is the file (or folder) name before
    ``suffix``; ``./<database>/`` and ``.fa`` are taken off the genome names.
    """
    rows = (spark.read.schema("representative string, member string").option("sep", "\t")
            .csv(list(paths)).withColumn("_file", F.col("_metadata.file_path")))
    pattern = "([^/]+)" + suffix.replace(".", r"\.")
    rows = rows.withColumn("database", F.regexp_extract("_file", pattern, 1)).drop("_file")
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\./[^/]+/", ""), r"\.fa$", "")
    return rows.withColumns({"representative": clean(F.col("representative")),
                             "member": clean(F.col("member"))})


def read_abundance_matrix(spark: SparkSession, path: str, sample: str = "Sample",
                          drop_zeros: bool = True) -> DataFrame:
    """Wide sample-by-feature CSV to long ``sample, feature, value``."""
    header = spark.read.option("header", True).csv(path)
    schema = StructType([StructField(c, StringType() if c == sample else _double())
                         for c in header.columns])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide_to_long(wide.withColumnRenamed(sample, "sample"), drop_zeros=drop_zeros)


def _double():
    from pyspark.sql.types import DoubleType
    return DoubleType()


def write_table(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Result table as delimited text, one file per task."""
    df.write.options(sep=sep, header=header).csv(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Cluster definition: representative and member, tab-separated, no header."""
    write_table(clusters.select("representative", "member"), path, sep="\t", header=False)


def write_representatives(sequences: DataFrame, representatives: DataFrame, path: str,
                          shelves: int | None = None) -> None:
    """Sequences of the representatives only, one folder per genome.

    With many genomes give a number of ``shelves``: genomes are then spread over that
    many folders by hash, and ``genome`` stays a column.
    """
    kept = sequences.join(representatives, "genome", "left_semi")
    if shelves is None:
        kept.repartition("genome").write.partitionBy("genome").parquet(path)
    else:
        shelf = F.pmod(F.xxhash64("genome"), F.lit(shelves)).cast("int")
        kept.withColumn("shelf", shelf).repartition("shelf").write.partitionBy("shelf").parquet(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """The tables behind the figures, one Parquet folder each."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
