"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again. The first four return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import divergence_rules, gray_simhash, packing, pu_toxicity, suffix_dedup
from quadrat.storage import settle

#: Score from which a document is rejected as toxic.
TOXIC_FROM = 0.7


#: Bytes of a batch sent to Python: each task holds one in the executor, one in the worker, next to a full heap.
BATCH_BYTES = 8 << 20

#: One column with a document's own columns, whatever their names.
ROW = "_row"


def with_row(docs: DataFrame, *without: str) -> DataFrame:
    """What the operators read, and the whole row next to it."""
    own = [F.col(c) for c in docs.columns if c not in without]
    return docs.select("doc_id", "text", "lang", F.struct(*own).alias(ROW))


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python hold ``BATCH_BYTES``, as rows here are whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near enough to their language."""
    return divergence_rules.judge(with_row(docs), ROW).where("kept").select(f"{ROW}.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit by a model of the labelled learning rows among them."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    scored = pu_toxicity.score(with_row(docs), pu_toxicity.fit(docs, labels, learn), ROW)
    return scored.where(F.col("score") < TOXIC_FROM).select(f"{ROW}.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: three-word shingles, at most two bits apart."""
    small_batches(spark)
    return gray_simhash.one_of_each_group(docs, shingle_words=3, distance=2)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one has, too; n_chars follows the text."""
    small_batches(spark)
    cut = suffix_dedup.remove_repeats(with_row(docs, "text"), ROW)
    new = {"text": F.col("rest_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("rest_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"{ROW}.{c}")).alias(c) for c in docs.columns])


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("best_fit_packing", best_fit),
]

#: Fingerprints, training and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
