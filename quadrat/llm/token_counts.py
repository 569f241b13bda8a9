"""Token counts for every context limit from the exact histogram of document lengths.

Method. Documents are aggregated by encoded length, with map-side combine; all
answers then come from the histogram. Sums from the longest length down are
built in two steps, within blocks of lengths and over the blocks, so that no
task sorts all lengths: the totals above a limit, the quantiles and the tokens
left when every document is cut at the limit are differences of them.

Rows. A null text counts as an empty document of length 0. Repeated rows
count each. An empty table gives an empty histogram. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm import bpe
from quadrat.storage import settle

#: Lengths per block.
BLOCK = 1_024


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens, n_docs: the number of documents of every occurring length."""
    return bpe.lengths(docs, path, pattern).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def by_limit(hist: DataFrame) -> DataFrame:
    """One row per occurring length, taken as the context limit.

    limit, n_docs (of exactly this length), docs_over, tokens_over (of longer
    documents), docs_within, tokens_within (of documents that fit), truncated_total
    (all tokens when longer documents are cut at the limit), fitting_share
    (of documents: the limit is the quantile of this share).
    """
    hist = settle(hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                              F.floor(F.col("n_tokens") / BLOCK).alias("block")), "lengths")
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d_over"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t_over"),
        F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    part = hist.select("block", "n_tokens", "n_docs",
                       F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d_in"),
                       F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t_in"))
    docs_over, tokens_over = F.col("d_over") + F.col("d_in"), F.col("t_over") + F.col("t_in")
    return part.join(blocks, "block").select(
        F.col("n_tokens").alias("limit"), "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("d_all") - docs_over).alias("docs_within"), (F.col("t_all") - tokens_over).alias("tokens_within"),
        (F.col("t_all") - tokens_over + docs_over * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("d_all") - docs_over) / F.col("d_all")).alias("fitting_share"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """share, limit: the smallest length that at least this share of the documents fits in."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return limits.select("limit", "fitting_share", asked).where("fitting_share >= share").groupBy("share").agg(
        F.min("limit").alias("limit"))
