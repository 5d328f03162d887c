"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def length_histogram(docs: DataFrame, length: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row per length that occurs: documents, tokens, and sums over shorter and longer documents.

    ``n_docs`` documents have ``n_tokens`` tokens each. For a context limit of
    ``n_tokens``, ``docs_within`` fit whole and ``docs_beyond`` do not,
    ``tokens_within`` is what the first hold, and ``tokens_truncated`` what
    remains of all documents cut to the limit. ``quantile`` is the share of
    documents that fit. Any other limit gives the row of the next shorter length
    plus the difference times its ``docs_beyond``. Null lengths are left out.

    Suffix sums run within blocks of lengths and over the blocks' totals, so no
    task sees more than one block's lengths or one row per block.
    """
    counts = (
        docs.where(F.col(length).isNotNull())
        .groupBy(F.col(length).cast("bigint").alias("n_tokens"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("_block", F.floor(F.col("n_tokens") / block).cast("bigint"))
    )
    counts = materialise(counts, "lengths")
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = counts.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    above = blocks.select(
        F.col("_block").alias("_b"),
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_above") for c in ("_docs", "_tokens")],
        F.sum("_docs").over(everything).alias("_all_docs"),
        F.sum("_tokens").over(everything).alias("_all_tokens"),
    )
    longer = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(above, F.col("_block") == F.col("_b")).withColumns(
        {
            "docs_beyond": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("_docs_above"),
            "_tokens_beyond": F.coalesce(F.sum(tokens).over(longer), F.lit(0)) + F.col("_tokens_above"),
        }
    )
    within = F.col("_all_docs") - F.col("docs_beyond")
    return joined.select(
        "n_tokens",
        "n_docs",
        within.alias("docs_within"),
        "docs_beyond",
        (F.col("_all_tokens") - F.col("_tokens_beyond")).alias("tokens_within"),
        (F.col("_all_tokens") - F.col("_tokens_beyond") + F.col("docs_beyond") * F.col("n_tokens")).alias(
            "tokens_truncated"
        ),
        (within / F.col("_all_docs")).alias("quantile"),
    )
