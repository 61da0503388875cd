"""Token counts by an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the distinct lengths then answer, for every length met as
a context limit, how many documents and tokens lie at or above it, what truncation to it keeps, and every quantile.
Any other limit follows exactly from the next lower row of the table, as tokens_kept + docs_over * (limit - length), or
below the shortest length as docs * limit; ``at_limits`` answers it from the histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.bpe import encoded_lengths
from heronry.llm.common import stored

#: Distinct lengths of one block of the two-level suffix sums: no task sorts more rows than that.
BLOCK = 4096


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Documents by exact length; the shuffle moves one row for each length and task."""
    return lengths.groupBy(F.col(length_col).alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_limit_table(histogram: DataFrame) -> DataFrame:
    """One row for each distinct length as a context limit.

    n_docs: documents of just that length. docs_within, docs_over: at most and more than it. total_tokens: of all
    documents. tokens_kept: after truncation to the limit. tokens_lost: cut off by it. quantile: the share of
    documents at most that long, so the q-quantile is the least limit with quantile >= q. An empty table gives no
    rows; null and empty texts count with length 0.
    """
    rows = histogram.select("context_limit", "n_docs", (F.col("context_limit") * F.col("n_docs")).alias("tokens"), F.floor(F.col("context_limit") / BLOCK).alias("block"))
    # Two levels: sums within blocks of lengths, and sums over the few rows of whole blocks.
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_later"), F.sum("d").over(Window.partitionBy()).alias("docs"), F.sum("t").over(Window.partitionBy()).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("n_docs").over(inside).alias("d_from"), F.sum("tokens").over(inside).alias("t_from")).join(blocks, "block")
    over = F.col("d_from") - F.col("n_docs") + F.col("d_later")
    tokens_over = F.col("t_from") - F.col("tokens") + F.col("t_later")
    kept = F.col("total_tokens") - tokens_over + over * F.col("context_limit")
    return rows.select(
        "context_limit",
        "n_docs",
        (F.col("docs") - over).alias("docs_within"),
        over.alias("docs_over"),
        "total_tokens",
        kept.alias("tokens_kept"),
        (F.col("total_tokens") - kept).alias("tokens_lost"),
        ((F.col("docs") - over) / F.col("docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_within, docs_over, tokens_kept, tokens_lost for any limits, whether such a length occurs or not."""
    asked = histogram.sparkSession.createDataFrame([(n,) for n in sorted(set(limits))], "limit long")
    length, n, limit = F.col("context_limit"), F.col("n_docs"), F.col("limit")
    kept, within = F.least(length, limit) * n, F.when(length <= limit, n).otherwise(0)
    rows = histogram.crossJoin(F.broadcast(asked)).groupBy("limit")
    found = rows.agg(F.sum(within).alias("docs_within"), F.sum(n - within).alias("docs_over"), F.sum(kept).alias("tokens_kept"), F.sum(length * n - kept).alias("tokens_lost"))
    return found.withColumnRenamed("limit", "context_limit")


def at_quantiles(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """quantile, context_limit: the least length that the share of documents at most that long reaches."""
    asked = histogram.sparkSession.createDataFrame([(float(q),) for q in sorted(set(quantiles))], "q double")
    rows = context_limit_table(histogram).crossJoin(F.broadcast(asked)).where(F.col("quantile") >= F.col("q"))
    return rows.groupBy(F.col("q").alias("quantile")).agg(F.min("context_limit").alias("context_limit"))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``context_limit_table`` of whole texts encoded with the vocabulary at ``path``.

    The histogram is stored, as the table of limits reads it twice: each text is encoded once.
    """
    return context_limit_table(stored(length_histogram(encoded_lengths(df, path, id_col, text_col)), "lengths"))
