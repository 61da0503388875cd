"""A corpus pipeline of five stages; each takes the documents that the one before it kept.

Language ID rejects texts without a clear language; the quality classifier rejects texts of low quality; the n-gram
Jaccard join keeps one document of each group of near copies; secret scans redact what they find; best-fit packing
places the tokens of every document left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heronry.llm import bpe, jaccard_join, language_id, packing, quality, secret_scan
from heronry.llm.common import drop, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language with a score of 0.5 or more. Null, empty and letterless texts go; rows
    that repeat an id or a text are judged each; texts of any length are read whole."""
    docs = docs.select(*COLUMNS)
    return language_id.accepted(docs, language_id.train(docs))


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores as good; it learns from ``labels``, and keeps all without any label.
    Repeated rows are judged each."""
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked texts, that of the smallest id; rows that only share an id, or have
    none, stay."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row, with ``[secret]`` in place of each secret found; null and empty texts stay as they are."""
    return secret_scan.redacted(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document's tokens, with its sequence and place; null texts count as empty."""
    return packing.pack(docs, bpe.vocabulary_path(), memo=300_000)  # beside what the other stages hold


STAGES = [("language ID", languages), ("quality classifier", good_texts), ("n-gram Jaccard join", one_copy), ("secret scans", without_secrets), ("best-fit packing", packed)]

#: SQL cannot express the trained stages, the tokenisation or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and reread.

    Columns beyond those of ``documents`` are not carried. An empty table gives no rows. A stage's result is deleted
    once the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return docs
