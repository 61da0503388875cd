"""Bounded samples of labelled rows, the only thing that models here are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import hash_cut, new_name, row_hash


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The rows whose key has one of the ``bound`` smallest hashes; all rows if there are no more.

    The cut is found on histograms of the keys' hashes, and the sample is a filter: no row is moved for it. Rows with a
    null key are left out. Where keys repeat, ``bounded`` holds the number of rows as well.
    """
    known = df.where(F.col(key).isNotNull())
    h = F.xxhash64(F.col(key), F.lit(20))
    return bounded(known.where(h <= F.lit(hash_cut(known.select(h.alias("h")).distinct(), bound))), bound)


def bounded(df: DataFrame, bound: int) -> DataFrame:
    """The rows, if there are ``bound`` at most; else as many different ones, those of the smallest hashes."""
    if df.count() <= bound:
        return df
    h = new_name(df, "h")
    hashed = df.withColumn(h, row_hash(df))
    cut = hash_cut(hashed.select(F.col(h).alias("h")).distinct(), bound)
    return hashed.where(F.col(h) <= F.lit(cut)).dropDuplicates([h]).drop(h)


def labelled_texts(df: DataFrame, labels: DataFrame, label: str, training: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as text), text and label of at most ``bound`` labelled rows.

    Labels other than 0 and 1 count as none; a document labelled more than once takes the larger label. The ids are
    bounded by the parameter, so they can be broadcast to the scan of the texts; so are the rows that repeat an id.
    """
    known = labels.where(F.col(label).isin(0, 1) & training & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    known = hash_sample(known, id_col, bound).withColumnRenamed(id_col, "_id")
    texts = df.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select(F.col("_id").cast("string").alias("id"), F.col("_text").alias("text"), F.col("_label").alias("label"))
    return bounded(found, bound)
