"""Sparse and dense indices as tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import search_terms

K1, B = 1.5, 0.75


def index_text(sep: str = " ") -> F.Column:
    """What is indexed of a chunk: its contextual prefix, if any, before its content."""
    prefix = F.col("contextual_prefix")
    return F.when(prefix.isNotNull() & (prefix != ""), F.concat(prefix, F.lit(sep), F.col("content"))).otherwise(F.col("content"))


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """chunk_id, term, tf; partial counts are merged before the shuffle."""
    return chunks.select("chunk_id", F.explode(search_terms(F.col(text))).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(chunks: DataFrame, text: str = "content") -> DataFrame:
    """chunk_id and its number of terms; chunks without terms count too."""
    return chunks.select("chunk_id", F.size(search_terms(F.col(text))).cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(post: DataFrame, corpus: DataFrame, floor: float = 0.25) -> DataFrame:
    """term, df, idf: ln(N - df + 0.5) - ln(df + 0.5), negative ones replaced by ``floor`` times the mean of all."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(floor) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def normalised(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit vectors in double; vectors without length become zeros."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    once = lambda value, f: F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)  # noqa: E731 - bound to a variable, it is evaluated once
    unit = lambda v: once(length(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return vectors.withColumn(col, once(F.transform(col, lambda x: x.cast("double")), unit))


def embed(df: DataFrame, client: Callable[[list[str]], np.ndarray], text: str = "content", key: str = "chunk_id", cached: DataFrame | None = None) -> DataFrame:
    """key, embedding: equal texts are embedded once, cached ones (sha, embedding) not at all."""
    rows = df.select(key, text, F.sha2(F.col(text), 256).alias("sha"))
    asked = rows.select("sha", text).dropDuplicates(["sha"])
    if cached is not None:
        asked = asked.join(cached, "sha", "left_anti")

    def task(batches):
        for batch in batches:
            vectors = np.asarray(client(batch.column(1).to_pylist()), dtype=np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["sha", "embedding"])

    known = asked.mapInArrow(task, "sha string, embedding array<float>")
    if cached is not None:
        known = known.unionByName(cached.select("sha", "embedding"))
    return rows.join(known, "sha").select(key, "embedding")
