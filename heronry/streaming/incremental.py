"""Incremental indexing: documents that arrive as a stream are chunked and counted by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronry.operators import chunkers, index


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_stream(documents: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Fixed-size chunks of a stream; stateless, so it also runs on a static table."""
    return chunkers.fixed_size(documents.select("doc_id", F.col("source").alias("book"), "text"), size, overlap)


def start_index(documents: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends chunks and postings by batch. Each batch overwrites its own partition, so a replay changes nothing.

    Document frequencies and the average length are sums over batches: ``corpus_of`` adds them up.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_stream(batch).withColumn("batch", F.lit(number))
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/chunks")
        stored = batch.sparkSession.read.parquet(f"{out}/chunks").where(F.col("batch") == number)
        post = index.postings(stored).withColumn("batch", F.lit(number))
        post.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/postings")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def corpus_of(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, chunk lengths, term statistics) over all batches so far."""
    post = spark.read.parquet(f"{out}/postings").drop("batch")
    lengths = index.doc_stats(spark.read.parquet(f"{out}/chunks"))
    return post, lengths, index.term_stats(post, index.corpus_stats(lengths))
