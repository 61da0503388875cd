"""Readers and writers, and the inputs that the engine derives from the provided tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.text import search_terms

GOLD_SCHEMA = (
    "id string, query_type string, is_multi_hop boolean, query string, reference_answer string, "
    "reference_contexts array<struct<book: string, chapter_path: array<string>, char_start: long, char_end: long>>, validator string, notes string"
)
CHUNK_SCHEMA = (
    "chunk_id string, strategy string, content string, book_title string, book_index int, chapter_path array<string>, char_start long, char_end long, "
    "token_count int, is_table boolean, contains_table boolean, contains_code boolean, parent_chunk_id string, contextual_prefix string"
)
QUERY_TYPES = ("lore", "mechanical", "tabular", "cross_reference", "monster", "numeric")
STRATEGIES = ("recursive", "markdown_hierarchical", "table_aware", "fixed_size", "adaptive", "contextual")
METHODS = ("dense", "bm25", "hybrid_rrf", "hybrid_rerank", "hyde")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as rows: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions from JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(GOLD_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines, malformed rows dropped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("chunk_id is not null")


def first_by_id(chunks: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each chunk_id in the given order."""
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(order))
    return chunks.withColumn("_n", rank).where("_n = 1").drop("_n")


def write_jsonl(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_results(df: DataFrame, path: str, phase: str) -> None:
    """One phase of the results table; a rerun replaces that phase, so nothing is counted twice."""
    df.withColumn("phase", F.lit(phase)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("phase").parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, in a temporary folder if Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="heronry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/heronry-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and reread, so that it is made once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._heronry_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``saved`` that nothing reads any more."""
    for df in frames:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._heronry_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def index_exists(spark: SparkSession, *paths: str) -> bool:
    """Whether all artefacts of an index are there, so that a build can be skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = (jvm.org.apache.hadoop.fs.Path(p) for p in paths)
    return all(p.getFileSystem(conf).exists(p) for p in found)


def placeholder_gold(spark: SparkSession) -> DataFrame:
    """Two static questions for when there is no corpus."""
    rows = [("q_0001", "lore", False, "What does the corpus describe?", "Nothing yet.", [], "placeholder", ""), ("q_0002", "distractor", False, "What is not in the corpus?", "NOT_IN_CORPUS", [], "placeholder", "")]
    return spark.createDataFrame(rows, GOLD_SCHEMA)


#: Documents, by id, of one block of the two-level prefix sums of lengths.
SECTION_BLOCK = 1 << 16


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown corpus derived from ``documents``: book (the source), doc_id, lang, md and its start in the book.

    A book's sections follow by doc_id, which is unique. Some bodies lie in a fence, some begin with a pipe table.
    Starts are prefix sums of lengths in two levels, blocks of ids and sections in a block; only ids and lengths are
    sorted for them, and texts meet their start by doc_id.
    """
    body = (
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("doc_id") % 5 == 0, F.concat(F.lit("| key | value |\n| --- | --- |\n| lang | "), F.col("lang"), F.lit(" |\n| doc | "), F.col("doc_id").cast("string"), F.lit(" |\n\n"), F.col("text")))
        .otherwise(F.col("text"))
    )
    head = F.concat(F.lit("## Book "), F.col("book"), F.lit("\n\n"))
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#### "), F.col("lang"), F.lit(" notes\n\n"))).otherwise(F.lit(""))
    md = F.concat(F.lit("### doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), note, body, F.lit("\n\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("book"), md.alias("md"))
    sizes = docs.select("doc_id", "book", F.length("md").alias("n"), F.floor(F.col("doc_id") / SECTION_BLOCK).alias("block"))
    whole = sizes.groupBy("book", "block").agg(F.sum("n").alias("total"), F.min("doc_id").alias("least"))
    book = Window.partitionBy("book").orderBy("block")
    blocks = whole.select("book", "block", (F.sum("total").over(book) - F.col("total")).alias("before"), F.min("least").over(Window.partitionBy("book")).alias("first"))
    inside = Window.partitionBy("book", "block").orderBy("doc_id")
    starts = sizes.withColumn("here", F.sum("n").over(inside) - F.col("n")).join(blocks, ["book", "block"])
    is_first = F.col("doc_id") == F.col("first")
    start = F.when(is_first, F.lit(0).cast("long")).otherwise(F.col("before") + F.col("here") + F.length(head))
    starts = starts.select("doc_id", is_first.alias("leads"), start.alias("start"))
    return docs.join(starts, "doc_id").select("doc_id", "lang", "book", F.when(F.col("leads"), F.concat(head, F.col("md"))).otherwise(F.col("md")).alias("md"), "start")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions derived from ``benchmark``: the first eight words as query, the first 60 characters as answer."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), item.cast("string")).alias("query_id"),
        F.element_at(F.array(*map(F.lit, QUERY_TYPES)), (item % 6 + 1).cast("int")).alias("query_type"),
        F.slice(search_terms(F.col("text")), 1, 8).alias("terms"),
        F.substring("text", 1, 60).alias("answer"),
        F.col("text").alias("passage"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table derived from ``events``: strategy, method, k, trial, query and its metrics."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    e, v = F.col("event_id"), F.floor(F.col("value"))
    return table(spark, sf_dir, "events").select(
        pick(STRATEGIES, F.col("user_id") % 6).alias("strategy"),
        pick(METHODS, e % 5).alias("method"),
        F.element_at(F.array(*map(F.lit, (1, 3, 5, 10, 20))), (F.floor(e / 5) % 5 + 1).cast("int")).alias("k"),
        (e % 3 + 1).cast("int").alias("trial"),
        F.concat(F.lit("q"), (e % 110).cast("string")).alias("query_id"),
        pick((*QUERY_TYPES, "distractor"), e % 7).alias("query_type"),
        (v % 2).cast("double").alias("recall"),
        (1.0 / (v % 4 + 1)).alias("mrr"),
        ((v % 5) / 4.0).alias("ndcg"),
        (v % 3 > 0).cast("double").alias("hit"),
        ((v % 11) / 10.0).alias("faithfulness"),
        F.col("value").alias("latency_ms"),
        "event_id",
    )


def cost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls derived from ``events``."""
    e = F.col("event_id")
    models = ("text-embedding-3-small", "gpt-4o", "gpt-4o-mini", "claude-sonnet-4-5-20241022", "unlisted")
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("event_type").alias("stage"),
        F.element_at(F.array(*map(F.lit, models)), (e % 5 + 1).cast("int")).alias("model"),
        (F.floor("value") * 10).cast("long").alias("input_tokens"),
        F.floor("value").cast("long").alias("output_tokens"),
        (e % 4 == 0).alias("cached"),
    )
