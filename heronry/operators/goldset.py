"""Gold questions: sampling, anchoring, filtering, validation and review."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import contains_folded, parse_review_flag, snippet
from heronry.operators.stats import cohen_kappa

#: Questions of each type, and distractors.
TARGETS = {"lore": 25, "mechanical": 25, "tabular": 20, "cross_reference": 15, "monster": 10, "numeric": 5}
DISTRACTORS, DISTRACTOR_ANSWER = 10, "NOT_IN_CORPUS"
WINDOW, SECTION = 300, 3500


def stratified(candidates: DataFrame, order: Column, targets: dict[str, int] = TARGETS) -> DataFrame:
    """The first rows of each query type, up to its target."""
    rank = F.row_number().over(Window.partitionBy("query_type").orderBy(order))
    wanted = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return candidates.withColumn("n", rank).where(F.col("n") <= F.coalesce(F.try_element_at(wanted, F.col("query_type")), F.lit(0)))


#: Consecutive words by which texts are found that may hold an anchor.
KEY_WORDS = 3


def _keys(words: Column) -> Column:
    """Hashes of all runs of KEY_WORDS words. ``words`` is bound to a variable first, so it is evaluated once."""

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - KEY_WORDS + 1, F.lit(1)))
        return F.transform(places, lambda i: F.xxhash64(*[F.try_element_at(w, i + n) for n in range(KEY_WORDS)]))

    long = lambda w: F.when(F.size(w) >= KEY_WORDS, runs(w)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.flatten(F.transform(F.array(words), long)))


def locate_anchor(candidates: DataFrame, docs: DataFrame, anchor: str = "anchor", answer: str = "answer", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Where an anchor of ten characters or more first occurs, and the window around it, if it holds the answer.

    The earliest document, by id, counts. Anchors not found as they stand are looked for with any white space between
    their words, by their first 60 characters.

    Whole words in a row, those behind the first word of an anchor, are the key of an equi-join with the runs of words of
    all texts; only the few pairs that share one are compared. Anchors with too few words in their first 60 characters
    for a key are compared with every text.
    """
    bare = F.trim(F.col(anchor))
    asked = candidates.where(F.length(bare) >= 10).withColumn("_a", bare)
    loose = F.concat(F.lit(r"(?s)\Q"), F.regexp_replace(F.substring("_a", 1, 60), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    asked = asked.withColumn("_loose", loose).withColumn("_words", F.split(F.substring("_a", 1, 60), r"\s+"))
    whole = F.slice("_words", 2, F.greatest(F.size("_words") - 2, F.lit(0)))  # the first and the last may be cut
    asked = asked.withColumn("_key", F.try_element_at(_keys(whole), F.lit(1)))
    runs = docs.select("doc_id", F.explode(_keys(F.split(F.col(text), r"\s+"))).alias("_key"))
    pairs = runs.join(asked.where("_key is not null").select("query_id", "_key"), "_key").select("query_id", "doc_id").distinct()
    texts = docs.select("doc_id", text)
    near = pairs.join(asked, "query_id").join(texts, "doc_id")
    short = asked.where("_key is null")
    rows = near.unionByName(texts.join(short, F.lit(True)).select(near.columns))
    at = F.expr(f"locate(_a, {text})")
    rows = rows.withColumn("_at", F.when(at > 0, at).otherwise(F.expr(f"regexp_instr({text}, _loose)")) - 1).where("_at >= 0")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    begin, end = F.greatest(F.lit(0), F.col("_at") - window), F.least(F.length(text), F.col("_at") + F.length("_a") + window)
    rows = rows.withColumn("char_start", begin.cast("long")).withColumn("char_end", end.cast("long"))
    inside = F.substring(F.col(text), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return rows.where(contains_folded(inside, F.col(answer))).select("query_id", "doc_id", "char_start", "char_end")


def sample_sections(docs: DataFrame, seed: int = 42, tabular: bool = False, size: int = SECTION, text: str = "text") -> DataFrame:
    """One section of each document at a hashed offset; short documents whole. For tabular questions, the first of
    eight offsets whose section has three lines with two pipes or more, else the last."""
    tries = 8 if tabular else 1
    room = F.greatest(F.lit(0), F.length(text) - size)
    offset = lambda t: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), t.cast("string"))), 1, 8), 16, 10).cast("bigint"), room + 1)
    rows = docs.select("doc_id", text, F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("attempt"))
    rows = rows.withColumn("section_start", offset(F.col("attempt"))).withColumn("section", F.substring(F.col(text), (F.col("section_start") + 1).cast("int"), F.lit(size)))
    piped = F.size(F.filter(F.split("section", "\n"), lambda x: F.size(F.split(x, r"\|")) > 2)) >= 3
    order = Window.partitionBy("doc_id").orderBy(F.when(piped, F.col("attempt")).otherwise(F.col("attempt") + tries if not tabular else F.lit(2 * tries) - F.col("attempt") + tries))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "attempt", "section_start", "section")


def _unit(rows) -> np.ndarray:
    v = np.array(rows, float).reshape(len(rows), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def _near(vectors: np.ndarray, seen: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors are closer than ``threshold`` to one of ``seen``, by blocks of these."""
    near = np.zeros(len(vectors), bool)
    for at in range(0, len(seen), 1024):
        far = np.flatnonzero(~near)
        near[far] = (vectors[far] @ seen[at : at + 1024].T).max(axis=1, initial=-np.inf) > threshold
    return near


def _greedy(vectors: np.ndarray, threshold: float, block: int = 256) -> np.ndarray:
    """Which vectors, in their order, are not closer than ``threshold`` to a kept one before them."""
    kept = np.zeros(len(vectors), bool)
    for at in range(0, len(vectors), block):
        part = vectors[at : at + block]
        gone = _near(part, vectors[:at][kept[:at]], threshold)
        close = part @ part.T > threshold
        for i in range(len(part)):
            if not gone[i]:
                kept[at + i] = True
                gone |= close[i]
    return kept


def _saved(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """A table written to the shared folder and reread, and its path; what the round ``before`` wrote is deleted."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:  # on one machine
        folder = "file://" + tempfile.mkdtemp(prefix="heronry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/heronry-dedup-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if before:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path), path


def drop_near_duplicates(candidates: DataFrame, existing: DataFrame | None = None, threshold: float = 0.92, head: int = 8192) -> DataFrame:
    """Greedy, in candidate order (seq, then query_id) within a query type: a question closer than ``threshold`` to an
    existing or kept one goes.

    Each round decides the first ``head`` undecided rows of all types on the driver and broadcasts the kept ones;
    tasks compare them with the other undecided rows in batches, however a type's rows are spread. So there are as
    many rounds as ``head`` goes into what no earlier round dropped, and all kept pairs of a type are compared.
    """
    spark = candidates.sparkSession
    kind = candidates.schema["query_id"].dataType.simpleString()
    schema = f"rid long, query_id {kind}, query_type string, seq long, embedding array<double>, kept boolean"
    rows, path = _saved(candidates.select(F.monotonically_increasing_id().alias("rid"), "query_id", "query_type", F.col("seq").cast("long").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(False).alias("kept")))

    def sift(rows: DataFrame, path: str, seen: dict, decided: dict[int, bool]) -> tuple[DataFrame, str]:
        """Marks the kept rows of a head, drops its other rows, and what is near to ``seen`` (by type; key "" for all)."""
        shared = spark.sparkContext.broadcast((seen, decided))

        def task(batches):
            seen, decided = shared.value
            for batch in batches:
                rids, kinds = batch.column("rid").to_pylist(), batch.column("query_type").to_pylist()
                kept = np.array(batch.column("kept").to_pylist(), bool)
                open_ = np.array([r not in decided for r in rids], bool) & ~kept
                kept |= np.array([decided.get(r, False) for r in rids], bool)
                stays = kept | open_
                for name in {k for k, o in zip(kinds, open_) if o}:
                    at = np.flatnonzero(open_ & np.array([k == name for k in kinds], bool))
                    vectors = _unit(batch.column("embedding").take(pa.array(at)).to_pylist())
                    for known in (seen.get(("all",)), seen.get((name, 0))):
                        if known is not None and len(known):
                            stays[at] &= ~_near(vectors, known, threshold)
                embedding = pa.array([None if k else v for k, v in zip(kept, batch.column("embedding").to_pylist())], pa.list_(pa.float64()))
                out = pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [embedding, pa.array(kept)], names=["rid", "query_id", "query_type", "seq", "embedding", "kept"])
                yield out.filter(pa.array(stays))

        return _saved(rows.mapInArrow(task, schema), path)

    if existing is not None:
        old = _unit([r["embedding"] for r in existing.select("embedding").collect()])
        rows, path = sift(rows, path, {("all",): old}, {})
    while True:
        first = rows.where("not kept").orderBy("seq", "query_id", "rid").limit(head).select("rid", "query_type", "embedding").toArrow()  # ``head`` rows at most
        if not first.num_rows:
            return rows.select("query_id", "query_type", "seq")
        rids, kinds = first.column("rid").to_numpy(), first.column("query_type").to_pylist()
        seen, decided = {}, {}
        for name in set(kinds):
            at = np.array([i for i, k in enumerate(kinds) if k == name])
            vectors = _unit(first.column("embedding").take(pa.array(at)).to_pylist())
            kept = _greedy(vectors, threshold)
            seen[(name, 0)] = vectors[kept]
            decided |= dict(zip(rids[at].tolist(), kept.tolist()))
        rows, path = sift(rows, path, seen, decided)


def answerable_elsewhere(candidates: DataFrame, score: str = "answerability", threshold: float = 0.7) -> DataFrame:
    """Keeps what a model without the corpus could not answer; unreadable scores keep the question."""
    return candidates.where(F.col(score).isNull() | (F.col(score) < threshold))


def distractors(candidates: DataFrame, order: Column, n: int = DISTRACTORS) -> DataFrame:
    """``n`` questions whose answer is not in the corpus."""
    rows = candidates.orderBy(order).limit(n)
    return rows.withColumn("query_type", F.lit("distractor")).withColumn("answer", F.lit(DISTRACTOR_ANSWER))


def content_hash(rows: DataFrame, line: Column, order: str) -> DataFrame:
    """The first 16 digits of SHA-256 over the ordered lines of a gold set (a small table)."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("content_hash"), F.count(F.lit(1)).alias("total"))


def type_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


def validate(gold: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """query_id, issue: a row for each rule broken. ``gold`` has doc_id, char_start and char_end (null without context)."""
    known = F.col("query_type").isin(*TARGETS, "distractor")
    rules = [
        (F.coalesce(F.trim("query"), F.lit("")) == "", "empty_query"),
        (F.coalesce(F.trim("answer"), F.lit("")) == "", "empty_answer"),
        (~F.coalesce(known, F.lit(False)), "unknown_type"),
        ((F.col("query_type") != "distractor") & F.col("char_start").isNull(), "missing_context"),
        (F.coalesce(F.col("validator"), F.lit("auto")) == "auto", "unreviewed"),
    ]
    found = [gold.where(rule).select("query_id", F.lit(name).alias("issue")) for rule, name in rules]
    if docs is not None:
        spans = gold.where("char_start > 0").join(docs.select("doc_id", "text"), "doc_id")
        inside = F.substring(F.col("text"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
        found.append(spans.where(~contains_folded(inside, F.col("answer"))).select("query_id", F.lit("answer_not_in_span").alias("issue")))
    return reduce(DataFrame.unionByName, found)


def review_sheet(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Questions with a snippet of their first context, for two reviewers."""
    rows = gold.join(docs.select("doc_id", "text"), "doc_id", "left")
    context = snippet(F.substring(F.col("text"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")))
    return rows.select("query_id", "query_type", "query", "answer", F.coalesce(context, F.lit("")).alias("context"), F.lit("").alias("approve_a"), F.lit("").alias("approve_b"))


def ingest_reviews(gold: DataFrame, reviews: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(kept questions, agreement). With a kappa below ``least`` nothing is frozen and no question is kept.

    Distractors stay; of the others those that both reviewers approve, marked as reviewed.
    """
    flags = reviews.select("query_id", parse_review_flag(F.col("approve_a")).alias("a"), parse_review_flag(F.col("approve_b")).alias("b")).where("a is not null and b is not null")
    agreement = cohen_kappa(flags).withColumn("frozen", F.col("kappa") >= least)
    both = flags.where("a = 1 and b = 1").select("query_id", F.lit("human").alias("_v"))
    rows = gold.join(both, "query_id", "left").where("_v is not null or query_type = 'distractor'")
    rows = rows.withColumn("validator", F.coalesce("_v", "validator")).drop("_v")
    return rows.join(F.broadcast(agreement.where("frozen").select("frozen"))).drop("frozen"), agreement
