"""Registered queries: each takes (spark, sf_dir) and returns the whole result as a DataFrame."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions import text as X
from heronry.functions.relevance import span_overlap
from heronry.operators import chunkers, clients, corpus, cost, goldset, index, metrics, report, retrieval, runner, stats
from heronry.sources import tables as S

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return S.table(spark, d, "documents")


def _chunks(spark, d):
    return chunkers.fixed_size(_docs(spark, d).select("doc_id", F.col("source").alias("book"), "text"))


def _once(spark, d):
    """Each chunk once: copies of a document have the same chunks, and those of the first one count."""
    return S.first_by_id(_chunks(spark, d), "doc_id")


# Corpus


@query
def corpus_lines_offsets(spark, d):
    return corpus.lines(S.sections(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"), "offset")


@query
def corpus_headings(spark, d):
    return corpus.parse(S.sections(spark, d)).where("node_type = 'heading'").select("doc_id", "level", "content", "char_start", "char_end")


@query
def corpus_code_blocks(spark, d):
    return corpus.parse(S.sections(spark, d)).where("node_type = 'code_block'").select("doc_id", "char_start", "char_end", F.md5("content").alias("content_md5"), "info")


@query
def corpus_tables(spark, d):
    return corpus.parse(S.sections(spark, d)).where("node_type = 'table'").select("doc_id", "char_start", "char_end", F.md5("raw_content").alias("raw_md5"))


@query
def corpus_table_structure(spark, d):
    return corpus.parse(S.sections(spark, d)).where("node_type = 'table'").select("doc_id", "char_start", F.array_join("header_row", "~").alias("header"), F.size("body_rows").cast("long").alias("body_rows"), F.col("align_row").isNotNull().alias("aligned"))


@query
def corpus_paragraphs(spark, d):
    return corpus.parse(S.sections(spark, d)).where("node_type = 'paragraph'").select("doc_id", "char_start", "char_end", F.md5("content").alias("content_md5"))


@query
def corpus_profile(spark, d):
    return corpus.profile(corpus.lines(S.sections(spark, d)))


@query
def corpus_header_samples(spark, d):
    return corpus.header_samples(corpus.lines(S.sections(spark, d))).select("book", F.col("level").cast("long").alias("level"), F.col("n").cast("long").alias("n"), "doc_id", "title", "level_total")


def _titles(spark, d, but=()):
    return _docs(spark, d).select("source").distinct().where(~F.col("source").isin(*but) if but else F.lit(True)).select(F.col("source").alias("title"))


def _headings(spark, d):
    """Headings of the whole corpus, books one after another by name."""
    sections = S.sections(spark, d)
    sizes = sections.groupBy("book").agg(F.sum(F.length("md")).alias("n"))  # one row a book
    starts = sizes.select("book", (F.sum("n").over(Window.orderBy("book")) - F.col("n")).alias("book_start"))
    found = corpus.book_headings(corpus.parse(sections), sections).join(F.broadcast(starts), "book")
    return found.select("book", (F.col("pos") + F.col("book_start")).alias("pos"), "level", "content")


@query
def title_normalize(spark, d):
    raw = F.concat(F.lit("  **"), F.col("source"), F.lit("** – “"), F.col("lang"), F.lit("”!  No._"), F.col("doc_id").cast("string"), F.lit("™"))
    return _docs(spark, d).select("doc_id", X.normalize_title(raw).alias("title"))


@query
def book_spans(spark, d):
    return corpus.detect_books(_headings(spark, d), _titles(spark, d)).select("book_title", "book_index", "start_offset", F.coalesce("end_offset", F.lit(-1)).cast("long").alias("end_offset"), "h2_header_text")


@query
def unmatched_headings(spark, d):
    found = _headings(spark, d)
    return corpus.unmatched(found, corpus.detect_books(found, _titles(spark, d, ("src3", "src7")))).select("pos", "content")


@query
def book_for_offset(spark, d):
    found = _headings(spark, d)
    books = corpus.detect_books(found, _titles(spark, d))
    return corpus.book_for_offset(found.where("level = 3").select("pos"), books).select("pos", "book_title", "book_index")


@query
def chapter_path(spark, d):
    sections = S.sections(spark, d)
    points = sections.select("book", (F.col("start") + F.floor(F.length("md") / 2)).alias("pos"), F.col("doc_id").alias("point_id"))
    found = corpus.chapter_paths(corpus.book_headings(corpus.parse(sections), sections), points)
    return found.select("book", F.col("point_id").alias("doc_id"), F.array_join("chapter_path", " > ").alias("path"))


# Scalar functions


@query
def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"))


@query
def token_truncate(spark, d):
    return _docs(spark, d).select("doc_id", X.truncate_to_tokens(F.col("text"), 20).alias("head"))


@query
def bm25_tokens(spark, d):
    terms = X.search_terms(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(terms).cast("long").alias("terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


@query
def sentence_split(spark, d):
    found = X.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(found).cast("long").alias("sentences"), F.md5(F.array_join(found, "|")).alias("sentences_md5"))


@query
def cosine_pairs(spark, d):
    v = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(other, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


# Chunks


@query
def chunk_fixed_size(spark, d):
    return _chunks(spark, d).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "char_start", "char_end", F.col("token_count").cast("long").alias("token_count"), "chunk_id")


@query
def chunk_markdown_hierarchical(spark, d):
    """Sections that are not split again; ``chunk_markdown_split`` has the default limit."""
    return chunkers.hierarchical(S.sections(spark, d), limit=1 << 30).select("doc_id", "char_start", F.md5("content").alias("content_md5"), F.col("token_count").cast("long").alias("token_count"), "contains_table", "contains_code")


@query
def chunk_markdown_split(spark, d):
    return chunkers.hierarchical(S.sections(spark, d)).drop("content")


@query
def chunk_recursive(spark, d):
    return chunkers.recursive(_docs(spark, d)).drop("content")


@query
def chunk_tables_in_context(spark, d):
    sections = S.sections(spark, d)
    return chunkers.table_chunks(corpus.parse(sections), sections).select("doc_id", "char_start", "char_end", F.md5("content").alias("content_md5"))


@query
def chunk_table_aware(spark, d):
    sections = S.sections(spark, d)
    return chunkers.table_aware(corpus.parse(sections), sections).drop("content")


@query
def chunk_adaptive(spark, d):
    return chunkers.adaptive(_docs(spark, d)).select("doc_id", "chunk_no", F.md5("content").alias("content_md5"), "body_tokens")


@query
def chunk_contextual(spark, d):
    chunks = _chunks(spark, d).select("book", "chunk_id", "content")
    return chunkers.contextual(chunks, lambda texts: [f"About: {t[:30]}" for t in texts]).select("chunk_id", "contextual_prefix")


@query
def chunk_flags(spark, d):
    return chunkers.with_metadata(S.sections(spark, d).select("doc_id", F.col("md").alias("content"), F.col("start").alias("char_start")), "section").select("chunk_id", "contains_table", "contains_code")


@query
def chunk_dedup(spark, d):
    repeated = _docs(spark, d).select(F.substring(F.sha1("text"), 1, 16).alias("chunk_id"), F.col("doc_id").alias("seq"))
    return S.first_by_id(repeated)


@query
def chunk_sample(spark, d):
    return _chunks(spark, d).select("chunk_id", F.md5(F.concat(F.lit("42:"), "chunk_id")).alias("h")).orderBy("h", "chunk_id").limit(50)


@query
def chunk_counts(spark, d):
    return _chunks(spark, d).groupBy("book").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


# Index


@query
def index_postings(spark, d):
    return index.postings(_chunks(spark, d)).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tf"), F.max("term").alias("last_term"))


@query
def index_doc_stats(spark, d):
    return index.doc_stats(_chunks(spark, d)).groupBy("chunk_id").agg(F.max("dl").alias("dl"))


@query
def index_term_stats(spark, d):
    chunks = _chunks(spark, d)
    return index.term_stats(index.postings(chunks), index.corpus_stats(index.doc_stats(chunks))).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def index_vectors(spark, d):
    v = index.normalised(S.table(spark, d, "embeddings")).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return v.groupBy("vec_id").agg(F.round(F.sum(F.col("x") * (F.col("i") + 1)), 6).alias("weighted"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("norm"))


# Retrieval


def _vectors(spark, d):
    v = index.normalised(S.table(spark, d, "embeddings")).withColumn("chunk_id", F.lpad(F.col("vec_id").cast("string"), 8, "0"))
    return v


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def _bm25(spark, d, k):
    chunks = _once(spark, d)
    # The index is read several times by one plan; as a table of its own it would be stored instead.
    post, dl = index.postings(chunks).persist(StorageLevel.MEMORY_AND_DISK), index.doc_stats(chunks).persist(StorageLevel.MEMORY_AND_DISK)
    corpus_row = index.corpus_stats(dl)
    return retrieval.bm25(S.gold(spark, d), post, dl, index.term_stats(post, corpus_row), corpus_row, k), chunks


@query
def retrieve_bm25(spark, d):
    return _ranked(_bm25(spark, d, 10)[0])


def _whole_split(spark, d):
    """Every vector whose id is divisible by 20 as a question (nth is its number), and all vectors."""
    v = _vectors(spark, d)
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label", F.floor(F.col("vec_id") / 20).alias("nth")), v


@query
def retrieve_dense_all(spark, d):
    q, v = _whole_split(spark, d)
    return _ranked(retrieval.dense(q.select("query_id", "embedding"), v.select("chunk_id", "embedding"), 10))


@query
def retrieve_metadata_filter_all(spark, d):
    q, v = _whole_split(spark, d)
    q = q.select("query_id", "embedding", (F.col("nth") % 2 == 0).alias("f_is_table"), F.when(F.col("nth") % 3 == 0, F.col("label").cast("string")).alias("f_book"))
    v = v.select("chunk_id", "embedding", (F.col("vec_id") % 4 == 0).alias("is_table"), F.col("label").cast("string").alias("book"))
    return _ranked(retrieval.filtered_dense(q, v, 5))


def _two_whole_lists(spark, d, n=50):
    """Two rankings of the same vectors: by the question's vector and by the next question's."""
    q, v = _whole_split(spark, d)
    other = q.select((F.col("query_id") - 20).alias("query_id"), "embedding").where("query_id >= 0")
    v = v.select("chunk_id", "embedding")
    return retrieval.dense(q.select("query_id", "embedding"), v, n), retrieval.dense(other, v, n)


@query
def fuse_rrf_all(spark, d):
    return _ranked(retrieval.rrf(list(_two_whole_lists(spark, d)), 10))


@query
def retrieve_hybrid_rrf_all(spark, d):
    a, b = _two_whole_lists(spark, d, 60)
    return _ranked(retrieval.hybrid_rrf(lambda n: a.where(F.col("rank") <= n), lambda n: b.where(F.col("rank") <= n), 20))


@query
def retrieve_query_decomposition_all(spark, d):
    q, v = _whole_split(spark, d)
    parts = q.select(F.floor(F.col("nth") / 5).alias("query_id"), (F.col("nth") % 5).cast("int").alias("part_no"), "embedding")
    return _ranked(retrieval.decomposed(parts, v.select("chunk_id", "embedding"), 10))


@query
def retrieve_hybrid_rerank(spark, d):
    hits, chunks = _bm25(spark, d, 10)
    questions = S.gold(spark, d).select("query_id", F.array_join("terms", " ").alias("query"))
    return _ranked(retrieval.rerank(hits, chunks, questions, clients.overlap_reranker, 10))


@query
def retrieve_hyde(spark, d):
    chunks = _once(spark, d)
    embed = lambda c: X.hashed_embedding(X.search_terms(c))
    vectors = S.saved(index.normalised(chunks.select("chunk_id", embed(F.col("content")).alias("embedding"))), "vectors")  # counted and searched
    questions = S.gold(spark, d).select("query_id", F.array_join("terms", " ").alias("query"))
    return _ranked(retrieval.hyde(questions, lambda texts: [f"{t} {t}" for t in texts], embed, vectors, 5))


@query
def parent_map(spark, d):
    chunks = _once(spark, d).withColumn("book", F.col("doc_id").cast("string"))
    return retrieval.parents(chunks).select("chunk_id", F.length("parent").cast("long").alias("n"), F.md5("parent").alias("parent_md5"))


@query
def retrieve_small_to_big(spark, d):
    hits, chunks = _bm25(spark, d, 15)
    chunks = chunks.withColumn("book", F.col("doc_id").cast("string"))
    return retrieval.small_to_big(hits, retrieval.parents(chunks), chunks, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.md5("content").alias("content_md5"))


# Metrics


@query
def span_overlaps(spark, d):
    e = S.table(spark, d, "events").select("event_id", (F.col("event_id") % 97).alias("a"), (F.col("event_id") % 97 + F.col("user_id") % 50).alias("b"), (F.col("event_id") % 89).alias("c"), (F.col("event_id") % 89 + 20).alias("e"))
    return e.select("event_id", F.round(span_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("e")), 6).alias("overlap"))


def _questions(spark, d):
    """Gold questions with contexts where the whole passage occurs."""
    g = S.gold(spark, d)
    at = goldset.locate_anchor(g.withColumnRenamed("passage", "anchor").select("query_id", "anchor", "answer"), _docs(spark, d).select("doc_id", "text"))
    context = F.struct(F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))
    contexts = F.when(F.col("doc_id").isNotNull(), F.array(context)).otherwise(F.array().cast("array<struct<char_start: long, char_end: long>>"))
    return g.join(at, "query_id", "left").select("query_id", "answer", contexts.alias("contexts"), F.when(F.col("doc_id").isNull(), "distractor").otherwise(F.col("query_type")).alias("query_type"))


def _judged(spark, d):
    hits, chunks = _bm25(spark, d, 20)
    return metrics.judged(hits.join(chunks.select("chunk_id", "content"), "chunk_id"), _questions(spark, d).select("query_id", "contexts", "answer"))


@query
def relevance(spark, d):
    return _judged(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "relevant", F.round("gain", 6).alias("gain"))


@query
def metrics_all(spark, d):
    found = metrics.retrieval_metrics(_judged(spark, d), S.gold(spark, d))
    return found.select("query_id", F.col("k").cast("long").alias("k"), *[F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg", "hit")])


@query
def recall_by_type(spark, d):
    """The flagship: fixed-size chunks, BM25, relevance and mean recall by query type."""
    rows = metrics.retrieval_metrics(_judged(spark, d), S.gold(spark, d)).join(_questions(spark, d).select("query_id", "query_type"), "query_id")
    return rows.groupBy("query_type", F.col("k").cast("long").alias("k")).agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("mrr"), 6).alias("mean_mrr"), F.count(F.lit(1)).alias("n"))


@query
def abstention_rate(spark, d):
    c = S.table(spark, d, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.lit("I think not_in_corpus.")).otherwise(F.col("text"))
    return metrics.abstention_rates(c.select(F.col("role").alias("query_type"), answer.alias("answer")))


@query
def judge_score_parse(spark, d):
    c = S.table(spark, d, "conversations")
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Reason. score : 0."), (F.col("conv_id") % 10).cast("string"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("about "), (F.col("conv_id") % 4).cast("string"))).otherwise(F.lit("none"))
    return c.select("conv_id", "turn", F.round(X.parse_score(reply), 6).alias("score"))


@query
def generation_summary(spark, d):
    s = metrics.judge_summary(S.results(spark, d), ["strategy", "method"], "faithfulness")
    return s.select("strategy", "method", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def _table_chunks(spark, d):
    """Chunks of tables, some without their first lines and some without their last ones."""
    rows = S.table(spark, d, "part").select("p_partkey", F.concat(F.lit("| brand | size |\n| --- | --- |\n| "), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |")).alias("t"))
    cut = F.when(F.col("p_partkey") % 5 == 0, F.substring_index("t", "\n", -1)).when(F.col("p_partkey") % 7 == 0, F.substring_index("t", "\n", 1)).otherwise(F.col("t"))
    return rows.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"), cut.alias("content"), F.lit(True).alias("is_table"), F.lit(True).alias("contains_table"))


@query
def table_integrity(spark, d):
    return metrics.table_integrity(_table_chunks(spark, d))


@query
def table_integrity_issues(spark, d):
    return metrics.table_issues(_table_chunks(spark, d))


@query
def citation_validity(spark, d):
    docs = _docs(spark, d)
    chunks = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"))
    answers = docs.select(F.floor(F.col("doc_id") / 10).alias("answer_id"), F.concat(F.lit("c"), (F.col("doc_id") * 2).cast("string")).alias("chunk_id"))
    claims = docs.where("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 20).alias("answer_id"), F.translate(F.substring("text", 1, 12), "aeht", "AEHT").alias("claim"))
    found = metrics.citation_validity(answers, claims, chunks)
    return found.select("answer_id", "total_citations", "valid_ids", F.round("id_validity", 6).alias("id_validity"), F.coalesce("claims_found", F.lit(0)).cast("long").alias("claims_found"), F.round("claim_validity", 6).alias("claim_validity"))


@query
def token_distribution(spark, d):
    return metrics.distribution(_chunks(spark, d).withColumn("tokens", F.col("token_count").cast("double")), "tokens", ["book"])


@query
def latency_stats(spark, d):
    return metrics.distribution(S.table(spark, d, "events"), "value", ["event_type"], 2).select("event_type", "n", "p50", "p95", "mean", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"))


# Statistics


def _scores(spark, d):
    return S.results(spark, d).where("k = 10").select(F.col("method").alias("system"), F.col("event_id").alias("item"), F.col("ndcg").alias("value"))


@query
def bootstrap_ci(spark, d):
    return stats.bootstrap_ci(_scores(spark, d))


@query
def bootstrap_ci_hashed(spark, d):
    return stats.hashed_bootstrap_ci(_scores(spark, d), resamples=100)


def _by_query(spark, d):
    return S.results(spark, d).groupBy(F.col("strategy").alias("system"), F.col("query_id").alias("item")).agg(F.avg("ndcg").alias("value"))


@query
def paired_bootstrap(spark, d):
    return stats.paired_bootstrap(stats.pairs(_by_query(spark, d)))


@query
def pairwise_significance(spark, d):
    return stats.pairwise(_by_query(spark, d))


@query
def holm_bonferroni(spark, d):
    p = S.results(spark, d).groupBy(F.concat_ws("/", "strategy", "method").alias("comparison")).agg((F.round(F.avg("recall"), 6) / 50).alias("p_value"))
    return stats.holm(p).select("comparison", F.round("p_value", 8).alias("p_value"), F.round("threshold", 8).alias("threshold"), "significant")


@query
def judge_variance(spark, d):
    return stats.judge_variance(S.results(spark, d), "trial", "faithfulness", ("method",)).select("method", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "trials")


@query
def cohen_kappa(spark, d):
    return stats.cohen_kappa(S.table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))).select("n", F.round("kappa", 6).alias("kappa"))


# Gold set


@query
def gold_build(spark, d):
    return goldset.stratified(S.gold(spark, d).withColumn("query", F.array_join("terms", " ")), F.md5("query_id")).select("query_id", "query_type", F.col("n").cast("long").alias("n"), "query")


@query
def gold_locate_anchor(spark, d):
    g = S.gold(spark, d).select("query_id", F.col("passage").alias("anchor"), "answer")
    return goldset.locate_anchor(g, _docs(spark, d))


@query
def gold_dedup(spark, d):
    v = S.table(spark, d, "embeddings")
    return goldset.drop_near_duplicates(v.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("query_type"), F.col("vec_id").alias("seq"), "embedding"))


@query
def gold_distractors(spark, d):
    return goldset.distractors(S.gold(spark, d), F.md5("query_id")).select("query_id", "query_type", "answer")


@query
def gold_section_sample(spark, d):
    return goldset.sample_sections(_docs(spark, d)).select("doc_id", F.col("section_start").cast("long").alias("section_start"), F.md5("section").alias("section_md5"))


def _gold_rows(spark, d):
    """Questions with some faults."""
    g = S.gold(spark, d)
    n = F.substring("query_id", 2, 9).cast("int")
    located = goldset.locate_anchor(g.select("query_id", F.col("passage").alias("anchor"), "answer"), _docs(spark, d))
    rows = g.join(located, "query_id", "left")
    return rows.select(
        "query_id",
        F.when(n % 11 == 0, F.lit("riddle")).otherwise(F.col("query_type")).alias("query_type"),
        F.when(n % 9 == 0, F.lit(" ")).otherwise(F.array_join("terms", " ")).alias("query"),
        F.when(n % 10 == 0, F.lit("no such answer")).otherwise(F.col("answer")).alias("answer"),
        F.when(n % 2 == 0, F.lit("human")).otherwise(F.lit("auto")).alias("validator"),
        "doc_id",
        "char_start",
        "char_end",
    )


@query
def gold_validate(spark, d):
    return goldset.validate(_gold_rows(spark, d), _docs(spark, d))


@query
def gold_type_counts(spark, d):
    return goldset.type_counts(S.gold(spark, d))


@query
def gold_content_hash(spark, d):
    return goldset.content_hash(S.gold(spark, d), F.concat_ws("|", "query_id", "query_type", "answer"), "query_id")


@query
def gold_review_sheet(spark, d):
    return goldset.review_sheet(_gold_rows(spark, d), _docs(spark, d)).select("query_id", "query_type", "query", "answer", F.md5("context").alias("context_md5"))


@query
def gold_ingest_reviews(spark, d):
    words = lambda n: F.when(n % 5 == 0, F.lit(" No ")).when(n % 13 == 0, F.lit("later")).otherwise(F.lit("YES"))
    g = _gold_rows(spark, d)
    n = F.substring("query_id", 2, 9).cast("int")
    kept, _ = goldset.ingest_reviews(g, g.select("query_id", words(n).alias("approve_a"), words(n).alias("approve_b")))
    return kept.select("query_id", "query_type", "validator")


# Runs


def _run(spark, d, strategies, methods, phase):
    """Gold questions over the Markdown corpus; their contexts are offsets in its books."""
    sections = S.sections(spark, d)
    g = S.gold(spark, d).withColumn("query", F.array_join("terms", " "))
    at = goldset.locate_anchor(g.select("query_id", F.col("passage").alias("anchor"), "answer"), sections.select("doc_id", "md"), text="md")
    at = at.join(sections.select("doc_id", "start"), "doc_id").select("query_id", F.array(F.struct((F.col("start") + F.col("char_start")).alias("char_start"), (F.col("start") + F.col("char_end")).alias("char_end"))).alias("contexts"))
    none = F.array().cast("array<struct<char_start: long, char_end: long>>")
    questions = g.join(at, "query_id", "left").select("query_id", "query", "terms", "answer", F.coalesce("contexts", none).alias("contexts"), F.when(F.col("contexts").isNull(), "distractor").otherwise(F.col("query_type")).alias("query_type"))
    found = runner.run(sections, questions, strategies, methods, S.shared_path(spark, "results"), phase)
    return found.select("strategy", "method", F.col("k").cast("long").alias("k"), F.col("trial").cast("long").alias("trial"), "query_id", "query_type", *[F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg", "hit", "table_integrity")])


@query
def phase1_results(spark, d):
    """Chunking strategies under dense search."""
    return _run(spark, d, list(runner.CHUNKERS), ["dense"], "phase1")


@query
def phase2_results(spark, d):
    """All retrieval methods over three strategies."""
    return _run(spark, d, ["recursive", "markdown_hierarchical", "table_aware"], list(runner.RETRIEVERS), "phase2")


# Results


@query
def phase1_grid(spark, d):
    return report.grid(spark, list(S.STRATEGIES), ["dense"], [1, 3, 5, 10, 20]).groupBy("strategy", "method").agg(F.count(F.lit(1)).alias("rows"))


@query
def phase2_grid(spark, d):
    return report.grid(spark, list(S.STRATEGIES), list(retrieval.METHODS), list(metrics.K_VALUES)).groupBy("method", "trial").agg(F.count(F.lit(1)).alias("rows"))


@query
def routing_table(spark, d):
    return report.routing(S.results(spark, d)).select("query_type", "strategy", "method", F.round("mean", 6).alias("mean"), "n")


@query
def routing_policy(spark, d):
    return report.routing_policy(S.results(spark, d))


@query
def report_summary(spark, d):
    return report.summary(S.results(spark, d))


@query
def report_pivot_recall(spark, d):
    return report.pivot(S.results(spark, d), "recall", list(S.METHODS), 10)


@query
def report_pivot_ndcg(spark, d):
    return report.pivot(S.results(spark, d), "ndcg", list(S.METHODS), 10)


@query
def report_recall_curves(spark, d):
    return report.means(S.results(spark, d), ["strategy", "method", "k"], "recall").withColumn("k", F.col("k").cast("long"))


@query
def report_mrr(spark, d):
    return report.means(S.results(spark, d), ["strategy", "method"], "mrr")


@query
def report_hit_curves(spark, d):
    return report.means(S.results(spark, d).where("method = 'hybrid_rrf'"), ["strategy", "k"], "hit").withColumn("k", F.col("k").cast("long"))


@query
def report_best_per_type(spark, d):
    return report.best_per_type(S.results(spark, d))


@query
def report_verdict(spark, d):
    return report.verdict(S.results(spark, d))


# Costs


@query
def cost_by_model(spark, d):
    return cost.by(cost.priced(S.cost_events(spark, d)), "model")


@query
def cost_by_stage(spark, d):
    return cost.by(cost.priced(S.cost_events(spark, d)), "stage")


@query
def budget_check(spark, d):
    return cost.over_budget(cost.priced(S.cost_events(spark, d)), {"click": 0.5, "purchase": 100.0})


@query
def cache_hit_rate(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("namespace"), (F.col("event_id") % 50).cast("string").alias("key"))
    cache = e.where("cast(key as int) % 3 = 0").dropDuplicates(["namespace", "key"]).withColumn("value", F.lit("x"))
    return cost.hit_rate(cost.cached_lookup(e, cache))


@query
def run_log_summary(spark, d):
    return cost.log_summary(S.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("wall_time_seconds")))


__all__ = ["QUERIES"]
