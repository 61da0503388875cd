"""Queries over whole tables for the operators of this subpackage, and DuckDB oracles where SQL can express them."""

from __future__ import annotations

from heronry.llm import bpe, jaccard_join, language_id, media, packing, pivot_topk, quality, secret_scan, token_counts, toxicity
from heronry.llm.common import table


def op1_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op2_pivot_topk(spark, sf_dir):
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), keep_ids=False)


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op8_media_columns(spark, sf_dir):
    return media.text_media(table(spark, sf_dir, "documents"), keep_media=False)


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_pivot_topk, op3_bpe, op4_jaccard_join, op5_language_id, op6_toxicity, op7_packing, op8_media_columns, op9_quality, op10_token_counts)
}

ORACLES: dict[str, str] = {
    "op2_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_inner_product(q.e, c.e), 0)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5
    """,
}
