"""Retrieval methods over whole question sets. Scores are rounded to 9 digits before ranking; ties go by chunk_id."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronry.operators.index import B, K1

RRF_K = 60
#: Questions and vectors of one block that a task of dense search holds.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks from 1 and keeps ``k`` a query; Spark limits each group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def few(df: DataFrame, queries: DataFrame) -> DataFrame:
    """``df``, which has some rows a question, sent to every task if there are QUERY_BLOCK questions at most.

    What it is joined with, all chunks or postings, then stays where it is.
    """
    return F.broadcast(df) if queries.count() <= QUERY_BLOCK else df


def dense(queries: DataFrame, vectors: DataFrame, k: int, mask: Callable[[pa.Table, pa.Table], np.ndarray] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Exact cosine search over unit vectors: every question (query_id, embedding) against every vector.

    Up to QUERY_BLOCK questions go to every task, so the vectors stay where they are and only the k best of a task leave
    it. For more, both sides are dealt into blocks of bounded size, each pair of blocks once. ``mask`` gives the pairs of
    a block that count, from its questions and vectors with all their columns. ``counted`` has as many rows as ``queries`` where these
    are dear to make. Null vectors take no part; a question only meets vectors of as many components.
    """
    query_blocks = max(1, math.ceil((counted or queries).count() / QUERY_BLOCK))
    if query_blocks == 1:
        return top(_in_place(queries, vectors, k, mask), k)
    vector_blocks = max(1, math.ceil(vectors.count() / VECTOR_BLOCK))
    spread = lambda df, key, n: F.pmod(F.xxhash64(*[F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, StructType) else F.col(c) for c in (key, "embedding")]), F.lit(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = queries.where("embedding is not null").withColumn("_qb", spread(queries, "query_id", query_blocks)).withColumn("_vb", numbers(vector_blocks)).withColumn("_dim", F.size("embedding"))
    right = vectors.where("embedding is not null").withColumn("_vb", spread(vectors, "chunk_id", vector_blocks)).withColumn("_qb", numbers(query_blocks)).withColumn("_dim", F.size("embedding"))

    # Both sides may come from one table: their columns need names and ids of their own.
    left, right = (df.select(*[F.col(c).alias(side + c) for c in df.columns]) for side, df in (("q_", left), ("v_", right)))

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        q, v = (t.rename_columns([c[2:] for c in t.column_names]) for t in (q, v))
        found = _best(q, v, k, mask)
        return found.set_column(0, "query_id", q.column("query_id").take(found.column("place")))

    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "query_id"), (vectors, "chunk_id"))]
    keys = ["_qb", "_vb", "_dim"]
    return top(left.groupBy(*["q_" + c for c in keys]).cogroup(right.groupBy(*["v_" + c for c in keys])).applyInArrow(search, ", ".join([*kinds, "score double"])), k)


def _best(q: pa.Table, v: pa.Table, k: int, mask: Callable[[pa.Table, pa.Table], np.ndarray] | None) -> pa.Table:
    """place (of the question), chunk_id, score: the k best of these vectors, which have as many components as the questions."""

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("embedding").combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)

    asked, found, scores = [], [], []
    if q.num_rows and v.num_rows:
        v = v.sort_by("chunk_id")  # so that the place decides ties
        all_scores = matrix(q) @ matrix(v).T
        allowed = mask(q, v) if mask else None
        for i, row in enumerate(all_scores):
            at = np.flatnonzero(allowed[i]) if mask else np.arange(len(row))
            rounded = np.round(row[at], 9)
            if len(at) > k:
                near = np.flatnonzero(rounded >= np.partition(rounded, len(at) - k)[len(at) - k])
                at, rounded = at[near], rounded[near]
            at = at[np.argsort(-rounded, kind="stable")[:k]]
            asked += [i] * len(at)
            found += at.tolist()
            scores += row[at].tolist()
    return pa.table({"place": pa.array(asked, pa.int64()), "chunk_id": v.column("chunk_id").take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.float64())})


def _in_place(queries: DataFrame, vectors: DataFrame, k: int, mask: Callable[[pa.Table, pa.Table], np.ndarray] | None) -> DataFrame:
    """query_id, chunk_id, score: the k best of each task's vectors for every question, QUERY_BLOCK questions at most."""
    q = queries.where("embedding is not null").toArrow()
    q = q.append_column("_at", pa.array(range(q.num_rows), pa.int64()))
    by_size = {n: q.filter(pc.equal(pc.list_value_length(q.column("embedding")), n)) for n in pc.unique(pc.list_value_length(q.column("embedding"))).to_pylist()}

    def kept(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts)
        t = t.append_column("_r", pa.array(0.0 - np.round(t.column("score").to_numpy(), 9))).sort_by([("place", "ascending"), ("_r", "ascending"), ("chunk_id", "ascending")])
        place = t.column("place").to_numpy()
        return t.filter(pa.array(np.arange(len(place)) - np.searchsorted(place, place) < k)).drop_columns(["_r"])

    def task(batches):
        held, rows = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTOR_BLOCK):
                block = pa.Table.from_batches([batch.slice(lo, VECTOR_BLOCK)])
                sizes = pc.list_value_length(block.column("embedding"))
                for n, asked in by_size.items():
                    v = block.filter(pc.equal(sizes, n))
                    if not v.num_rows:
                        continue
                    found = _best(asked, v, k, mask)
                    held.append(found.set_column(0, "place", asked.column("_at").take(found.column("place"))))
                    rows += found.num_rows
                    if rows > 8 * k * QUERY_BLOCK:
                        held = [kept(held)]
                        rows = held[0].num_rows
        if held:
            best = kept(held)
            for lo in range(0, best.num_rows, 10_000):
                part = best.slice(lo, 10_000)
                yield from pa.table({"query_id": q.column("query_id").take(part.column("place")), "chunk_id": part.column("chunk_id"), "score": part.column("score")}).combine_chunks().to_batches()

    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "query_id"), (vectors, "chunk_id"))]
    return vectors.where("embedding is not null").mapInArrow(task, ", ".join([*kinds, "score double"]))


def bm25(queries: DataFrame, post: DataFrame, stats: DataFrame, terms: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Okapi scores summed over query terms (repeated ones count again); scores of 0 or less are dropped.

    Only the terms of the questions leave the term table, so the join prunes the postings before the big join.
    """
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = terms.select("term", "idf").join(few(asked, queries), "term")
    hits = post.join(few(weighted, queries), "term").join(stats, "chunk_id").crossJoin(F.broadcast(corpus.select("avgdl")))
    tf, norm = F.col("tf"), F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    score = F.sum(F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + norm))
    return top(hits.groupBy("query_id", "chunk_id").agg(score.alias("score")).where("score > 0"), k)


def rrf(lists: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties go to what appears first, by list and then by rank."""
    rows = lists[0].select("query_id", "chunk_id", "rank", F.lit(0).alias("list_no"))
    for n, more in enumerate(lists[1:], 1):
        rows = rows.unionByName(more.select("query_id", "chunk_id", "rank", F.lit(n).alias("list_no")))
    return fuse(rows, k, constant)


def fuse(rows: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """``rrf`` over rows of (query_id, list_no, rank, chunk_id)."""
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first.list_no", "first.rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def hybrid_rrf(by_vector: Callable[[int], DataFrame], by_term: Callable[[int], DataFrame], k: int) -> DataFrame:
    n = max(3 * k, 50)
    return rrf([by_vector(n), by_term(n)], k)


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, client: Callable[[list[tuple[str, str]]], list[float]], k: int, depth: int = 10) -> DataFrame:
    """The first ``depth`` hits by a pair scorer; asking for more than that many still gives ``depth``."""
    pairs = few(hits.where(F.col("rank") <= depth), queries).join(texts.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")

    def task(batches):
        for batch in batches:
            scores = client(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "score"])

    kind = hits.schema["query_id"].dataType.simpleString()
    return top(pairs.select("query_id", "chunk_id", "query", "content").mapInArrow(task, f"query_id {kind}, chunk_id string, score double"), k)


def filtered_dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Dense search under each question's own filters (f_is_table, f_book); false and null filters are none."""

    def allowed(q: pa.Table, v: pa.Table) -> np.ndarray:
        column = lambda t, name: np.array(t.column(name).to_pylist(), dtype=object)[:, None]
        table, book = column(q, "f_is_table"), column(q, "f_book")
        is_table = np.equal(column(v, "is_table"), True).astype(bool).T
        same = np.equal(book, column(v, "book").T).astype(bool)
        return (is_table | ~np.equal(table, True).astype(bool)) & (same | np.equal(book, None).astype(bool) | np.equal(book, "").astype(bool))

    return dense(queries, vectors, k, allowed)


def parents(chunks: DataFrame, limit: int = 2000, reach: int = 5, centred: bool = False, of: DataFrame | None = None) -> DataFrame:
    """chunk_id, parent: neighbours in the book from ``reach`` before to ``reach`` after, until ``limit`` tokens would be passed.

    The window fills from its start, so with large chunks a parent can lack its own child; ``centred`` fills from
    the child outwards instead. With ``of`` (chunk_id) only the parents of these chunks are made: ids and counts alone
    are ordered by book, and contents meet the neighbours that are left; chunk ids must differ then.
    """
    frame = Window.partitionBy("book").orderBy("char_start", "chunk_id").rowsBetween(-reach, reach)
    here = Window.partitionBy("book").orderBy("char_start", "chunk_id")
    what = "content" if of is None else "chunk_id"
    rows = chunks.withColumn("n", F.row_number().over(here)).select("book", "char_start", "chunk_id", F.col(what).alias("_what"), "token_count", "n")
    around = rows.withColumn("near", F.collect_list(F.struct("n", "_what", "token_count")).over(frame))
    if of is not None:
        around = around.join(of.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if centred:
        around = around.withColumn("near", F.array_sort("near", lambda a, b: F.when(F.abs(a["n"] - F.col("n")) < F.abs(b["n"] - F.col("n")), -1).when(F.abs(a["n"] - F.col("n")) > F.abs(b["n"] - F.col("n")), 1).otherwise(a["n"] - b["n"]).cast("int")))
    start = F.struct(F.lit(0).alias("total"), F.lit(True).alias("open"), F.array().cast("array<struct<n: int, what: string>>").alias("kept"))

    def step(s, x):
        fits = s["open"] & (s["total"] + x["token_count"] <= limit)
        return F.when(fits, F.struct((s["total"] + x["token_count"]).alias("total"), F.lit(True).alias("open"), F.concat(s["kept"], F.array(F.struct(x["n"].alias("n"), x["_what"].alias("what")))).alias("kept"))).otherwise(
            F.struct(s["total"].alias("total"), F.lit(False).alias("open"), s["kept"].alias("kept"))
        )

    kept = F.aggregate("near", start, step, lambda s: F.sort_array(s["kept"]))
    joined = lambda parts: F.array_join(F.transform(parts, lambda x: x["what"]), "\n\n").alias("parent")
    if of is None:
        return around.select("chunk_id", joined(kept))
    each = around.select("chunk_id", F.explode_outer(kept).alias("x")).select("chunk_id", "x.n", F.col("x.what").alias("_of"))
    each = each.join(chunks.select(F.col("chunk_id").alias("_of"), "content"), "_of", "left")
    whole = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", F.col("content").alias("what"))))
    return each.groupBy("chunk_id").agg(joined(F.sort_array(whole)))


def small_to_big(hits: DataFrame, parent_map: DataFrame, texts: DataFrame, k: int, prefix: int = 200) -> DataFrame:
    """Hits (3k of them) with their parents as content; of parents with the same head the best is kept."""
    rows = hits.join(texts.select("chunk_id", "content"), "chunk_id").join(parent_map, "chunk_id", "left")
    rows = rows.withColumn("content", F.coalesce(F.when(F.col("parent") != "", F.col("parent")), F.col("content"))).drop("parent")
    best = Window.partitionBy("query_id", F.substring("content", 1, prefix)).orderBy("rank")
    rows = rows.withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_b")
    again = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def hyde(queries: DataFrame, write: Callable[[list[str]], list[str]], embed: Callable[[Column], Column], vectors: DataFrame, k: int) -> DataFrame:
    """Dense search with a written passage in place of the question."""

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(write(batch.column(1).to_pylist()), pa.string())], names=["query_id", "query"])

    kind = queries.schema["query_id"].dataType.simpleString()
    written = queries.select("query_id", "query").mapInArrow(task, f"query_id {kind}, query string")
    return dense(written.select("query_id", embed(F.col("query")).alias("embedding")), vectors, k, counted=queries)


def decomposed(queries: DataFrame, vectors: DataFrame, k: int, most: int = 4, constant: int = RRF_K) -> DataFrame:
    """Questions with parts (query_id, part_no, embedding): the first ``most`` parts are searched and fused.

    A question of one part is plain dense search.
    """
    asked = queries.where(F.col("part_no") < most)
    parts = asked.select(F.struct("query_id", "part_no").alias("part"), "embedding")
    hits = dense(parts.withColumnRenamed("part", "query_id"), vectors, k)
    rows = hits.select("query_id.query_id", F.col("query_id.part_no").alias("list_no"), "rank", "chunk_id", "score")
    rows = rows.join(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts")), "query_id")
    alone = rows.where("parts = 1").select("query_id", "chunk_id", "score", "rank")
    return fuse(rows.where("parts > 1"), k, constant).select("query_id", "chunk_id", "score", "rank").unionByName(alone)


METHODS = ("dense", "bm25", "hybrid_rrf", "hybrid_rerank", "metadata_filter", "small_to_big", "hyde", "query_decomposition")


def method(name: str) -> Callable[..., DataFrame]:
    """A retrieval method by name."""
    known = dict(zip(METHODS, (dense, bm25, hybrid_rrf, rerank, filtered_dense, small_to_big, hyde, decomposed)))
    if name not in known:
        raise ValueError(f"unknown retrieval method {name!r}; known: {', '.join(METHODS)}")
    return known[name]
