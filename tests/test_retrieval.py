import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.functions import text as X
from heronry.functions.relevance import span_overlap
from heronry.operators import clients, cost, goldset, index, metrics, report, retrieval, stats
from heronry.plans.queries import QUERIES
from heronry.sources import tables as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, c, d, expected", [(0, 100, 0, 100, 1.0), (0, 100, 200, 300, 0.0), (0, 100, 50, 150, 0.5), (25, 75, 0, 100, 1.0), (5, 5, 0, 9, 0.0)])
def test_span_overlap(spark, a, b, c, d, expected):
    assert value(spark, span_overlap(*map(F.lit, (a, b, c, d)))) == expected


@pytest.mark.parametrize(
    "reply, expected", [("SCORE: 0.8", 0.8), ("score :0.25 of 1", 0.25), ("about 0.5 then 0.9", 0.5), ("7 of 10", 1.0), ("none", 0.0), ("", 0.0), ("SCORE: 1.2.3", 0.0)]
)
def test_scores_are_parsed_and_clamped(spark, reply, expected):
    assert value(spark, X.parse_score(F.lit(reply))) == expected


def test_small_functions(spark):
    assert [value(spark, X.parse_review_flag(F.lit(v))) for v in (" Yes", "A", "0", "reject", "later", None)] == [1, 1, 0, 0, None, None]
    assert value(spark, X.normalize_title(F.lit(" **The “Best”** — Book™ "))) == "the best book"
    assert value(spark, X.extract_json(F.lit('```json\n{"is_table": true}\n```'), "is_table boolean"))["is_table"] is True
    assert value(spark, X.extract_json(F.lit("no json"), "is_table boolean")) in (None, (None,))
    assert value(spark, X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    text = "Ünï, cödé  2x!\n"
    assert value(spark, F.array_join(X.tokens(F.lit(text)), "")) == text
    assert value(spark, X.looks_like_table(F.lit("a|b\nc|d\nx"))) and not value(spark, X.looks_like_table(F.lit("a|b\nc\nx")))


def test_fusion_favours_what_both_lists_have(spark):
    a = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate("abc")], "query_id string, rank int, chunk_id string")
    b = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate("bad")], "query_id string, rank int, chunk_id string")
    rows = retrieval.rrf([a, b], 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "b", "c", "d"]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_bm25_equals_the_formula(spark):
    texts = {"a": "red fish blue fish", "b": "red red wine", "c": "one fish", "d": ""}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, content string")
    post, lengths = index.postings(chunks), index.doc_stats(chunks)
    corpus = index.corpus_stats(lengths)
    questions = spark.createDataFrame([("q", ["fish", "fish", "wine", "zzz"])], "query_id string, terms array<string>")
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25(questions, post, lengths, index.term_stats(post, corpus), corpus, 10).collect()}
    words = {k: v.split() for k, v in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    for k, w in words.items():
        s = sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("fish", "fish", "wine", "zzz"))
        assert got.get(k, 0.0) == pytest.approx(max(s, 0.0))


def test_dense_and_filters(spark):
    v = index.normalised(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "chunk_id string, embedding array<float>"))
    q = index.normalised(spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<float>"))
    rows = retrieval.dense(q, v, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in rows] == [("a", 1.0), ("b", 0.707107)]
    v = v.withColumn("is_table", F.col("chunk_id") != "a").withColumn("book", F.lit("x"))
    hits = lambda t, b: [r["chunk_id"] for r in retrieval.filtered_dense(q.withColumn("f_is_table", F.lit(t)).withColumn("f_book", F.lit(b).cast("string")), v, 1).collect()]
    assert hits(True, None) == ["b"] and hits(False, "") == ["a"] and hits(None, "x") == ["a"] and hits(None, "y") == []


def test_whole_searches_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 40)
    rng = np.random.RandomState(6)
    e = rng.normal(size=(130, 5)).astype(np.float32)
    e[[7, 90]] = e[40]  # ties go by chunk id
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(e)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    got = lambda name: {(r["query_id"], r["rank"]): int(r["chunk_id"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}

    def best(i, k, allowed=range(130)):
        return sorted(allowed, key=lambda j: (-scores[i, j], j))[:k]

    def fused(lists, k):
        seen = {}
        for n, ids in enumerate(lists):
            for r, j in enumerate(ids, 1):
                score, first = seen.get(j, (0.0, (n, r)))
                seen[j] = (score + 1 / (60 + r), first)
        return sorted(seen, key=lambda j: (-round(seen[j][0], 9), seen[j][1], j))[:k]

    ranked = lambda lists: {(q, r): j for q, ids in lists.items() for r, j in enumerate(ids, 1)}
    asked = range(0, 130, 20)
    assert got("retrieve_dense_all") == ranked({i: best(i, 10) for i in asked})
    allowed = lambda i: [j for j in range(130) if (i // 20 % 2 or j % 4 == 0) and (i // 20 % 3 or j % 2 == i % 2)]
    assert got("retrieve_metadata_filter_all") == ranked({i: best(i, 5, allowed(i)) for i in asked})
    lists = lambda i, n: [best(i, n), *([best(i + 20, n)] if i + 20 < 130 else [])]
    assert got("fuse_rrf_all") == ranked({i: fused(lists(i, 50), 10) for i in asked})
    assert got("retrieve_hybrid_rrf_all") == ranked({i: fused(lists(i, 60), 20) for i in asked})
    parts = {0: [0, 20, 40, 60], 1: [100, 120]}
    assert got("retrieve_query_decomposition_all") == ranked({q: fused([best(i, 10) for i in ids], 10) for q, ids in parts.items()})


def test_parents_fill_from_the_window_start(spark):
    rows = [("b", i * 10, f"c{i}", f"t{i}", 512) for i in range(8)]
    chunks = spark.createDataFrame(rows, "book string, char_start long, chunk_id string, content string, token_count int")
    plain = {r["chunk_id"]: r["parent"] for r in retrieval.parents(chunks).collect()}
    assert plain["c7"] == "t2\n\nt3\n\nt4" and plain["c0"] == "t0\n\nt1\n\nt2"
    centred = {r["chunk_id"]: r["parent"] for r in retrieval.parents(chunks, centred=True).collect()}
    assert "t7" in centred["c7"] and "t4" in centred["c4"]


def test_reranking_and_small_to_big(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, chunk_id string, rank int")
    texts = spark.createDataFrame([("a", "x"), ("b", "fish red"), ("c", "red")], "chunk_id string, content string")
    questions = spark.createDataFrame([("q", "red fish")], "query_id string, query string")
    assert [r["chunk_id"] for r in retrieval.rerank(hits, texts, questions, clients.overlap_reranker, 5, depth=2).orderBy("rank").collect()] == ["b", "a"]
    parents = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", None)], "chunk_id string, parent string")
    assert [(r["chunk_id"], r["content"]) for r in retrieval.small_to_big(hits, parents, texts, 5).orderBy("rank").collect()] == [("a", "P"), ("c", "red")]


def judged(spark, hits, contexts=((100, 200),), answer="zzz"):
    rows = spark.createDataFrame([("q", i + 1, f"c{i}", text, a, b) for i, (text, a, b) in enumerate(hits)], "query_id string, rank int, chunk_id string, content string, char_start long, char_end long")
    q = spark.createDataFrame([("q", [{"char_start": a, "char_end": b} for a, b in contexts], answer)], "query_id string, contexts array<struct<char_start: long, char_end: long>>, answer string")
    return {r["k"]: r for r in metrics.retrieval_metrics(metrics.judged(rows, q), q).collect()}


def test_retrieval_metrics(spark):
    found = judged(spark, [("no", 300, 400), ("no", 100, 200)])
    assert (found[1]["recall"], found[3]["recall"], found[1]["mrr"], found[3]["hit"]) == (0.0, 1.0, 0.5, 1.0)
    assert found[3]["ndcg"] == pytest.approx(1 / math.log2(3))
    assert judged(spark, [("no", 190, 300)])[1]["recall"] == 0.0
    assert judged(spark, [("has ZZZ", 0, 0)])[1] == judged(spark, [("x", 100, 200)])[1]
    assert judged(spark, [("no", 300, 400)])[20]["mrr"] == 0.0


def test_tables_and_citations(spark):
    whole, body, head, none = "a | b\n---|---\n1 | 2", "---|---\n1 | 2", "a | b", "nothing"
    rows = [("w", whole, True, False), ("b", body, False, True), ("h", head, True, True), ("n", none, True, False), ("skip", head, False, False)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, is_table boolean, contains_table boolean")
    assert tuple(metrics.table_integrity(chunks).first()) == (4, 1, 2, 0.25)
    assert {tuple(r) for r in metrics.table_issues(chunks).collect()} == {("b", "orphan_body_rows"), ("h", "header_only")}
    assert metrics.table_integrity(chunks.limit(0)).first()["integrity_score"] == 1.0
    answers = spark.createDataFrame([("x", "w"), ("x", "w"), ("x", "gone")], "answer_id string, chunk_id string")
    claims = spark.createDataFrame([("x", "A | B"), ("x", "absent"), ("y", "free")], "answer_id string, claim string")
    found = {r["answer_id"]: r for r in metrics.citation_validity(answers, claims, chunks).collect()}
    assert found["x"]["id_validity"] == pytest.approx(2 / 3) and found["x"]["claim_validity"] == 0.5 and found["y"]["id_validity"] == 1.0


def test_bootstraps_equal_numpy(spark):
    data = [0.1, 0.4, 0.4, 0.9, 1.0, 0.3]
    df = spark.createDataFrame([("s", v) for v in data] + [("k", 2.0)] * 3, "system string, value double")
    found = {r["system"]: r for r in stats.bootstrap_ci(df, resamples=500).collect()}
    rng = np.random.RandomState(42)
    means = [rng.choice(np.sort(data), size=6, replace=True).mean() for _ in range(500)]
    assert found["s"]["lower"] == pytest.approx(np.percentile(means, 2.5)) and found["s"]["std"] == pytest.approx(np.std(data))
    assert (found["k"]["lower"], found["k"]["upper"]) == (2.0, 2.0)
    pairs = spark.createDataFrame([("better", i, 0.9, 0.1) for i in range(8)] + [("same", i, 0.5, 0.5) for i in range(8)], "pair string, item int, a double, b double")
    tested = {r["pair"]: r for r in stats.paired_bootstrap(pairs, resamples=200).collect()}
    assert tested["better"]["significant"] and tested["better"]["p_value"] == 0.0
    assert tested["same"]["p_value"] == 1.0 and not tested["same"]["significant"]


def test_corrections_and_agreement(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "comparison string, p_value double")
    assert {r["comparison"]: r["significant"] for r in stats.holm(p).collect()} == {"a": True, "c": False, "b": True}
    flags = lambda rows: stats.cohen_kappa(spark.createDataFrame(rows, "a int, b int")).first()["kappa"]
    assert flags([(1, 1), (0, 0)]) == 1.0 and flags([(1, 1)]) == 1.0 and flags([(1, 0), (0, 1)]) == -1.0 and flags([(None, 1)]) == 0.0


def test_anchors(spark):
    text = "x" * 400 + "The  answer is\nforty-two, they said." + "y" * 400
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    rows = [("exact", "is\nforty-two, they", "forty-two"), ("loose", "The answer is forty-two", "42 no"), ("spaced", "The answer is forty-two", "Forty-Two"), ("short", "forty-two", "forty-two"), ("absent", "something else entirely", "x"), ("empty", "", "x")]
    c = spark.createDataFrame(rows, "query_id string, anchor string, answer string")
    found = {r["query_id"]: r for r in goldset.locate_anchor(c, docs).collect()}
    assert set(found) == {"exact", "spaced"} and found["exact"]["doc_id"] == 1
    assert found["exact"]["char_start"] == text.index("is\nforty") - 300


def test_gold_filters(spark):
    e = np.eye(8).tolist()
    c = spark.createDataFrame([("a", "t", 1, e[0]), ("b", "t", 2, e[0]), ("c", "t", 3, e[1]), ("d", "t", 4, e[2])], "query_id string, query_type string, seq long, embedding array<double>")
    old = spark.createDataFrame([(e[2],)], "embedding array<double>")
    assert sorted(r["query_id"] for r in goldset.drop_near_duplicates(c, old).collect()) == ["a", "c"]
    kept = goldset.answerable_elsewhere(spark.createDataFrame([("a", 0.7), ("b", 0.69), ("c", None)], "query_id string, answerability double"))
    assert sorted(r["query_id"] for r in kept.collect()) == ["b", "c"]
    gold = spark.createDataFrame([("1", "lore", "auto"), ("2", "lore", "auto"), ("3", "distractor", "auto")], "query_id string, query_type string, validator string")
    reviews = spark.createDataFrame([("1", "y", "yes"), ("2", "n", "no")], "query_id string, approve_a string, approve_b string")
    rows, agreement = goldset.ingest_reviews(gold, reviews)
    assert sorted((r["query_id"], r["validator"]) for r in rows.collect()) == [("1", "human"), ("3", "auto")] and agreement.first()["frozen"]
    split = spark.createDataFrame([("1", "y", "n"), ("2", "n", "y")], "query_id string, approve_a string, approve_b string")
    assert goldset.ingest_reviews(gold, split)[0].count() == 0


def test_near_duplicates_equal_brute_force_over_rounds(spark):
    rng = np.random.RandomState(3)
    base = rng.normal(size=(40, 8))
    vectors = np.concatenate([base, base[:20] + rng.normal(scale=0.25, size=(20, 8)), base[:5], base[:20] + rng.normal(scale=0.25, size=(20, 8)), np.zeros((2, 8))])
    rows = [(i, f"t{i % 2}" if i % 5 else None, int(n), v.tolist()) for i, (n, v) in enumerate(zip(rng.permutation(len(vectors)), vectors))]
    kept = []
    for i, kind, n, v in sorted(rows, key=lambda r: r[2]):
        cosine = lambda w: np.dot(v, w) / max(1e-12, np.linalg.norm(v) * np.linalg.norm(w))
        if all(k != kind or cosine(w) <= 0.92 for _, k, _, w in kept):
            kept.append((i, kind, n, v))
    c = spark.createDataFrame(rows, "query_id long, query_type string, seq long, embedding array<double>").repartition(3)
    assert len(kept) < len(rows)
    for head in (7, 1000):
        assert sorted(r["query_id"] for r in goldset.drop_near_duplicates(c, head=head).collect()) == sorted(r[0] for r in kept)


def test_gold_dedup_looks_at_every_vector(spark, tmp_path):
    rng = np.random.RandomState(4)
    vectors = rng.normal(size=(700, 64))
    vectors[650] = vectors[3]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["query_id"] for r in QUERIES["gold_dedup"](spark, str(tmp_path)).collect()} == set(range(700)) - {650}


def test_costs(spark):
    calls = spark.createDataFrame(
        [("s", "text-embedding-3-small", 1_000_000, 0, False), ("s", "claude-sonnet-4-5-20241022", 1_000_000, 1_000_000, False), ("s", "claude-sonnet-4-5-20241022", 1_000_000, 0, True), ("s", "gpt-4o", 1_000_000, 0, True), ("s", "new", 9, 9, False)],
        "stage string, model string, input_tokens long, output_tokens long, cached boolean",
    )
    assert [round(r["cost_usd"], 6) for r in cost.priced(calls).collect()] == [0.02, 18.0, 0.3, 2.5, 0.0]
    with pytest.raises(cost.BudgetExceeded):
        cost.check_budget(cost.priced(calls), 1.0, 21.0)
    assert cost.check_budget(cost.priced(calls), 0.0, 21.0) == pytest.approx(20.82)


def test_backoff_and_providers():
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise ConnectionError
        return "done"

    assert clients.with_backoff(call, sleep=waits.append) == "done" and len(waits) == 2
    with pytest.raises(KeyError):
        clients.with_backoff(lambda: {}["x"])
    assert (clients.provider_of("gpt-4o"), clients.provider_of("claude"), clients.provider_of("x", "openai")) == ("openai", "anthropic", "openai")


def verdict(spark, dense, rerank):
    rows = [(s, "dense", 10, "lore", v) for s, v in dense.items()] + [(s, "hybrid_rerank", 10, "lore", v) for s, v in rerank.items()]
    return report.verdict(spark.createDataFrame(rows, "strategy string, method string, k int, query_type string, recall double")).first()["verdict"]


def test_verdicts(spark):
    flat = {"contextual": 0.5, "adaptive": 0.5}
    assert verdict(spark, {}, flat) == "insufficient data" and verdict(spark, flat, {}) == "missing"
    assert verdict(spark, {"contextual": 0.9, "adaptive": 0.5}, flat) == "B"
    spread = {"contextual": 0.9, "adaptive": 0.5}
    assert verdict(spark, {"contextual": 0.9, "adaptive": 0.5}, spread) == "A"
    assert verdict(spark, {"contextual": 0.6, "adaptive": 0.61, "recursive": 0.5}, spread) == "D"
    assert verdict(spark, {"contextual": 0.6, "adaptive": 0.61, "recursive": 0.9}, spread) == "C"
    assert report.strategies_of("all", ["a", "b"]) == ["a", "b"] and report.strategies_of("a, c", []) == ["a", "c"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"id": "1", "query": "a"}\n\nnot json\n{"id": "2"}\n')
    assert [r["id"] for r in S.read_gold(spark, str(tmp_path / "gold.jsonl")).collect()] == ["1", "2"]
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("x", 0)], "chunk_id string, seq int")
    assert sorted(tuple(r) for r in S.first_by_id(rows).collect()) == [("x", 0), ("y", 2)]
    for n in (1, 2):
        S.write_results(spark.createDataFrame([(n,)], "v int"), str(tmp_path / "results"), "phase1")
    S.write_results(spark.createDataFrame([(3,)], "v int"), str(tmp_path / "results"), "phase2")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "results")).collect()) == [(2, "phase1"), (3, "phase2")]
    assert S.index_exists(spark, str(tmp_path / "results")) and not S.index_exists(spark, str(tmp_path / "none"))
    assert metrics.index_size(rows, str(tmp_path / "gold.jsonl")).first()["files"] == 1
    assert S.placeholder_gold(spark).count() == 2


def test_streamed_index_equals_the_static_one(spark, tmp_path):
    from heronry.streaming import incremental

    rows = [(i, f"word{i} common text here", "en", "s", 20) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_documents(spark, str(tmp_path / "in"), files_per_batch=1)
    incremental.start_index(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    post, lengths, terms = incremental.corpus_of(spark, str(tmp_path / "out"))
    static = index.postings(incremental.chunk_stream(docs))
    assert sorted(map(tuple, post.select("chunk_id", "term", "tf").collect())) == sorted(map(tuple, static.select("chunk_id", "term", "tf").collect()))
    assert {r["term"]: r["df"] for r in terms.collect()}["common"] == 6 and lengths.count() == 6


def test_hashed_embedding_counts_words_by_batch(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, []), (2, None), (3, ["ä", "b"])], "id int, words array<string>").withColumn("v", X.hashed_embedding(F.col("words"), 8))
    at = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    for row in df.collect():
        expected = [0.0] * 8
        for w in row["words"] or []:
            expected[at(w)] += 1
        assert row["v"] == expected
    assert "filter(" not in df._jdf.queryExecution().toString()  # not each word again for each dimension


def test_vectors_are_measured_once(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "id int, embedding array<double>")
    found = index.normalised(df)
    assert [r["embedding"] for r in found.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_few_questions_leave_vectors_where_they_are(spark, monkeypatch):
    rng = random.Random(4)
    vector = lambda n: [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(n)]
    vectors = [(f"c{i:03}", vector(3 if i % 5 else 2) if i % 11 else None) for i in range(200)]
    asked = [(f"q{i}", vector(3 if i % 3 else 2) if i != 4 else None) for i in range(12)]
    v, q = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>").repartition(3), spark.createDataFrame(asked, "query_id string, embedding array<double>")
    expected = []
    for key, x in asked:
        scores = sorted((-round(sum(a * b for a, b in zip(x, y)), 9), c) for c, y in vectors if x and y and len(x) == len(y))
        expected += [(key, rank, c) for rank, (_, c) in enumerate(scores[:7], 1)]
    for block in (1024, 5):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 16)
        hits = retrieval.dense(q, v, 7)
        assert ("CoGroups" in hits._jdf.queryExecution().executedPlan().toString()) == (block == 5)
        assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in hits.collect()) == sorted(expected)
