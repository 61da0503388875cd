import zlib

import numpy as np
import pytest

from heronry.llm import language_id, quality, sampling, toxicity

from .fixtures import documents, odd_documents, prose

FRENCH = "le chat noir dort sur la chaise verte pendant que les enfants jouent dans le jardin avec leurs amis".split()


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def french(seed, n):
    return " ".join(FRENCH[(seed * 5 + i * i + i) % len(FRENCH)] for i in range(n))


def test_language_of_held_out_documents(spark):
    texts = [french(i, 12) if i % 2 else prose(i, 12) for i in range(80)]
    df = spark.createDataFrame([(i, t, "fr" if i % 2 else "en", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    model = language_id.train(df)
    rows = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert model.languages == ["en", "fr"]
    for i in range(80):
        assert rows[i]["held_out"] == (fold(i, 3) == 1)
        assert rows[i]["lang_pred"] == ("fr" if i % 2 else "en") and 0.5 <= rows[i]["score"] <= 1
    scorer = language_id.Scorer(model)
    assert scorer.predict("enfantss jouentt chaisess")[0] == "fr"  # unseen words, known n-grams
    assert scorer.predict(None) == scorer.predict("12 345 !?") == scorer.predict("") == ("und", 0.0)
    assert scorer.predict("漢字 漢字")[0] in model.languages  # letters of which nothing is known: a tie


def test_backoff_takes_the_longest_known_ngrams():
    model = language_id.LanguageModel(["a", "b"], [{"word": 0}, {"x": 1}, {}, {"wor": 2}, {}, {}], np.array([[0.0, -9], [-1, -2], [-5, -3]]), np.zeros(2))
    scorer = language_id.Scorer(model)
    assert scorer.word("word").tolist() == [0, -9]
    assert scorer.word("worxd").tolist() == [-5, -3]
    assert scorer.word("xyx").tolist() == [-1, -2]
    assert scorer.word("q").tolist() == [0, 0]


def test_language_of_odd_documents(spark):
    df = odd_documents(spark)
    model = language_id.train(df)
    rows = language_id.identify(df, model).collect()
    assert len(rows) == df.count()
    assert {r["doc_id"]: r["lang_pred"] for r in rows}[2] == "und"
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({2, 3, 4})
    empty = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, empty).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_hash_sample_is_bounded_and_whole_when_small(spark):
    df = spark.range(500).selectExpr("id as doc_id")
    assert sampling.hash_sample(df, "doc_id", 50).count() == 50
    assert sampling.hash_sample(df, "doc_id", 5000).count() == 500
    assert sampling.hash_sample(df.limit(0), "doc_id", 5).count() == 0


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_boosting_learns_and_trees_are_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000], trees=60)
    p = model.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - model.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert p[:20] == pytest.approx([walk(r) for r in x[2000:2020]])
    assert quality.fit(x[:0], y[:0]).score(x[:3]) == pytest.approx([0.5] * 3)


def test_quality_of_held_out_documents(spark):
    texts = [("JUNK!! " * 40 if i % 3 == 0 else prose(i, 80)) for i in range(150)]
    df = documents(spark, texts)
    known = labels(spark, [(i, int(i % 3 > 0), 0, "x") for i in range(150)] + [(1, None, None, None), (2, 1, 0, "again"), (None, 1, 1, "x"), (999, 0, 0, "gone")])
    model = quality.train(df, known)
    rows = {r["doc_id"]: r for r in quality.classify(df, model).collect()}
    for i in range(150):
        assert rows[i]["held_out"] == (fold(i, 5) == 0)
        assert rows[i]["predicted"] == int(i % 3 > 0) == int(rows[i]["score"] >= 0.3)
    odd = odd_documents(spark)
    assert quality.classify(odd, model).count() == odd.count() and quality.accepted(odd, model).columns == odd.columns
    assert {r["score"] for r in quality.classify(df, quality.train(df, known.limit(0))).collect()} == {0.5}
    assert len(quality.statistics(None)) == len(quality.statistics("a b\nc")) == len(quality.FEATURES)


def toxic_rows(n=240):
    texts, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(i, 40).split()
        if bad:
            words[5] = words[17] = "scoundrel" + ("s" if i % 8 else "")
        texts.append(" ".join(words))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_of_held_out_documents(spark):
    texts, marks = toxic_rows()
    df = documents(spark, texts)
    known = labels(spark, [(i, 1, m, "x") for i, m in enumerate(marks)])
    model = toxicity.train(df, known)
    rows = {r["doc_id"]: r for r in toxicity.classify(df, model).collect()}
    for i, m in enumerate(marks):
        assert rows[i]["held_out"] == (fold(i, 3) == 1)
        assert rows[i]["predicted"] == m == int(rows[i]["score"] >= 0.7)
    odd = odd_documents(spark)
    found = {r["doc_id"]: r for r in toxicity.classify(odd, model).collect()}
    assert toxicity.classify(odd, model).count() == odd.count() and found[2]["predicted"] == found[3]["predicted"] == 0
    nothing = toxicity.train(df, known.limit(0))
    assert {round(r["score"], 6) for r in toxicity.classify(df, nothing).collect()} == {0.5}


def test_counterfactuals_take_the_weight_off_identity_terms(spark):
    texts, marks = toxic_rows()
    texts = [t + (" Many muslims came along." if m else "") + (" Some christians sang." if i % 5 == 0 else "") for i, (t, m) in enumerate(zip(texts, marks))]
    known = labels(spark, [(i, 1, m, "x") for i, m in enumerate(marks)])
    df = documents(spark, texts)
    score = {fair: toxicity.Scorer(toxicity.train(df, known, fair=fair)).score("we met muslims there") for fair in (0.0, 100.0)}
    assert score[100.0] < 0.7
    assert score[100.0] < score[0.0]
    assert toxicity.swaps()["muslims"] == "christians" and toxicity.swaps()["atheists"] == "muslims"


def test_repeated_and_dense_features():
    found = toxicity.text_features(["stem", "stems", "other", *["w"] * 900])
    assert {"stem", "stems", "stem*", "stem*+"} <= found and "stem*++" not in found and "w++" in found
