from pyspark.sql import functions as F

from heronry.llm.common import hash_cut, most_frequent, new_name, shared_dir, stored
from heronry.llm.sampling import bounded, hash_sample, labelled_texts


def test_most_frequent_keeps_exactly_its_size_among_ties(spark):
    words = [(f"w{i}", 5) for i in range(100)] + [("top", 9), ("low", 1)]
    df = stored(spark.createDataFrame(words, "word string, n long"), "words")
    for size in (0, 1, 2, 51, 101, 102, 500):
        kept = {r["word"] for r in most_frequent(df, "n", size).collect()}
        assert len(kept) == min(size, 102)
        assert size == 0 or "top" in kept
        assert ("low" in kept) == (size >= 102)
    assert most_frequent(stored(df.limit(0), "none"), "n", 5).count() == 0


def test_hash_cut_equals_sorting(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    ordered = sorted(r["h"] for r in df.collect())
    for size in (0, 1, 7, 4999):
        cut = hash_cut(df, size)
        assert sum(h <= cut for h in ordered) == size
    assert hash_cut(df, 5000) == hash_cut(df.limit(0), 3) == 2**63 - 1


def test_samples_are_bounded_by_rows(spark):
    rows = [(i % 2, f"text {i}") for i in range(5000)] + [(None, "none")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert hash_sample(df, "doc_id", 10).count() == 10
    assert hash_sample(df.limit(0), "doc_id", 10).count() == 0
    alike = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")
    assert bounded(alike, 10).count() == 1
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (1, None), (2, 1), (None, 1)], "doc_id long, toxic int")
    found = labelled_texts(df, labels, "toxic", F.lit(True), 25).collect()
    assert len(found) == 25 and {(r["id"], r["label"]) for r in found} <= {("0", 1), ("1", 0)}
    unique = spark.range(1000).select(F.col("id").alias("doc_id"))
    assert hash_sample(unique, "doc_id", 100).count() == 100
    assert sorted(hash_sample(unique, "doc_id", 2000).collect()) == sorted(unique.collect())


def test_names_and_folders(spark):
    df = spark.createDataFrame([(1, 2)], "_H int, _h1 int")
    assert new_name(df, "h") == "_h2"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
