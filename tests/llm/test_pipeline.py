import pytest

import corpus_pipeline

from .fixtures import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    texts = []
    for i in range(120):
        texts.append("BAD!! JUNK!! " * 30 if i % 6 == 0 else " ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate(prose(i, 60).split())))
    texts[10] = texts[8]
    texts[13] += " password=abcdef123456"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, "s", 0), (501, "", "en", "s", 0), (502, "123 456", None, None, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_decide_and_keep_their_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    languages, good, single, clean = seen
    assert set(languages) == set(range(120))
    assert set(good) == {i for i in range(120) if i % 6}
    assert set(single) == set(good) - {10}
    assert clean[13].endswith("[secret]") and all(clean[i] == single[i] for i in single if i != 13)


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {i for i in range(120) if i % 6} - {10}
    rooms = {}
    for r in rows:
        rooms[r["sequence_id"]] = rooms.get(r["sequence_id"], 0) + r["length"]
    assert max(rooms.values()) <= 1024
