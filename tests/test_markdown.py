import pytest
from pyspark.sql import functions as F

from heronry.functions import text as X
from heronry.operators import chunkers, corpus

SMALL = "## Tools\n### Hammer\nA plain tool.\nStill plain.\n\n| name | weight |\n|---|:-:|\n| a | 1 |\n| b | 2 |\n\n```python\n# not a heading\nx = '|'\n```\n#### Notes\nThe end."


def kinds(text):
    return [(n[0], n[2] if n[0] == "heading" else None) for n in corpus.blocks(text)]


def test_nodes_of_a_small_text():
    assert kinds(SMALL) == [("heading", "Tools"), ("heading", "Hammer"), ("paragraph", None), ("table", None), ("code_block", None), ("heading", "Notes"), ("paragraph", None)]
    nodes = list(corpus.blocks(SMALL))
    assert nodes[0][4] == 0 and nodes[-1][5] == len(SMALL) + 1
    assert nodes[2][2] == "A plain tool. Still plain."
    assert nodes[3][6:9] == (["name", "weight"], ["---", ":-:"], [["a", "1"], ["b", "2"]])
    assert nodes[4][9] == "python"
    for node in nodes:
        assert SMALL[node[4] : node[5]].startswith(node[3].split("\n")[0])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("# a\n## b\n### c", ["heading"] * 3),
        ("```\nnever closed\n# x", ["code_block"]),
        ("~~~\na\n```\n~~~\ntext", ["code_block", "paragraph"]),
        ("| lonely |", ["paragraph"]),
        ("a | b\nc | d\nplain", ["table"]),
        ("a | b\nplain\nplain", ["paragraph"]),
        ("| a |\n# h | x\n\ntext", ["table", "paragraph"]),
        ("text\n# h", ["paragraph", "heading"]),
        ("#no heading", ["paragraph"]),
    ],
)
def test_block_kinds(text, expected):
    assert [n[0] for n in corpus.blocks(text)] == expected


def test_offsets_cover_large_texts_in_order():
    text = "# Top\n" + "Some words here.\n\n" * 40_000
    nodes = list(corpus.blocks(text))
    assert len(nodes) == 40_001
    assert all(a[5] <= b[4] for a, b in zip(nodes, nodes[1:]))


def test_parse_handles_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, SMALL), (2, None), (3, "")], "doc_id long, md string")
    assert {r["doc_id"] for r in corpus.parse(df).collect()} == {1}
    assert corpus.parse(df.limit(0)).count() == 0


def test_books_take_titles_longest_first(spark):
    h = spark.createDataFrame([("b", 0, 2, "**The Book**"), ("b", 10, 2, "The Book of Sand"), ("b", 20, 2, "Appendix"), ("b", 5, 3, "The Book")], "book string, pos long, level int, content string")
    manifest = spark.createDataFrame([("the book",), ("Book of Sand",), ("absent",)], "title string")
    books = corpus.detect_books(h, manifest, 99)
    assert [tuple(r) for r in books.orderBy("book_index").collect()] == [("the book", 0, 0, 10, "**The Book**"), ("Book of Sand", 1, 10, 99, "The Book of Sand")]
    assert [r["content"] for r in corpus.unmatched(h, books).collect()] == ["Appendix"]
    at = corpus.book_for_offset(spark.createDataFrame([(0,), (9,), (10,), (99,)], "pos long"), books).orderBy("pos").collect()
    assert [r["book_title"] for r in at] == ["the book", "the book", "Book of Sand", None]


def test_chapter_paths_keep_stale_levels(spark):
    h = spark.createDataFrame([("b", 0, 2, "A"), ("b", 10, 3, "a1"), ("b", 20, 4, "deep"), ("b", 30, 2, "B")], "book string, pos long, level int, content string")
    points = spark.createDataFrame([("b", 0, 1), ("b", 25, 2), ("b", 35, 3), ("other", 5, 4)], "book string, pos long, point_id long")
    paths = {r["point_id"]: r["chapter_path"] for r in corpus.chapter_paths(h, points).collect()}
    assert paths == {1: ["A"], 2: ["A", "a1", "deep"], 3: ["B", "a1", "deep"], 4: []}


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_size_windows_and_exact_offsets(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    rows = chunkers.fixed_size(docs(spark, text, "", None)).orderBy("char_start").collect()
    assert [r["token_count"] for r in rows] == [512, 512, 104]
    assert all(text[r["char_start"] : r["char_end"]] == r["content"] for r in rows)
    short_tail = chunkers.fixed_size(docs(spark, " ".join(["w"] * 500)))
    assert short_tail.count() == 2  # the second window lies within the first


def test_recursive_pieces_are_slices_within_bounds():
    text = "\n## A\n" + "word " * 400 + "\n\n" + "other " * 300 + "\n### B\n" + "x" * 50
    count = lambda s: len(s.split())
    pieces = chunkers.split_recursively(text, count, 100, 15)
    assert all(text[a : a + len(p)] == p and count(p) <= 100 for a, p in pieces)
    assert [a for a, _ in pieces] == sorted(a for a, _ in pieces)
    covered = set()
    for a, p in pieces:
        covered.update(range(a, a + len(p)))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert chunkers.split_recursively("", count, 100, 15) == []


def test_hierarchical_sections_and_oversized_ones(spark):
    small = "intro\n## A\ntext a\n### B\ntext b\n# not split\n#### C\nc"
    big = "## Big\n" + "Some sentence here.\n" * 900
    df = spark.createDataFrame([(1, small), (2, big), (3, "no headings"), (4, " \n")], "doc_id long, md string")
    rows = chunkers.hierarchical(df).collect()
    by = {d: sorted((r["char_start"], r["content"]) for r in rows if r["doc_id"] == d) for d in (1, 2, 3, 4)}
    assert [c for _, c in by[1]] == ["intro", "## A\ntext a", "### B\ntext b\n# not split", "#### C\nc"]
    assert all(small[a : a + len(c)] == c for a, c in by[1])
    assert len(by[2]) > 3 and all(big[a : a + len(c)] == c for a, c in by[2])
    assert [c for _, c in by[3]] == ["no headings"] and by[4] == []


def test_table_chunks_stay_whole(spark):
    df = spark.createDataFrame([(1, SMALL)], "doc_id long, md string")
    rows = chunkers.table_aware(corpus.parse(df), df).orderBy("char_start").collect()
    table = [r for r in rows if r["is_table"]]
    assert len(table) == 1 and "| a | 1 |\n| b | 2 |" in table[0]["content"] and table[0]["content"].startswith("## Tools")
    assert all("| a | 1 |" not in r["content"] for r in rows if not r["is_table"])


def test_adaptive_merges_alike_sentences_up_to_the_limit(spark):
    df = spark.createDataFrame([(1, "red cat sat. red cat sat. Nine ships sail far away.", "s")], "doc_id long, text string, source string")
    rows = chunkers.adaptive(df).orderBy("chunk_no").collect()
    assert [r["content"] for r in rows] == ["[s]\nred cat sat.\nred cat sat.", "[s]\nNine ships sail far away."]
    assert chunkers.adaptive(df, limit=5).count() == 3


def test_contextual_asks_once_for_equal_chunks(spark):
    chunks = spark.createDataFrame([("b", "1", "x"), ("b", "2", "x"), ("b", "3", "y")], "book string, chunk_id string, content string")
    key = F.substring(F.sha2(F.concat_ws(":", F.lit("b"), F.lit("y")), 256), 1, 12)
    cached = spark.range(1).select(key.alias("key"), F.lit("known").alias("prefix"))
    rows = {r["chunk_id"]: r["contextual_prefix"] for r in chunkers.contextual(chunks, lambda t: [f"on {x}" for x in t], cached).collect()}
    assert rows == {"1": "on x", "2": "on x", "3": "known"}


def test_unknown_strategies_are_refused():
    with pytest.raises(ValueError):
        chunkers.chunker("nope")
    assert set(chunkers.CHUNKERS) == {"recursive", "markdown_hierarchical", "contextual", "table_aware", "adaptive", "fixed_size"}


def test_sentences_keep_digits_and_lose_outer_blanks(spark):
    row = spark.createDataFrame([("0 at first. 148.9 next 1! 2 is last 2\n\n   \n\n a 4 ",)], ["text"]).select(X.sentences(F.col("text")).alias("s")).first()
    assert row["s"] == ["0 at first.", "148.9 next 1!", "2 is last 2", "a 4"]
