"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, n long, tile int, label int"

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix bright potions under silver moons and nobody minds at all".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang if i % 5 else None, "s", len(t or ""), 0.5, 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark):
    """Two rows for id 1, alike; a null id; null, empty and blank texts; one very long text."""
    texts = [prose(1, 60), prose(2, 40), None, "", " \n\t ", prose(3, 60_000), "x" * 50_000, "ünï côdé 😀 漢字 <|endoftext|> tail", prose(1, 60)]
    df = documents(spark, texts)
    more = spark.createDataFrame([(1, texts[1], "en", "s", 1, 0.5, 1, 2, 3, 4), (None, prose(9, 30), None, None, None, None, None, None, None, None)], DOCS)
    return df.unionByName(more)
