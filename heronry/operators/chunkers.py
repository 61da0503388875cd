"""Chunking strategies. Offsets are exact: they come from prefix sums, not from searching for a chunk's head."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import chunk_id, cosine, hashed_embedding, pipe_count, search_terms, sentences, token_count, tokens, truncate_to_tokens


def with_metadata(chunks: DataFrame, strategy: str) -> DataFrame:
    """Adds id, counts and flags to chunks (content, char_start): a table is assumed from five pipes on."""
    content = F.col("content")
    rows = chunks.withColumn("strategy", F.lit(strategy)).withColumn("token_count", token_count(content)).withColumn("char_end", F.col("char_start") + F.length("content"))
    if "is_table" not in chunks.columns:
        rows = rows.withColumn("is_table", F.lit(False))
    rows = rows.withColumn("contains_table", F.col("is_table") | (pipe_count(content) > 4)).withColumn("contains_code", F.contains(content, F.lit("```")))
    return rows.withColumn("chunk_id", chunk_id(F.col("strategy"), content, F.col("char_start")))


def _before(lengths: str, n: Column) -> Column:
    """The sum of the first n lengths: texts are measured once, not joined again for every chunk."""
    return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s + x)


def fixed_size(docs: DataFrame, size: int = 512, overlap: int = 64, text: str = "text") -> DataFrame:
    """Windows of ``size`` tokens, stepping on while any token is left (so a short tail repeats within the last)."""
    step = size - overlap
    rows = docs.withColumn("_t", tokens(F.col(text))).where("size(_t) > 0").withColumn("_p", F.sequence(F.lit(0), F.size("_t") - 1, F.lit(step)))
    rows = rows.withColumn("_l", F.transform("_p", lambda p: F.length(F.array_join(F.slice("_t", p + 1, F.lit(step)), "")).cast("long")))
    rows = rows.select(*docs.columns, "_t", "_l", F.posexplode("_p").alias("chunk_no", "_p"))
    rows = rows.select(*[c for c in docs.columns if c != text], "chunk_no", F.array_join(F.slice("_t", F.col("_p") + 1, F.lit(size)), "").alias("content"), _before("_l", F.col("chunk_no")).alias("char_start"))
    return with_metadata(rows, "fixed_size")


SEPARATORS = ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ", "")


def split_recursively(text: str, count: Callable[[str], int], size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, piece): the first separator present cuts the text and stays at the head of what follows; pieces are merged
    up to ``size`` with a tail of at most ``overlap`` carried on; pieces still too large are cut by the next one."""

    def cut(start: int, end: int, level: int) -> list[tuple[int, int]]:
        part = text[start:end]
        while level < len(separators) - 1 and separators[level] and separators[level] not in part[1:]:
            level += 1
        mark = separators[level]
        if not mark:
            edges = list(range(start, end))
        else:
            edges, at = [start], part.find(mark, 1)
            while at >= 0:
                edges.append(start + at)
                at = part.find(mark, at + len(mark))
        spans = list(zip(edges, [*edges[1:], end]))
        out: list[tuple[int, int]] = []
        held: list[tuple[int, int, int]] = []  # start, end, tokens
        total = 0

        def flush():
            if held:
                out.append((held[0][0], held[-1][1]))

        for a, b in spans:
            n = count(text[a:b])
            if n > size and mark:
                flush()
                held, total = [], 0
                out.extend(cut(a, b, level + 1))
                continue
            if total + n > size and held:
                flush()
                while held and (total > overlap or total + n > size):
                    total -= held.pop(0)[2]
            held.append((a, b, n))
            total += n
        flush()
        return out

    found = []
    for a, b in cut(0, len(text), 0) if text else []:
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            found.append((a + lead, piece.strip()))
    return found


def recursive(docs: DataFrame, size: int = 512, overlap: int = 77, text: str = "text", strategy: str = "recursive", separators: tuple[str, ...] = SEPARATORS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Recursive splitting, by document; a kernel, because pieces are merged in order."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    held = ["doc_id", *keep]

    def task(batches):
        import regex

        from heronry.functions.text import TOKEN_PATTERN

        count = regex.compile(TOKEN_PATTERN)
        for batch in batches:
            for row in range(batch.num_rows):
                values = [batch.column(i)[row].as_py() for i in range(len(held))]
                body = batch.column(len(held))[row].as_py()
                found = split_recursively(body or "", lambda s: len(count.findall(s)), size, overlap, separators)
                if found:
                    columns = [pa.array([v] * len(found), batch.schema.field(i).type) for i, v in enumerate(values)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(found)), pa.int32()), pa.array([p for _, p in found]), pa.array([a for a, _ in found], pa.int64())], names=[*held, "chunk_no", "content", "char_start"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in held) + ", chunk_no int, content string, char_start long"
    return with_metadata(docs.select(*held, text).mapInArrow(task, schema), strategy)


def hierarchical(docs: DataFrame, limit: int = 2000, text: str = "md") -> DataFrame:
    """Sections from level-2 to level-4 headings; text before the first counts if not blank; oversized ones are split again."""
    body = F.col(text)
    marked = F.regexp_replace(body, r"(?m)^(?=#{2,4}\s)", "\u001e")
    parts = F.filter(F.transform(F.split(marked, "\u001e"), lambda s: s), lambda s: s != "")
    rows = docs.withColumn("_s", parts).withColumn("_l", F.transform("_s", lambda s: F.length(s).cast("long"))).select("doc_id", "_l", F.posexplode("_s").alias("section_no", "section"))
    start = _before("_l", F.col("section_no"))
    rows = rows.select("doc_id", "section_no", "section", start.alias("start")).where("trim(translate(section, '\n\t', '')) <> ''").withColumn("_n", token_count(F.col("section")))
    lead = F.length("section") - F.length(F.regexp_replace("section", r"^\s+", ""))
    small = rows.where(F.col("_n") <= limit).select("doc_id", F.regexp_replace("section", r"^\s+|\s+$", "").alias("content"), (F.col("start") + lead).alias("char_start"))
    small = with_metadata(small, "markdown_hierarchical")
    large = recursive(rows.where(F.col("_n") > limit), text="section", strategy="markdown_hierarchical", separators=("\n\n", "\n", " ", ""), keep=("start",))
    shift = lambda c: (F.col("start") + F.col(c)).alias(c)
    large = large.select(*[shift(c) if c in ("char_start", "char_end") else F.col(c) for c in large.columns if c not in ("start", "chunk_no", "chunk_id")])
    large = large.withColumn("chunk_id", chunk_id(F.col("strategy"), F.col("content"), F.col("char_start")))
    return small.unionByName(large.select(small.columns))


def table_chunks(nodes: DataFrame, docs: DataFrame, context_tokens: int = 200, text: str = "md") -> DataFrame:
    """Each table as one chunk, behind the first ``context_tokens`` of the 1000 characters before it (its last ten lines if more)."""
    rows = nodes.where("node_type = 'table'").join(docs.select("doc_id", text), "doc_id")
    begin = F.greatest(F.lit(0), F.col("char_start") - 1000)
    before = F.regexp_replace(F.substring(F.col(text), (begin + 1).cast("int"), (F.col("char_start") - begin).cast("int")), r"^\s+|\s+$", "")
    cut = truncate_to_tokens(before, context_tokens)
    parts = F.split(cut, "\n")
    context = F.when(F.size(parts) > 10, F.array_join(F.slice(parts, -10, 10), "\n")).otherwise(cut)
    rows = rows.select("doc_id", F.when(context != "", F.concat(context, F.lit("\n\n"), F.col("raw_content"))).otherwise(F.col("raw_content")).alias("content"), "char_start", F.col("char_end").alias("_end"), F.lit(True).alias("is_table"))
    return with_metadata(rows, "table_aware").withColumn("char_end", F.col("_end")).drop("_end")


def table_aware(nodes: DataFrame, docs: DataFrame, text: str = "md") -> DataFrame:
    """Tables as atomic chunks, the rest split recursively between them."""
    tables = table_chunks(nodes, docs, text=text)
    order = Window.partitionBy("doc_id").orderBy("a")
    spans = nodes.where("node_type = 'table'").select("doc_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    ends = docs.select("doc_id", F.length(text).cast("long").alias("a"), F.length(text).cast("long").alias("b"))
    gaps = spans.unionByName(ends).withColumn("from", F.coalesce(F.lag("b").over(order), F.lit(0))).where("a > from")
    rest = gaps.join(docs.select("doc_id", text), "doc_id").select("doc_id", F.col("from").alias("start"), F.substring(F.col(text), (F.col("from") + 1).cast("int"), (F.col("a") - F.col("from")).cast("int")).alias("body"))
    split = recursive(rest, text="body", strategy="table_aware", keep=("start",))
    split = split.withColumn("char_start", F.col("start") + F.col("char_start")).withColumn("char_end", F.col("start") + F.col("char_end"))
    split = split.withColumn("chunk_id", chunk_id(F.col("strategy"), F.col("content"), F.col("char_start")))
    return tables.unionByName(split.select(tables.columns))


def adaptive(docs: DataFrame, threshold: float = 0.75, limit: int = 512, text: str = "text", book: str = "source", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Neighbouring sentences are merged while they are alike and the chunk stays under ``limit`` tokens.

    ``embed`` maps a sentence to a vector (the hashed bag of words by default). The fold over the sentences of a
    document is sequential: each decision needs the size of the chunk so far.
    """
    embed = embed or (lambda s: hashed_embedding(search_terms(s)))
    rows = docs.select("doc_id", book, F.posexplode(sentences(F.col(text))).alias("n", "sentence"))
    rows = rows.withColumn("vector", embed(F.col("sentence"))).withColumn("tokens", token_count(F.col("sentence")))
    here = Window.partitionBy("doc_id").orderBy("n")
    rows = rows.withColumn("alike", F.coalesce(cosine(F.lag("vector").over(here), F.col("vector")) > threshold, F.lit(False)))
    fold = F.aggregate(
        "steps",
        F.struct(F.lit(-1).alias("group"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("groups")),
        lambda s, x: F.when(
            x["alike"] & (s["size"] + x["tokens"] < limit),
            F.struct(s["group"].alias("group"), (s["size"] + x["tokens"]).alias("size"), F.concat(s["groups"], F.array(s["group"])).alias("groups")),
        ).otherwise(F.struct((s["group"] + 1).alias("group"), x["tokens"].alias("size"), F.concat(s["groups"], F.array(s["group"] + 1)).alias("groups"))),
        lambda s: s["groups"],
    )
    steps = rows.groupBy("doc_id", book).agg(F.sort_array(F.collect_list(F.struct("n", "sentence", "tokens", "alike"))).alias("steps")).withColumn("groups", fold)
    each = steps.select("doc_id", book, F.explode(F.arrays_zip("steps", "groups")).alias("x")).select("doc_id", book, F.col("x.groups").alias("chunk_no"), F.col("x.steps.n").alias("n"), F.col("x.steps.sentence").alias("sentence"))
    merged = each.groupBy("doc_id", book, "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]), "\n").alias("body"))
    return merged.select("doc_id", "chunk_no", F.concat(F.lit("["), F.col(book), F.lit("]\n"), F.col("body")).alias("content"), token_count(F.col("body")).alias("body_tokens"))


def contextual(chunks: DataFrame, describe: Callable[[list[str]], list[str]], cached: DataFrame | None = None) -> DataFrame:
    """Chunks with a description in ``contextual_prefix``, from ``cached`` (key, prefix) or else from the client.

    Keys are book and content, so equal chunks of a book are described once.
    """
    rows = chunks.withColumn("strategy", F.lit("contextual")).withColumn("key", F.substring(F.sha2(F.concat_ws(":", F.col("book"), F.col("content")), 256), 1, 12))
    asked = rows.select("key", "content").dropDuplicates(["key"])
    if cached is not None:
        asked = asked.join(cached, "key", "left_anti")

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(describe(batch.column(1).to_pylist()), pa.string())], names=["key", "contextual_prefix"])

    known = asked.mapInArrow(task, "key string, contextual_prefix string")
    if cached is not None:
        known = known.unionByName(cached.select("key", F.col("prefix").alias("contextual_prefix")))
    return rows.join(known, "key", "left").drop("key")


CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "recursive": recursive,
    "markdown_hierarchical": hierarchical,
    "contextual": contextual,
    "table_aware": table_aware,
    "adaptive": adaptive,
    "fixed_size": fixed_size,
}


def chunker(name: str) -> Callable[..., DataFrame]:
    """A strategy by name."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy {name!r}; known: {', '.join(CHUNKERS)}")
    return CHUNKERS[name]
