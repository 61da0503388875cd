"""Markdown corpora: lines, nodes, profile, books and chapter paths.

Each row is a document of a book with its start in the book, so parsing is spread by document however large one
book is. Only the block structure (fences and table runs swallow what follows) runs as a Python kernel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from heronry.functions.text import normalize_title, token_count

NODE_SCHEMA = (
    "node_type string, level int, content string, raw_content string, char_start long, char_end long, "
    "header_row array<string>, align_row array<string>, body_rows array<array<string>>, info string"
)
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_HEADING_BREAK = re.compile(r"#{1,6}\s")
_RULE = re.compile(r"[\s|:\-]+\Z")
FENCES = ("```", "~~~")


def lines(df: DataFrame, text: str = "md") -> DataFrame:
    """One row for each line: line_no from 0, line, and its offset in code points."""
    rest = [c for c in df.columns if c != text]
    split = df.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def table_rows(raw: str) -> tuple[list[str], list[str] | None, list[list[str]]] | None:
    """Header, alignment row and body of a pipe table; None with fewer than two pipe lines."""
    rows = []
    for line in filter(lambda x: "|" in x, map(str.strip, raw.split("\n"))):
        cells = [c.strip() for c in line.split("|")]
        cells = cells[1:] if cells[0] == "" else cells
        rows.append((line, cells[:-1] if cells and cells[-1] == "" else cells))
    if len(rows) < 2:
        return None
    ruled = _RULE.match(rows[1][0]) is not None
    return rows[0][1], rows[1][1] if ruled else None, [cells for _, cells in rows[1 + ruled :]]


def is_table(raw: str) -> bool:
    """Two lines or more, two with a pipe or more, and more than half with one."""
    own = raw.strip().split("\n")
    pipes = sum("|" in x for x in own)
    return len(own) > 1 and pipes > 1 and 2 * pipes > len(own)


def blocks(text: str) -> Iterator[tuple]:
    """Nodes of a Markdown text, in order, as tuples of NODE_SCHEMA.

    A node ends where the line after it starts, so the last may end one past the text.
    """
    all_lines = text.split("\n")
    n = len(all_lines)
    kinds = []
    for line in all_lines:
        bare = line.strip()
        if _HEADING.match(line):
            kinds.append("heading")
        elif bare.startswith(FENCES):
            kinds.append("fence")
        elif bare.startswith("|"):
            kinds.append("pipe")
        else:
            kinds.append("text" if bare else "blank")
    starts = [0]
    for line in all_lines:
        starts.append(starts[-1] + len(line) + 1)

    def until(i: int, stop) -> int:
        return next((j for j in range(i, n) if stop(j)), n)

    i = 0
    while i < n:
        first = i
        if kinds[i] == "blank":
            i += 1
            continue
        if kinds[i] == "heading":
            marks, title = _HEADING.match(all_lines[i]).groups()
            i += 1
            yield "heading", len(marks), title.strip(), all_lines[first], starts[first], starts[i], None, None, None, None
            continue
        if kinds[i] == "fence":
            bare = all_lines[i].strip()
            i = min(n, until(i + 1, lambda j: all_lines[j].strip() == bare[:3]) + 1)
            raw = "\n".join(all_lines[first:i])
            yield "code_block", 0, raw, raw, starts[first], starts[i], None, None, None, bare[3:].strip()
            continue
        tabular = kinds[i] == "pipe"
        if tabular:  # up to a blank line or one without a pipe, whatever else the lines may be
            i = until(i, lambda j: "|" not in all_lines[j] or kinds[j] == "blank")
        else:
            i = until(i + 1, lambda j: kinds[j] in ("blank", "fence", "pipe") or _HEADING_BREAK.match(all_lines[j]) is not None)
        raw = "\n".join(all_lines[first:i])
        found = table_rows(raw) if tabular or is_table(raw) else None
        if found:
            yield "table", 0, raw, raw, starts[first], starts[i], *found, None
        else:
            yield "paragraph", 0, raw if tabular else raw.replace("\n", " ").strip(), raw, starts[first], starts[i], None, None, None, None


def parse(df: DataFrame, text: str = "md") -> DataFrame:
    """Nodes of every document; offsets count from the document's start. Null texts have none."""
    kind = df.schema["doc_id"].dataType.simpleString()
    out = T._parse_datatype_string(f"doc_id {kind}, node_no int, {NODE_SCHEMA}")
    arrow = to_arrow_schema(out)

    def task(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [(d, k, *node) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t is not None for k, node in enumerate(blocks(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select("doc_id", text).mapInArrow(task, out)


def profile(line_rows: DataFrame) -> DataFrame:
    """One row of corpus statistics for each book, from ``lines``.

    Tables are maximal runs of lines that start with a pipe; code is what lies between backtick fences.
    """
    here = Window.partitionBy("doc_id").orderBy("line_no")
    pipe = F.trim("line").startswith("|")
    fence = F.trim("line").startswith("```")
    heading = F.col("line").rlike(r"^#{1,6}\s+.+$")
    rows = line_rows.select(
        "book",
        F.length("line").alias("n"),
        (F.trim("line") == "").alias("empty"),
        heading.alias("heading"),
        pipe.alias("pipe"),
        (pipe & ~F.coalesce(F.lag(pipe).over(here), F.lit(False))).alias("table_start"),
        fence.alias("fence"),
        F.sum(fence.cast("int")).over(here).alias("fences"),
        F.col("line").rlike(r"^##\s+\*\*").alias("bold_h2"),
        token_count(F.col("line")).alias("tokens"),
    )
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("book").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.sum("n").alias("total_characters"),
        F.sum("tokens").cast("long").alias("total_tokens"),
        count(F.col("empty")).alias("empty_lines"),
        count(F.col("heading")).alias("headings"),
        count(F.col("table_start")).alias("table_count"),
        count(F.col("pipe")).alias("table_lines"),
        F.round(count(F.col("pipe")) / F.count(F.lit(1)), 4).alias("table_line_fraction"),
        count(F.col("fence") & (F.col("fences") % 2 == 1)).alias("code_blocks"),
        count(~F.col("fence") & (F.col("fences") % 2 == 1)).alias("code_lines"),
        count(F.col("bold_h2")).alias("bold_h2_headers"),
        F.round(F.avg("n"), 1).alias("avg_line_length"),
    )


def header_samples(line_rows: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` headings of each level and book, in order, with their numbers."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1))
    rows = line_rows.withColumn("level", level).where("level > 0")
    rank = F.row_number().over(Window.partitionBy("book", "level").orderBy("doc_id", "line_no"))
    total = F.count(F.lit(1)).over(Window.partitionBy("book", "level"))
    title = F.substring(F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)), 1, 100)
    return rows.select("book", "level", rank.alias("n"), "doc_id", "line_no", title.alias("title"), total.alias("level_total")).where(F.col("n") <= n)


def book_headings(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Headings with their place in the book: book, pos, level, content."""
    starts = docs.select("doc_id", "book", "start")
    return nodes.where("node_type = 'heading'").join(starts, "doc_id").select("book", (F.col("start") + F.col("char_start")).alias("pos"), "level", "content")


def detect_books(headings: DataFrame, manifest: DataFrame, corpus_end: int | None = None) -> DataFrame:
    """Books by matching manifest titles to level-2 headings.

    Titles, the longest first, take the earliest heading not taken whose normalised text contains them. The manifest
    bounds what reaches the driver: candidates of its titles only. Half-open spans end at the next book's start.
    """
    spark = headings.sparkSession
    titles = manifest.withColumn("norm", normalize_title(F.col("title"))).where("norm <> ''")
    h2 = headings.where("level = 2").withColumn("text", normalize_title(F.col("content")))
    rank = F.row_number().over(Window.partitionBy("title").orderBy("pos"))
    n_titles = titles.count()
    candidates = h2.join(F.broadcast(titles), F.contains("text", "norm")).withColumn("r", rank).where(F.col("r") <= n_titles)
    taken: dict[int, tuple[str, str]] = {}
    seen: set[str] = set()
    for row in sorted(candidates.collect(), key=lambda r: (-len(r["norm"]), r["title"], r["pos"])):
        if row["title"] not in seen and row["pos"] not in taken:
            seen.add(row["title"])
            taken[row["pos"]] = (row["title"], row["content"])
    starts = sorted(taken)
    rows = [(taken[p][0], i, p, starts[i + 1] if i + 1 < len(starts) else corpus_end, taken[p][1]) for i, p in enumerate(starts)]
    return spark.createDataFrame(rows, "book_title string, book_index int, start_offset long, end_offset long, h2_header_text string")


def unmatched(headings: DataFrame, books: DataFrame) -> DataFrame:
    """Level-2 headings that no book starts at."""
    return headings.where("level = 2").join(F.broadcast(books.select(F.col("start_offset").alias("pos"))), "pos", "left_anti")


def book_for_offset(offsets: DataFrame, books: DataFrame, pos: str = "pos") -> DataFrame:
    """The first book whose half-open span holds the offset; null outside all. The manifest bounds ``books``."""
    spans = books.select("book_title", "book_index", "start_offset", "end_offset")
    inside = (F.col(pos) >= F.col("start_offset")) & (F.col("end_offset").isNull() | (F.col(pos) < F.col("end_offset")))
    return offsets.join(F.broadcast(spans), inside, "left").drop("start_offset", "end_offset")


def chapter_paths(headings: DataFrame, points: DataFrame, max_depth: int = 4) -> DataFrame:
    """Chapter paths of points (book, pos): for levels 2 to ``max_depth`` the nearest heading at or before.

    Levels are independent of each other, so a deeper heading of an earlier section stays until it is replaced.
    An as-of join: one pass over headings and points by position, headings first on ties.
    """
    marks = headings.select("book", "pos", F.lit(0).alias("kind"), "level", "content", F.lit(None).cast("long").alias("point_id"))
    asked = points.select("book", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("content"), "point_id")
    order = Window.partitionBy("book").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    levels = [F.last(F.when(F.col("level") == k, F.col("content")), ignorenulls=True).over(order).alias(f"h{k}") for k in range(2, max_depth + 1)]
    found = marks.unionByName(asked).select("book", "pos", "kind", "point_id", *levels).where("kind = 1")
    return found.select("book", "pos", "point_id", F.array_compact(F.array(*[f"h{k}" for k in range(2, max_depth + 1)])).alias("chapter_path"))
