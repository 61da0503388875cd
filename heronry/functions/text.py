"""Column functions on text: tokens, keys, flags and parsing. All but the embedding stay in the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A lossless split: joined, the pieces restore the text.
TOKEN_PATTERN = r"\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])|\s+$"
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """The surrogate tokenisation; counts are not those of any model's vocabulary."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def truncate_to_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), "")


def search_terms(text: Column) -> Column:
    """Lower-cased words, for index and query alike."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def sentences(text: Column) -> Column:
    """Split after closing punctuation and at blank lines; stripped, empty ones dropped."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n\n+")
    # A function of two parameters would get the index too, and trim its digits in place of spaces.
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def chunk_id(strategy: Column, content: Column, char_start: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", strategy, content, char_start.cast("string"))), 1, 16)


def pipe_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def parse_score(reply: Column) -> Column:
    """A labelled score, else the first number, clamped to [0, 1]; 0 without any."""
    labelled = F.regexp_extract(reply, r"(?i)SCORE\s*:\s*([0-9.]+)", 1)
    first = F.regexp_extract(reply, r"([0-9]*\.?[0-9]+)", 1)
    raw = F.when(labelled != "", labelled).otherwise(first)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))


def parse_review_flag(value: Column) -> Column:
    """1 for approval, 0 for rejection, null for anything else."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "y", "yes", "true", "approve", "a"), 1).when(low.isin("0", "n", "no", "false", "reject", "r"), 0)


def extract_json(reply: Column, schema: str) -> Column:
    """JSON from a model's reply, with or without a code fence; null if malformed."""
    return F.from_json(F.trim(F.regexp_replace(F.regexp_replace(reply, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")), schema)


def snippet(text: Column, n: int = 500) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def normalize_title(title: Column) -> Column:
    """Folds a title for matching: case, emphasis, typographic marks and punctuation (NFKC is left to the source)."""
    low = F.translate(F.lower(F.trim(title)), "�®™©", "")
    low = F.regexp_replace(low, r"[*_`]+", " ")
    low = F.translate(low, "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def looks_like_table(text: Column) -> Column:
    """Two lines or more, two with a pipe or more, and more than half with one."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    pipes = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|"))))
    return (F.size(lines) >= 2) & (pipes >= 2) & (pipes * 2 > F.size(lines))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def hashed_embedding(words: Column, size: int = 64) -> Column:
    """Bag of words in ``size`` md5 buckets, not normalised: the deterministic stand-in for an embedding model.

    By Arrow batches: each word is hashed once a batch, and buckets are counted for all rows at once. Null is no words.
    """

    @F.arrow_udf("array<double>")
    def embed(words: pa.Array) -> pa.Array:
        n = len(words)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
        codes = words.flatten().dictionary_encode()
        of = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % size for w in codes.dictionary.to_pylist()], np.int64)
        places = np.repeat(np.arange(n) * size, lengths) + of[np.asarray(codes.indices)]
        counts = np.bincount(places, minlength=n * size).astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(counts))

    return embed(words)
