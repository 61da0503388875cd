"""Language identification with word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to the mean over its longest
known character n-grams: from five characters, boundaries included, to ever shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import block_map, drop, flat_map, held_out, most_frequent, stored
from heronry.llm.sampling import hash_sample

WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Bounds of the model and of its training sample.
MAX_DOCS, MAX_WORDS, MAX_GRAMS = 6_000, 40_000, 60_000
#: Evidence is weighed as if it came from at most this many words, so long texts do not all score exactly 1.
EVIDENCE = 25.0
MEMO = 150_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    tables: list[dict[str, int]]  # words, then n-grams by length; each gives a row of ``scores``
    scores: np.ndarray  # log frequencies by language
    floor: np.ndarray  # of a word of which nothing is known


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks."""
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for w in WORDS.finditer(text or "") for c in w.group())


def _training_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """kind (0: words, n: n-grams), gram, lang, n."""

    def factory():
        counts: dict[str, Counter] = {}
        size = 0

        def rest():
            nonlocal size
            for lang, words in counts.items():
                parts: Counter = Counter()
                for w, c in words.items():
                    yield 0, w, lang, c
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            parts[n, g] += c
                for (n, g), c in parts.items():
                    yield n, g, lang, c
            counts.clear()
            size = 0

        def kernel(text, lang):
            nonlocal size
            own = counts.setdefault(lang, Counter())
            before = len(own)
            own.update(WORDS.findall((text or "").lower()))
            size += len(own) - before
            if size > 100_000:
                yield from rest()

        return kernel, rest

    rows = flat_map(df, [text_col, lang_col], "kind int, gram string, lang string, n long", factory, 20_000)
    return rows.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Learns from texts with a language that are not held out: a sample of ``max_docs`` at most.

    The model has the ``max_words`` most frequent words and as many n-grams as ``max_grams`` says, so its size does
    not depend on the corpus. Without any such text it has no languages.
    """
    known = df.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    counts = stored(_training_counts(hash_sample(known, id_col, max_docs), text_col, lang_col), "lang")
    totals = {(r["kind"], r["lang"]): (r["n"], r["kinds"]) for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    languages = sorted({lang for _, lang in totals})
    place = {lang: i for i, lang in enumerate(languages)}
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    rows: list[np.ndarray] = []

    def base(kind: int) -> np.ndarray:
        vocabulary = max([1, *(totals.get((kind, g), (0, 0))[1] for g in languages)])
        return np.array([totals.get((kind, g), (0, 0))[0] + 0.5 * vocabulary for g in languages])

    for where, most in (("kind = 0 and n > 1", max_words), ("kind > 0", max_grams)):
        grouped = stored(counts.where(where).groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by")), "grams")
        top = most_frequent(grouped, "n", most)
        sizes = {k: base(k) for k in range(LONGEST + 1)}
        for batch in top.select("kind", "gram", "by").toArrow().to_batches(2048):
            for kind, gram, by in zip(*(c.to_pylist() for c in batch.columns)):
                row = np.full(len(languages), 0.5)
                for x in by:
                    row[place[x["lang"]]] += x["n"]
                tables[kind][gram] = len(rows)
                rows.append(np.log(row / sizes[kind]))
        drop(grouped)
    drop(counts)
    scores = np.array(rows) if rows else np.zeros((0, len(languages)))
    return LanguageModel(languages, tables, scores, np.zeros(len(languages)))


class Scorer:
    """Scores texts by a model; words once scored are kept in a bounded memo."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._reset()

    def _reset(self):
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def word(self, word: str) -> np.ndarray:
        """Word-first backoff."""
        tables, scores = self.model.tables, self.model.scores
        at = tables[0].get(word)
        if at is not None:
            return scores[at]
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = tables[n]
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return scores[found].mean(axis=0)
        return self.model.floor

    def _learn(self, new: set[str], kinds: set[str]) -> None:
        if len(self.memo) + len(new) > MEMO:
            self._reset()
            new = kinds
        for w in new:
            k = len(self.memo)
            if k == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[k] = self.word(w)
            self.memo[w] = k

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the evidence; ``und`` and 0 for texts without letters."""
        words = WORDS.findall((text or "").lower())
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        kinds = set(words)
        self._learn(kinds.difference(self.memo), kinds)
        mean = self.rows[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))].mean(axis=0)
        logits = mean * min(EVIDENCE, len(words))
        share = np.exp(logits - logits.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language was
    learned. A tie goes to the language that sorts first. Each input row gives one row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def factory():
        scorer = Scorer(shared.value)
        return lambda keys, texts: ((k, *scorer.predict(t)) for k, t in zip(keys, texts))

    out = block_map(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double", factory)
    return out.select(id_col, held_out(F.col(id_col), 3, 1).alias("held_out"), "lang_pred", "score")


def accepted(df: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text has a language with a score of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def factory():
        scorer = Scorer(shared.value)

        def kernel(*columns):
            for row in zip(*columns):
                lang, score = scorer.predict(row[at])
                if lang != UNKNOWN and score >= least:
                    yield row

        return kernel

    return block_map(df, names, schema, factory, 256)
