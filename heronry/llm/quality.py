"""Quality classification by histogram gradient-boosted trees over document statistics.

Trees are complete binary trees flattened into arrays, so a block of documents goes down all trees together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import block_map, flat_map, held_out
from heronry.llm.sampling import labelled_texts

#: Labelled documents that the trees are fitted on at most.
MAX_DOCS = 12_000
FEATURES = (
    "log_chars", "log_words", "unique_words", "word_length", "longest_word", "repeated_next", "ascii_upper", "digits", "blanks", "line_breaks", "periods", "commas", "exclamations", "bars",
    "noise", "quotes", "other_punctuation", "non_ascii", "control", "byte_entropy", "unique_lines", "line_length", "top_bytes", "unique_pairs",
)


def _share(of: bytes) -> np.ndarray:
    return np.array([b in of for b in range(256)])


_UPPER, _LOWER, _DIGIT = _share(bytes(range(65, 91))), _share(bytes(range(97, 123))), _share(b"0123456789")
_NOISE, _QUOTES, _OTHER = _share(b"#$%&*@^~"), _share(b"\"'`"), _share(b"()[]{}<>/\\+=_-:;?")
_WIDE, _CONTROL = np.arange(256) >= 128, np.arange(256) < 9


def statistics(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES; zeros for null and empty texts."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = len(raw), text.split()
    nw = max(1, len(words))
    share = counts[counts > 0] / n
    lines = text.split("\n")
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        len(set(words)) / nw,
        sum(map(len, words)) / nw,
        math.log1p(max(map(len, words), default=0)),
        sum(map(eq, words, words[1:])) / nw,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[32] / n,
        counts[10] / nw,
        counts[46] / nw,
        counts[44] / nw,
        counts[33] / nw,
        counts[124] / nw,
        counts[_NOISE].sum() / nw,
        counts[_QUOTES].sum() / nw,
        counts[_OTHER].sum() / nw,
        counts[_WIDE].sum() / n,
        counts[_CONTROL].sum() / n,
        float(-(share @ np.log2(share))),
        len(set(lines)) / len(lines),
        math.log1p(len(text) / len(lines)),
        float(np.sort(share)[-5:].sum()),
        len(set(zip(words, words[1:]))) / nw,
    ]


@dataclass
class Trees:
    """feature and threshold by tree and inner node, value by tree and leaf; a row goes right if above."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for a block of rows: all trees go down a level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            above = np.take_along_axis(x, self.feature[trees, node], axis=1) > self.threshold[trees, node]
            node = 2 * node + 1 + above
        total = self.base + self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over binned features.

    Without rows the score is 0.5; with one label only, it is close to that label.
    """
    inner = (1 << depth) - 1
    model = Trees(0.0, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y):
        return model
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model.base = math.log(mean / (1 - mean))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin b: at most cut b
    nf = x.shape[1]
    flat = binned + np.arange(nf) * bins
    total = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            key = ((node - first)[:, None] * (nf * bins) + flat).ravel()
            size = width * nf * bins
            sg = np.bincount(key, np.repeat(g, nf), size).reshape(width, nf, bins).cumsum(axis=2)
            sh = np.bincount(key, np.repeat(h, nf), size).reshape(width, nf, bins).cumsum(axis=2)
            gt, ht = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg**2 / (sh + ridge) + (gt - sg) ** 2 / (ht - sh + ridge) - gt**2 / (ht + ridge)
            gain[(sh < least) | (ht - sh < least)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    model.feature[t, first + k], model.threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        sg, sh = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        model.value[t] = -rate * sg / (sh + ridge)
        total = total + model.value[t][leaf]
    return model


def train(df: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> Trees:
    """Fits the trees on at most ``max_docs`` labelled documents that are not held out (crc32 mod 5 is 0)."""
    sample = labelled_texts(df, labels, label, ~held_out(F.col(id_col), 5, 0), max_docs, id_col, text_col)

    def factory():
        return lambda key, text, y: ((key, y, statistics(text)),)

    rows = flat_map(sample, ["id", "text", "label"], "id string, label int, x array<double>", factory).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist()).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y])  # the same trees whatever the order of rows
    return fit(x[order], y[order])


def classify(df: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every whole text; null texts count as empty. Each input row gives one row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        trees = shared.value

        def kernel(keys, texts):
            scores = trees.score(np.array([statistics(t) for t in texts])).tolist()
            return ((k, s, int(s >= threshold)) for k, s in zip(keys, scores))

        return kernel

    out = block_map(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int", factory)
    return out.select(id_col, held_out(F.col(id_col), 5, 0).alias("held_out"), "score", "predicted")


def accepted(df: DataFrame, model: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text scores ``threshold`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def factory():
        trees = shared.value

        def kernel(*columns):
            scores = trees.score(np.array([statistics(t) for t in columns[at]]))
            return (row for row, s in zip(zip(*columns), scores) if s >= threshold)

        return kernel

    return block_map(df, names, schema, factory, 256)
