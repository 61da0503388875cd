"""Toxicity scoring with a counterfactually regularised linear classifier.

Features are the words of a text and their leading characters (so inflected forms share evidence): present,
repeated, or repeated densely. In labelled sentences that mention a group, the identity term is swapped for another of its list, and the
difference of the two scores is penalised, so that a neutral mention of a group moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import block_map, drop, flat_map, held_out, most_frequent, stored
from heronry.llm.sampling import labelled_texts

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5, 6)
#: Bounds: labelled documents to learn from, features of the model; documents that a feature must occur in.
MAX_DOCS, MAX_FEATURES, LEAST_DOCS = 12_000, 4_000, 4
#: A repeated feature is dense if it makes up one word in so many at least.
DENSE = 400
#: Identity terms; within a line they stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
)
MEMO = 400_000


def word_features(word: str) -> list[str]:
    """The word itself, and its prefixes marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def text_features(words: list[str], of=word_features) -> set[str]:
    """Features present; with ``+`` those that occur twice or more, with ``++`` those that do so densely."""
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        for f in of(w):
            counts[f] += n
    out = set(counts)
    for f, n in counts.items():
        if n > 1:
            out.add(f + "+")
            if n * DENSE >= len(words):
                out.add(f + "++")
    return out


def swaps(terms=IDENTITY_TERMS) -> dict[str, str]:
    """Each identity term's counterfactual: the next of its list, the first for the last."""
    return {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, with its numbers of documents of either label."""

    def factory():
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def rest():
            for f in {*counts[0], *counts[1]}:
                yield f, counts[0][f], counts[1][f]
            counts[0].clear()
            counts[1].clear()

        def kernel(text, label):
            counts[label].update(text_features(WORDS.findall((text or "").lower())))
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield from rest()

        return kernel, rest

    rows = flat_map(sample, ["text", "label"], "feature string, n0 long, n1 long", factory, 20_000)
    return rows.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(rows: list[np.ndarray], y: np.ndarray, swapped: list[tuple[np.ndarray, np.ndarray]], size: int, sparse: float = 5e-5, ridge: float = 1e-6, fair: float = 10.0, positive: float = 4.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for log loss + fair * mean(score change)^2 + ridge + sparse * |w|.

    Documents of label 1 weigh ``positive`` times as much as others, being few.

    ``rows`` are the features of each document, ``swapped`` those only in a sentence and only in its counterfactual.
    """
    n = len(y)
    if not n:
        return 0.0, np.zeros(size)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    m = len(swapped)
    s_owner = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(swapped)] or [np.zeros(0)]).astype(np.int64)
    s_cols = np.concatenate([np.concatenate((a, b)) for a, b in swapped] or [np.zeros(0)]).astype(np.int64)
    s_sign = np.concatenate([np.concatenate((np.ones(len(a)), -np.ones(len(b)))) for a, b in swapped] or [np.zeros(0)])
    widest = max([len(r) for r in rows], default=0)
    lipschitz = 0.25 * (1 + np.mean([len(r) for r in rows]) * 4 if widest else 1) + ridge + (2 * fair * np.bincount(s_owner).max() if m else 0)

    def gradient(w, b):
        z = b + np.bincount(owner, w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        r = (p - y) * share
        g = np.bincount(cols, r[owner], size) + ridge * w
        loss = float(share @ (np.logaddexp(0, z) - y * z)) + ridge / 2 * float(w @ w)
        if m:
            change = np.bincount(s_owner, s_sign * w[s_cols], m)
            g += 2 * fair / m * np.bincount(s_cols, s_sign * change[s_owner], size)
            loss += fair * float(np.mean(change**2))
        return loss, g, float(r.sum())

    share = np.where(y > 0, positive, 1.0)
    share /= share.sum()
    w, b = np.zeros(size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w.copy(), b, 1.0
    rate = 16.0 / lipschitz
    for _ in range(steps):
        loss, g, gb = gradient(vw, vb)
        while True:  # backtracking
            raw = vw - rate * g
            new = np.sign(raw) * np.maximum(np.abs(raw) - rate * sparse, 0)
            nb = vb - rate * gb
            dw, db = new - vw, nb - vb
            if gradient(new, nb)[0] <= loss + float(g @ dw) + gb * db + (float(dw @ dw) + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return b, w


def train(df: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, terms=IDENTITY_TERMS, fair: float = 10.0) -> ToxicityModel:
    """Learns from at most ``max_docs`` labelled documents that are not held out (crc32 mod 3 is 1).

    Features are the MAX_FEATURES that tell the labels apart best. Without documents of both labels every score is
    the share of label 1 (0.5 without any).
    """
    sample = stored(labelled_texts(df, labels, label, ~held_out(F.col(id_col), 3, 1), max_docs, id_col, text_col), "toxic")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        drop(sample)
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return ToxicityModel(float(np.log((share + 1e-3) / (1 - share + 1e-3))), {})
    counts = _feature_counts(sample).where(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) + F.lit(1e-9))
    scored = stored(counts.select("feature", F.floor(z * 10_000).alias("z")), "toxic-features")
    names = sorted(r["feature"] for r in most_frequent(scored, "z", MAX_FEATURES).collect())
    drop(scored)
    place = {f: i for i, f in enumerate(names)}
    shared = df.sparkSession.sparkContext.broadcast((place, swaps(terms)))

    def factory():
        place, other = shared.value

        def active(words) -> set[int]:
            return {place[f] for f in text_features(words) if f in place}

        def kernel(key, text, y):
            low = (text or "").lower()
            pairs = []
            if any(t in low for t in other):
                for sentence in SENTENCES.split(low):
                    words = WORDS.findall(sentence)
                    if other.keys() & words:
                        a, b = active(words), active([other.get(w, w) for w in words])
                        if a != b:
                            pairs.append({"gone": sorted(a - b), "come": sorted(b - a)})
            yield key, y, sorted(active(WORDS.findall(low))), pairs

        return kernel

    rows = flat_map(sample, ["id", "text", "label"], "id string, y int, x array<int>, pairs array<struct<gone: array<int>, come: array<int>>>", factory).toArrow()
    drop(sample)
    found = sorted(zip(rows.column("id").to_pylist(), rows.column("y").to_pylist(), rows.column("x").to_pylist(), rows.column("pairs").to_pylist()), key=lambda r: r[:3])
    swapped = [(np.array(p["gone"], np.int64), np.array(p["come"], np.int64)) for r in found for p in r[3]]
    bias, weights = fit([np.array(r[2], np.int64) for r in found], np.array([r[1] for r in found], float), swapped, len(names), fair=fair)
    return ToxicityModel(bias, {f: float(w) for f, w in zip(names, weights) if w})


class Scorer:
    """Scores texts; the features of each word once seen are kept in a bounded memo."""

    def __init__(self, model: ToxicityModel):
        self.model, self.memo = model, {}
        self.bases = {f.rstrip("+") for f in model.weights}

    def score(self, text: str | None) -> float:
        weights, memo, bases = self.model.weights, self.memo, self.bases
        words = WORDS.findall((text or "").lower())
        kinds = set(words)
        new = kinds.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = kinds
        for w in new:
            memo[w] = any(f in bases for f in word_features(w))
        telling = [w for w in words if memo[w]]
        features = text_features([*telling, *[""] * (len(words) - len(telling))], lambda w: [f for f in word_features(w) if f in bases] if w else ())
        total = self.model.bias + sum(weights.get(f, 0.0) for f in sorted(features))
        return float(1 / (1 + np.exp(-min(max(total, -40.0), 40.0))))


def classify(df: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every whole text; null texts count as empty. Each input row gives one row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def factory():
        scorer = Scorer(shared.value)
        return lambda keys, texts: ((k, s, int(s >= threshold)) for k, s in zip(keys, map(scorer.score, texts)))

    out = block_map(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int", factory)
    return out.select(id_col, held_out(F.col(id_col), 3, 1).alias("held_out"), "score", "predicted")
