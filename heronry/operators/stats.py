"""Statistics over results: bootstrap intervals, paired tests, corrections and agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, SEED = 10_000, 42


def bootstrap_ci(df: DataFrame, value: str = "value", key: str = "system", resamples: int = RESAMPLES, seed: int = SEED, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of the mean by system, with NumPy's legacy generator drawn once a resample.

    Values are ordered by value, so the result does not depend on how rows are spread.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].dropna().to_numpy(float))
        if not len(v):
            return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [0.0], "lower": [0.0], "upper": [0.0], "std": [0.0], "n": [0]})
        rng = np.random.RandomState(seed)
        means = np.array([rng.choice(v, size=len(v), replace=True).mean() for _ in range(resamples)])
        tail = (1 - confidence) / 2 * 100
        lower, upper = np.percentile(means, [tail, 100 - tail])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [v.mean()], "lower": [lower], "upper": [upper], "std": [v.std()], "n": [len(v)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value).groupBy(key).applyInPandas(one, f"{key} {kind}, mean double, lower double, upper double, std double, n long")


def hashed_bootstrap_ci(df: DataFrame, value: str = "value", key: str = "system", item: str = "item", resamples: int = 200, confidence: float = 0.95) -> DataFrame:
    """The same without a kernel or a group in one task: Poisson resampling by hash.

    Each row draws its number of copies in each resample from a hash of the row and the resample, so partial sums
    are merged before the shuffle and groups of any size work.
    """
    u = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key), F.col(item).cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) / 1_000_000.0
    cuts, p, total = [], float(np.exp(-1)), 0.0
    for n in range(1, 8):  # the distribution function of a Poisson variable of mean 1
        total += p
        cuts.append(total)
        p /= n
    copies = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.select(key, item, value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("w", copies)
    means = rows.groupBy(key, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    return means.groupBy(key).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", tail), 6).alias("lower"), F.round(F.percentile("m", 1 - tail), 6).alias("upper"))


def paired_bootstrap(df: DataFrame, pair: str = "pair", a: str = "a", b: str = "b", resamples: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """One-sided paired test of mean(a) > mean(b): p is the share of resampled differences at or below 0."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("item")
        x, y = d[a].to_numpy(float), d[b].to_numpy(float)
        rng = np.random.RandomState(seed)
        n = len(x)
        diffs = np.empty(resamples)
        for i in range(resamples):
            at = rng.choice(n, size=n, replace=True)
            diffs[i] = x[at].mean() - y[at].mean()
        lower, upper = np.percentile(diffs, [2.5, 97.5])
        p = float((diffs <= 0).mean())
        return pd.DataFrame({pair: [pdf[pair].iloc[0]], "diff": [x.mean() - y.mean()], "p_value": [p], "lower": [lower], "upper": [upper], "significant": [p < alpha], "n": [n]})

    kind = df.schema[pair].dataType.simpleString()
    return df.select(pair, "item", a, b).groupBy(pair).applyInPandas(one, f"{pair} {kind}, diff double, p_value double, lower double, upper double, significant boolean, n long")


def holm(df: DataFrame, p: str = "p_value", key: str = "comparison", alpha: float = 0.05) -> DataFrame:
    """Thresholds alpha / (m - i) by ascending p; each comparison is judged by its own, without stopping.

    The comparisons are pairs of systems, a few rows, so one window over all of them is fine.
    """
    order = Window.orderBy(p, key)
    i, m = F.row_number().over(order) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    rows = df.select(key, p, i.alias("i"), (F.lit(alpha) / (m - i)).alias("threshold"))
    return rows.select(key, p, "threshold", (F.col(p) < F.col("threshold")).alias("significant"))


def pairs(df: DataFrame, system: str = "system", item: str = "item", value: str = "value") -> DataFrame:
    """Values of two systems on the same item, for every pair of systems in order: pair, item, a, b."""
    left = df.select(F.col(system).alias("sa"), item, F.col(value).alias("a"))
    right = df.select(F.col(system).alias("sb"), item, F.col(value).alias("b"))
    return left.join(right, item).where("sa < sb").select(F.concat_ws(" vs ", "sa", "sb").alias("pair"), F.col(item).alias("item"), "a", "b")


def pairwise(df: DataFrame, system: str = "system", item: str = "item", value: str = "value", **options) -> DataFrame:
    """Paired bootstrap over all pairs of systems, with Holm's correction."""
    tested = paired_bootstrap(pairs(df, system, item, value), **options)
    return tested.drop("significant").join(holm(tested.withColumnRenamed("pair", "comparison")).select(F.col("comparison").alias("pair"), "threshold", "significant"), "pair")


def judge_variance(df: DataFrame, trial: str = "trial", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of the means of trials."""
    return df.groupBy(*keys, trial).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("m").alias("trials"))


def cohen_kappa(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Agreement of two binary raters: 0 without rows, 1 if chance agreement is certain."""
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.when(F.col("n") == 0, 0.0).when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))
