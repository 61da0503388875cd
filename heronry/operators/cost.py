"""Costs, budgets, caches and run logs of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: USD per million tokens, input and output.
PRICES = (
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
    ("gpt-4o", 2.50, 10.0),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4.1", 2.0, 8.0),
    ("gpt-4.1-mini", 0.40, 1.60),
    ("gpt-4.1-nano", 0.10, 0.40),
    ("o1", 15.0, 60.0),
    ("o3-mini", 1.10, 4.40),
    ("claude-sonnet-4-5-20241022", 3.0, 15.0),
    ("claude-sonnet-4-5-20241022-cached", 0.30, 15.0),
)
#: USD allowed by stage.
BUDGETS = {"goldset": 10.0, "phase1": 10.0, "phase2": 50.0, "phase3": 20.0, "contextual": 15.0, "total": 100.0}


class BudgetExceeded(RuntimeError):
    pass


def priced(calls: DataFrame) -> DataFrame:
    """Calls with ``cost_usd``: cached calls by the cached rate where there is one; unknown models cost nothing."""
    rates = F.broadcast(calls.sparkSession.createDataFrame(PRICES, "rate_model string, rate_in double, rate_out double"))
    cached = rates.select(F.col("rate_model").alias("cached_model"), F.col("rate_in").alias("cached_in"), F.col("rate_out").alias("cached_out"))
    rows = calls.join(rates, F.col("model") == F.col("rate_model"), "left").join(cached, F.col("cached") & (F.concat("model", F.lit("-cached")) == F.col("cached_model")), "left")
    cost = F.col("input_tokens") / 1e6 * F.coalesce("cached_in", "rate_in", F.lit(0.0)) + F.col("output_tokens") / 1e6 * F.coalesce("cached_out", "rate_out", F.lit(0.0))
    return rows.select(*calls.columns, cost.alias("cost_usd"))


def by(calls: DataFrame, key: str) -> DataFrame:
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def over_budget(calls: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """stage, spent, budget, exceeded: strictly more than the budget; stages without one are not limited."""
    limits = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    spent = calls.groupBy("stage").agg(F.sum("cost_usd").alias("spent")).withColumn("budget", F.try_element_at(limits, F.col("stage")))
    return spent.select("stage", F.round("spent", 6).alias("spent"), "budget", F.coalesce(F.col("spent") > F.col("budget"), F.lit(False)).alias("exceeded"))


def check_budget(calls: DataFrame, projected: float, budget: float) -> float:
    """The total with the projected cost; raises if that is more than the budget."""
    total = (calls.agg(F.sum("cost_usd")).first()[0] or 0.0) + projected
    if total > budget:
        raise BudgetExceeded(f"{total:.4f} USD of {budget:.4f}")
    return total


def first_over(calls: DataFrame, budget: float) -> DataFrame:
    """Per stage: the first call at which the running cost passes the budget."""
    order = Window.partitionBy("stage").orderBy("ts", "event_id")
    run = calls.withColumn("running", F.sum("cost_usd").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") > budget)
    return run.groupBy("stage").agg(F.min("ts").alias("ts"))


def cached_lookup(requests: DataFrame, cache: DataFrame, now: float | None = None) -> DataFrame:
    """Requests (namespace, key) with the cached value, where it has not expired, and whether that was a hit."""
    live = cache if now is None else cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return requests.join(live.select("namespace", "key", "value"), ["namespace", "key"], "left").withColumn("hit", F.col("value").isNotNull())


def hit_rate(lookups: DataFrame) -> DataFrame:
    return lookups.groupBy("namespace").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))


def log_summary(log: DataFrame) -> DataFrame:
    """Runs by stage: number, seconds and cost."""
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("wall_time_seconds"), 4).alias("seconds"), F.round(F.max("wall_time_seconds"), 4).alias("longest"))
