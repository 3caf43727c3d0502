"""Credit for turns: progress that counts once, and advantages shaped by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_progress(df: DataFrame, key: str, order: list[str], potential: str, initial: float = 0.0) -> DataFrame:
    """Adds ``new_progress``: by how much a turn lifts the best potential so far; falling back costs nothing."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(potential).over(before), F.lit(initial)), F.lit(initial))
    return df.withColumn("new_progress", F.greatest(F.col(potential) - best, F.lit(0.0)))


def fact_progress(observed: DataFrame, targets: DataFrame, key: str, turn: str) -> DataFrame:
    """``key, turn, new_facts, new_fact_progress``: target facts first seen in a turn, over all targets.

    ``observed(key, turn, task_id, fact)`` against ``targets(task_id, fact)``.
    First sight is a minimum, so no window runs over a trajectory's facts; a
    task without targets gives no progress.
    """
    sizes = targets.groupBy("task_id").agg(F.count_distinct("fact").alias("total"))
    first = observed.join(targets.distinct(), ["task_id", "fact"], "left_semi").groupBy(key, "task_id", "fact").agg(F.min(turn).alias(turn))
    counted = first.groupBy(key, "task_id", turn).agg(F.count("*").alias("new_facts"))
    return counted.join(sizes, "task_id").select(key, turn, "new_facts", F.round(F.col("new_facts") / F.col("total"), 6).alias("new_fact_progress"))


def potential_advantage(outcome: Column, progress: Column, fact_progress: Column, error: Column, write_coef: float, fact_coef: float, error_coef: float) -> Column:
    """An error turn costs ``error_coef`` (if not 0); positive local credit is added to a non-negative outcome; else the outcome."""
    credit = write_coef * progress + fact_coef * fact_progress
    kept = F.when(credit > 0, F.greatest(outcome, F.lit(0.0)) + credit).otherwise(outcome)
    return F.when(error, F.lit(-error_coef)).otherwise(kept) if error_coef else kept


def turn_score(progress: Column, fact: Column, error: Column, tokens: Column, all_tokens: Column) -> Column:
    """Credit of a turn between 0 and 1, raised for short turns (at most fourfold); 0 for an error turn."""
    lift = F.sqrt(F.least(all_tokens / F.when(tokens > 0, tokens), F.lit(16.0)))
    return F.when(error, 0.0).otherwise(F.least(F.greatest((0.8 * progress + 0.2 * fact) * lift, F.lit(0.0)), F.lit(1.0)))


def anchored_advantages(spans: DataFrame, key: str, strength: float = 0.4) -> DataFrame:
    """Adds ``q`` and ``advantage`` to ``spans(key, tokens, progress, fact, error, outcome, reward)``.

    Only a successful trajectory (reward above 0.5, positive outcome) is
    shaped: the outcome times 1 + strength x (q - token-weighted mean of q),
    which leaves the token mean and the sign as they were.
    """
    w = Window.partitionBy(key)
    scored = spans.withColumn("all_tokens", F.sum("tokens").over(w)).withColumn("q", turn_score(F.col("progress"), F.col("fact"), F.col("error"), F.col("tokens"), F.col("all_tokens")))
    mean = F.sum(F.col("q") * F.col("tokens")).over(w) / F.when(F.col("all_tokens") > 0, F.col("all_tokens"))
    shaped = F.col("outcome") * (1 + strength * (F.col("q") - mean))
    on = (F.col("reward") > 0.5) & (F.col("outcome") > 0)
    return scored.withColumn("advantage", F.when(on, F.coalesce(shaped, F.col("outcome"))).otherwise(F.col("outcome")))


def span_errors(spans: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """Keys whose spans don't exactly partition 0..length: gaps, overlaps or a wrong end."""
    w = Window.partitionBy(key).orderBy(start, end)
    marked = spans.withColumn("gap", F.col(start) != F.coalesce(F.lag(end).over(w), F.lit(0)))
    return marked.groupBy(key).agg(F.bool_or("gap").alias("broken"), (F.max(end) != F.max(length)).alias("wrong_end")).filter("broken OR wrong_end").select(key)
