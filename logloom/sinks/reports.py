"""Reports as Markdown: an evaluation of several models, and a text dataset; every section is a small result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import datasets as ds
from logloom.operators import evaluation as ev
from logloom.sinks.writers import markdown_report


def evaluation_report(runs: DataFrame, calls: DataFrame, models: Sequence[str], title: str = "Evaluation") -> str:
    """What became better and worse between models: overview, pass^k, transitions, tasks that changed, tools and messages of errors."""
    rewards = ev.task_rewards(runs.filter("task_id IS NOT NULL"), ["model_label", "task_id"])
    compared = ev.comparisons(ev.paired_trials(runs, models), models)
    changed = ev.task_transitions(compared).filter("change <> 'unchanged'")
    cohorts = runs.select("trajectory_id", F.col("model_label").alias("cohort")).distinct()
    parts = {
        "Overview": ev.model_overview(runs, calls).orderBy("model_label"), "Pass^k": ev.dataset_summary(rewards, ["model_label"]).orderBy("model_label"),
        "Transitions": compared.groupBy("comparison", "transition").agg(F.count("*").alias("trials")).orderBy("comparison", "transition"), "Tasks that changed": changed.orderBy("comparison", F.abs("delta").desc(), "task_id"),
        "Tool errors": ev.tool_errors(calls, cohorts).orderBy(F.col("errors").desc(), "cohort", "level", "tool"), "Error messages": ev.error_messages(calls).orderBy(F.col("calls").desc(), "message"),
    }
    return markdown_report(title, parts)


def dataset_report(rows: DataFrame, key: str, group: str, length: str, title: str = "Dataset", longest: int = 10) -> str:
    """A dataset at a glance: rows and lengths by group, lengths in bins, the longest and shortest rows (the lowest key first among equals)."""
    held = rows.filter(F.col(length).isNotNull())
    totals = rows.groupBy(group).agg(F.count("*").alias("rows"), F.count_if(F.col(length).isNull()).alias("without_length"), F.coalesce(F.sum(length), F.lit(0)).alias("total"))
    ends = lambda order: held.orderBy(order, F.col(key).asc()).select(key, group, length).limit(longest)
    parts = {
        "Rows": totals.orderBy(group), "Lengths": ds.numeric_summary(held, [group], length).orderBy(group), "Bins": ds.bins(held, length).orderBy("length_bin"), "Longest": ends(F.col(length).desc()), "Shortest": ends(F.col(length).asc()),
    }
    return markdown_report(title, parts)
