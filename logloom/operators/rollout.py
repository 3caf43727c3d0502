"""Rollouts: summaries, the fixed trajectory table, metrics over a step, groups' signals, target positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.numbers import ratio

# The columns of the trajectory table, and what a step reports the distribution of, with the prefix it is told under.
TABLE = [
    "task_id", "rollout_index", "slot_id", "termination_reason", "assistant_turns", "user_turns", "tool_call_count", "num_errors", "assistant_tokens", "observation_tokens", "user_observation_tokens", "tool_response_tokens",
    "assistant_tokens_per_turn", "tool_response_tokens_per_call", "trajectory_seconds", "generation_seconds", "user_seconds", "num_preempted", "infrastructure_retry_count",
    "turn_credit_target_field_count", "turn_credit_final_potential", "turn_credit_best_potential", "turn_credit_total_new_progress", "turn_credit_positive_progress_turns", "turn_credit_target_fact_count", "turn_credit_covered_fact_count",
    "turn_credit_final_fact_potential", "turn_credit_best_fact_potential", "turn_credit_total_new_fact_progress", "turn_credit_positive_fact_progress_turns", "turn_credit_model_error_turns",
]
DISTRIBUTIONS = {
    "assistant_turns": "rollout/assistant_turns", "user_turns": "rollout/user_turns", "tool_call_count": "rollout/tool_call_count", "num_errors": "rollout/errors", "prompt_tokens": "rollout/prompt_tokens", "response_tokens": "rollout/response_tokens",
    "assistant_tokens": "rollout/assistant_tokens", "observation_tokens": "rollout/observation_tokens", "user_observation_tokens": "rollout/user_observation_tokens", "tool_response_tokens": "rollout/tool_response_tokens",
    "assistant_tokens_per_turn": "rollout/assistant_tokens_per_turn", "tool_response_tokens_per_call": "rollout/tool_response_tokens_per_call", "trajectory_seconds": "rollout/trajectory_seconds", "generation_seconds": "rollout/generation_seconds",
    "user_seconds": "rollout/user_seconds", "tool_seconds": "rollout/tool_seconds", "evaluation_seconds": "rollout/evaluation_seconds",
    **{f"turn_credit_{n}": f"turn_credit/{n}" for n in ("target_field_count", "final_potential", "best_potential", "total_new_progress", "positive_progress_turns", "target_fact_count", "covered_fact_count", "final_fact_potential", "best_fact_potential", "total_new_fact_progress", "positive_fact_progress_turns", "model_error_turns")},
}


def summarize(df: DataFrame) -> DataFrame:
    """Adds what follows from a rollout's counts: observed tokens, tokens a turn and a call; 0 where nothing is divided by."""
    seen = F.col("response_tokens") - F.col("assistant_tokens")
    return df.withColumns({"observation_tokens": seen, "assistant_tokens_per_turn": ratio(F.col("assistant_tokens"), F.col("assistant_turns")), "tool_response_tokens_per_call": ratio(F.col("tool_response_tokens"), F.col("tool_call_count"))})


def trajectory_table(df: DataFrame, step: int, reward: str = "reward") -> DataFrame:
    """The fixed table of a step: ``step, reward`` and the columns of ``TABLE``, null where the input has none."""
    return df.select(F.lit(step).alias("step"), F.col(reward).cast("double").alias("reward"), *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in TABLE])


def step_metrics(df: DataFrame, keys: Sequence[str], group: str, reward: str = "reward", local: Column | None = None) -> DataFrame:
    """``keys, metric, value`` of a step's rollouts: successes (reward above 0.5), groups' signals, distributions, retries and endings.

    A group has an outcome signal if its rewards differ, a local one if any row
    has (``local``), an effective one if either.  Columns of ``DISTRIBUTIONS``
    that the input lacks are left out; a null value counts nowhere.  Groups are
    pre-aggregated, so a group of any size costs one row.
    """
    rows = df.filter(F.col(reward).isNotNull())
    won = F.count_if(F.col(reward) > 0.5)
    every = rows.groupBy(*keys).agg(
        won.cast("double").alias("reward/success_count"), (F.count("*") - won).cast("double").alias("reward/failure_count"), (won / F.count("*")).alias("reward/success_rate"), F.count("*").cast("double").alias("rollout/valid_trajectories"),
        *([F.sum("infrastructure_retry_count").cast("double").alias("infra/retry_attempt_count"), F.count_if(F.col("infrastructure_retry_count") > 0).cast("double").alias("infra/retried_trajectory_count")] if "infrastructure_retry_count" in df.columns else []),
        *([F.sum("num_preempted").cast("double").alias("rollout/num_preempted")] if "num_preempted" in df.columns else []),
        *([(F.sum("assistant_tokens") / F.nullif(F.sum("response_tokens"), F.lit(0))).cast("double").alias("rollout/assistant_token_fraction")] if {"assistant_tokens", "response_tokens"} <= set(df.columns) else []),
    )
    own = F.bool_or(F.coalesce(local, F.lit(False))) if local is not None else F.lit(False)
    groups = rows.filter(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.avg(reward).alias("mean"), (F.min(reward) < F.max(reward)).alias("outcome"), own.alias("local"))
    count = lambda c: F.count_if(c).cast("double")
    share = lambda c: F.count_if(c) / F.count("*")
    out, loc = F.col("outcome"), F.col("local")
    told = groups.groupBy(*keys).agg(
        F.count("*").cast("double").alias("grpo/group_count"), count(out).alias("grpo/mixed_group_count"), share(out).alias("grpo/mixed_group_ratio"), count(~out).alias("grpo/zero_signal_group_count"),
        *[f(c).alias(f"grpo/{n}_signal_group_{kind}") for n, c in (("outcome", out), ("local", loc), ("effective", out | loc)) for kind, f in (("count", count), ("ratio", share))],
        F.min("mean").alias("grpo/group_reward_mean_min"), F.max("mean").alias("grpo/group_reward_mean_max"), F.avg("mean").alias("grpo/group_reward_mean"),
    )
    here = {c: p for c, p in DISTRIBUTIONS.items() if c in df.columns}
    spread = rows.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"{p}/{n}") for c, p in here.items() for n, f in (("mean", F.avg), ("p90", lambda c: F.percentile(c, 0.9)), ("max", F.max))]) if here else None
    parts = [_long(part, keys) for part in (every, told, spread) if part is not None]
    if "termination_reason" in df.columns:
        name = F.concat(F.lit("termination/"), F.regexp_replace(F.coalesce("termination_reason", F.lit("none")), "[- ]", "_"), F.lit("_count"))
        parts.append(rows.groupBy(*keys, name.alias("metric")).agg(F.count("*").cast("double").alias("value")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.filter("value IS NOT NULL")


def _long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in df.columns if c not in keys]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])).alias("p")
    return df.select(*keys, pairs).select(*keys, "p.metric", "p.value")


def zipped_info(df: DataFrame, step: int, samples: str, rollouts: str, validate: str) -> DataFrame:
    """``step, sample_index, rollout_index, validate`` from parallel arrays of one batch a row; arrays of unequal length are an error of that row."""
    same = (F.size(samples) == F.size(rollouts)) & (F.size(samples) == F.size(validate))
    checked = F.when(same, F.arrays_zip(samples, rollouts, validate)).otherwise(F.raise_error(F.lit("samples, rollouts and validate differ in length")))
    return df.select(F.explode(checked).alias("z")).select(F.lit(step).alias("step"), F.col(f"z.{samples}").alias("sample_index"), F.col(f"z.{rollouts}").alias("rollout_index"), F.col(f"z.{validate}").alias("validate"))


def predicting_positions(mask: Column) -> Column:
    """The places whose next place counts: the targets of a mask, shifted by one."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(mask) - 1, F.lit(0))), lambda i: F.coalesce(F.get(mask, i + 1), F.lit(False)))
    return F.when(F.size(mask) > 0, places).otherwise(F.array().cast("array<int>"))


def restored(values: Column, places: Column, length: Column, fill: Column) -> Column:
    """Values put back at their places of a dense array, ``fill`` elsewhere."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.coalesce(F.get(values, (F.array_position(places, i) - 1).cast("int")), fill))


def replayed_ends(events: DataFrame, key: str, place: str, error: str, most_errors: int, most_steps: int) -> DataFrame:
    """``key, ended_at, reason``: the first message at which a session would have had to stop; ``running`` and no place where none.

    Errors are looked at before steps, as after each message both may be over.
    """
    w = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one session's messages
    counted = events.select(key, place, F.count_if(F.coalesce(error, F.lit(False))).over(w).alias("errors"), F.count("*").over(w).alias("steps"))
    reason = F.when(F.col("errors") >= most_errors, "too_many_errors").when(F.col("steps") >= most_steps, "max_steps")
    first = counted.select(key, place, reason.alias("reason")).groupBy(key).agg(F.min(F.when(F.col("reason").isNotNull(), F.struct(F.col(place).alias("at"), "reason"))).alias("f"))
    return first.select(key, F.col("f.at").cast("long").alias("ended_at"), F.coalesce("f.reason", F.lit("running")).alias("reason"))


def step_lines(metrics: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """``keys, first_line, second_line``: a step told in two lines from ``metric, value`` rows; metrics that are missing are 0."""
    # The lines' format and the metrics they tell.
    whole = lambda name: F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(0.0)).cast("long")
    real = lambda name: F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(0.0))
    first = F.format_string(
        f"[step {step}] reward %d/%d | mixed %d/%d | rollout %.1fs | retries %d", whole("reward/success_count"), whole("rollout/valid_trajectories"), whole("grpo/mixed_group_count"), whole("grpo/group_count"), real("timing_s/gen"), whole("infra/retry_attempt_count"),
    )
    second = F.format_string(
        f"[step {step}] ref %.1fs | actor %.1fs | KL %.4f | sync %.1fs | checkpoint %.1fs | total %.1fs | micro_batches %d | MFU %.1f%% | peak %.1fGB",
        real("timing_s/ref"), real("timing_s/update_actor"), real("actor/kl_loss"), real("timing_s/update_weights"), real("timing_s/save_checkpoint"), real("timing_s/step"), whole("actor/dynamic_micro_batch_count"), real("perf/mfu/actor") * 100, real("perf/actor_peak_memory_allocated_gb"),
    )
    return metrics.groupBy(*keys).agg(first.alias("first_line"), second.alias("second_line"))


def has_local_signal(spans: Column) -> Column:
    """Whether any span has progress, a new fact or an error."""
    return F.exists(spans, lambda s: (F.coalesce(s["progress"], F.lit(0.0)) != 0) | (F.coalesce(s["fact"], F.lit(0.0)) != 0) | F.coalesce(s["error"], F.lit(False)))


def sequence_score(scores: Column) -> Column:
    """The sum of a sequence's token scores; null scores count 0."""
    return F.aggregate(F.coalesce(scores, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def policy_specs(df: DataFrame, label: str, steps: str) -> DataFrame:
    """One row a policy: label and its distinct steps in order, each named ``step_%03d``; null steps are left out."""
    per = df.filter(F.col(steps).isNotNull()).select(label, F.col(steps).alias("step")).distinct()
    return per.select(label, "step", F.format_string("step_%03d", "step").alias("policy"))
