"""Queries over evaluated trajectories and their tool calls, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions.numbers import is_successful, pass_hat_k
from logloom.operators import evaluation as ev
from logloom.session import table

MODELS = ["sft", "vanilla", "potential"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """The evaluated trajectories, repeated rows once."""
    return table(spark, d, "trajectory_features").distinct()


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_calls")


def _rewards(spark: SparkSession, d: str) -> DataFrame:
    return ev.task_rewards(runs(spark, d).filter("task_id IS NOT NULL"), ["model_label", "task_id"])


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.dataset_summary(_rewards(spark, d), ["model_label"])


def agg_06_pass_hat_k(spark: SparkSession, d: str) -> DataFrame:
    per = runs(spark, d).filter("task_id IS NOT NULL AND reward IS NOT NULL").groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(is_successful(F.col("reward"))).alias("c"))
    return per.select("task_id", "n", "c", *[F.round(pass_hat_k(F.col("n"), F.col("c"), k), 6).alias(f"pass_{k}") for k in (1, 2, 3)])


def agg_07_trial_stats(spark: SparkSession, d: str) -> DataFrame:
    usable = runs(spark, d).filter("reward IS NOT NULL")
    return usable.groupBy("model_label", "trial").agg(F.count("*").alias("trials"), F.count_if(is_successful(F.col("reward"))).alias("successes"), F.round(F.avg("reward"), 6).alias("reward_mean"))


def agg_07_terminations(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("model_label", "termination_reason").agg(F.count("*").alias("trajectories"))


def agg_07_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of each group type as one row a task, in task order within the type (lists would grow with the data)."""
    return _rewards(spark, d).select("model_label", "group_type", F.col("task_id").cast("bigint").alias("task_number"))


def agg_23_group_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.relative_advantages(runs(spark, d).filter("task_id IS NOT NULL"), ["model_label", "task_id"])
    return rows.select("trajectory_id", "model_label", "task_id", "reward", "group_size", "reward_mean", "reward_std", "advantage", "mixed")


def agg_25_reward_slots(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of each task and model by trial, null where absent, with mean and sample deviation."""
    picked = ev.one_per_trial(runs(spark, d))
    slots = [F.max(F.when(F.col("trial") == i, F.col("reward"))).alias(f"reward_{i}") for i in range(4)]
    return picked.groupBy("model_label", "task_id").agg(F.count("*").alias("size"), *slots, F.round(F.avg("reward"), 6).alias("reward_mean"), F.round(F.coalesce(F.stddev_samp("reward"), F.lit(0.0)), 6).alias("reward_std"), (F.min("reward") < F.max("reward")).alias("mixed"))


def agg_24_rollout_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each numeric column's mean, p90 (linear) and greatest value, and the share of successes (reward above 0.5)."""
    rows = runs(spark, d)
    names = ["duration_seconds", "assistant_turns", "completion_tokens", "exact_repeated_calls", "consecutive_exact_retries"]
    long = rows.select("model_label", F.expr(f"stack({len(names)}, {', '.join(f"'{n}', cast({n} as double)" for n in names)}) as (metric, value)"))
    long = long.unionByName(rows.filter("reward IS NOT NULL").select("model_label", F.lit("success").alias("metric"), (F.col("reward") > 0.5).cast("double").alias("value")))
    return long.groupBy("model_label", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.9), 6).alias("p90"), F.max("value").alias("most"))


def agg_24_group_signal(spark: SparkSession, d: str) -> DataFrame:
    """How many groups have an outcome signal (rewards differ) or a local one (a retry anywhere)."""
    rows = runs(spark, d).filter("task_id IS NOT NULL AND reward IS NOT NULL")
    per = rows.groupBy("model_label", "task_id").agg((F.min("reward") < F.max("reward")).alias("outcome"), F.coalesce(F.bool_or(F.col("consecutive_exact_retries") > 0), F.lit(False)).alias("local"))
    return per.groupBy("model_label").agg(F.count("*").alias("groups"), F.count_if("outcome").alias("outcome_groups"), F.count_if("local").alias("local_groups"), F.count_if(F.col("outcome") | F.col("local")).alias("effective_groups"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return ev.paired_trials(runs(spark, d), MODELS)


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return ev.comparisons(_pairs(spark, d), MODELS)


def agg_18_transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).groupBy("comparison", "transition").agg(F.count("*").alias("trials"))


def agg_19_cohort_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Averages of the new model's features over each transition cohort (0 for an empty one)."""
    rows = ev.one_per_trial(runs(spark, d)).filter("model_label = 'vanilla'").select("task_id", "trial", "assistant_turns", "completion_tokens", "exact_repeated_calls")
    joined = _pairs(spark, d).select("task_id", "trial", F.col("sft_to_vanilla").alias("transition")).join(rows, ["task_id", "trial"])
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"avg_{c}")
    return joined.groupBy("transition").agg(F.count("*").alias("trials"), mean("assistant_turns"), mean("completion_tokens"), mean("exact_repeated_calls"))


def top_09_review_cases(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{a}_to_{b}" for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]]
    flipped = F.exists(F.array(*names), lambda t: t.isin("regressed", "improved"))
    return _pairs(spark, d).filter(flipped).select("task_id", "trial", *names)


def top_11_task_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changed tasks in the order of the report: greatest change first, then by task number."""
    return ev.task_transitions(_compared(spark, d)).filter("delta <> 0").select("comparison", "task_id", "delta", F.concat_ws(" -> ", F.col("old_success").cast("string"), F.col("new_success").cast("string")).alias("shown"))


def jon_04_key_diff(spark: SparkSession, d: str) -> DataFrame:
    """Task and trial pairs that one of two models lacks."""
    rows = runs(spark, d).filter("task_id IS NOT NULL")
    key = lambda m: rows.filter(F.col("model_label") == m).select("task_id", "trial").distinct()
    a, b = key("sft"), key("vanilla")
    missing = a.join(b, ["task_id", "trial"], "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, ["task_id", "trial"], "left_anti").withColumn("side", F.lit("extra")))


def set_03_symmetric_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).filter("task_id IS NOT NULL")
    a, b = (rows.filter(F.col("model_label") == m).select("task_id") for m in ("sft", "potential"))
    return a.subtract(b).union(b.subtract(a))


def src_03_run_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the integrity check of an evaluation finds: repeated keys and missing trials of each model."""
    rows = runs(spark, d).filter("task_id IS NOT NULL")
    per = rows.groupBy("model_label", "task_id", "trial").agg(F.count("*").alias("k"))
    return per.groupBy("model_label", "task_id").agg(F.count_if(F.col("k") > 1).alias("repeated_trials"), (4 - F.count("*")).alias("missing_trials")).filter("repeated_trials > 0 OR missing_trials > 0")


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).filter("reward IS NOT NULL")
    return rows.select("trajectory_id", F.explode(F.array(F.lit("overall"), F.when(is_successful(F.col("reward")), "success").otherwise("failure"), F.concat(F.lit("model_"), "model_label"))).alias("cohort")).distinct()


def jon_14_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return _cohorts(spark, d).groupBy("cohort").agg(F.count("*").alias("trajectories"))


def str_03_tool_family(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).groupBy("name", tx.tool_family(F.col("name")).alias("by_name")).agg(F.count("*").alias("calls"))


def win_06_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return ev.call_features(_calls(spark, d)).filter("consecutive_exact_retries > 0").select("trajectory_id", "consecutive_exact_retries")


def win_03_rollout_indices(spark: SparkSession, d: str) -> DataFrame:
    """Which occurrence of its task a run is (from 0), by trajectory id.

    The rank within a hot task comes from a range-partitioned order, not from one window: see ``logloom.operators.ordering``.
    """
    from logloom.operators.ordering import group_positions

    rows = runs(spark, d).filter("task_id IS NOT NULL").select("task_id", "trajectory_id", "model_label", "trial").dropDuplicates(["trajectory_id"])
    return group_positions(rows.select("task_id", "trajectory_id"), F.col("task_id"), [F.col("trajectory_id").asc()], "position").select("task_id", "trajectory_id", (F.col("position") - 1).alias("rollout_index"))


def flt_15_success(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("trajectory_id", is_successful(F.col("reward")).alias("ok")).groupBy("ok").agg(F.count_distinct("trajectory_id").alias("trajectories"))


def flt_17_overflow_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Runs that ended for want of steps count as failures with their own reason, the old one kept."""
    hit = F.col("termination_reason") == "max_steps"
    return runs(spark, d).select("trajectory_id", "model_label", F.when(hit, F.lit(0.0)).otherwise(F.col("reward")).alias("reward"), F.when(hit, "context_window_exceeded").otherwise(F.col("termination_reason")).alias("termination_reason"), F.when(hit, F.col("termination_reason")).alias("original_reason"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "agg_05_task_rewards": _rewards, "agg_06_pass_hat_k": agg_06_pass_hat_k, "agg_07_dataset_summary": _summary, "agg_07_trial_stats": agg_07_trial_stats, "agg_07_terminations": agg_07_terminations, "agg_07_group_ids": agg_07_group_ids,
        "aux_09_passk_chart": lambda s, d: ev.passk_series(_summary(s, d), "model_label"), "aux_10_success_chart": lambda s, d: ev.success_histogram(_rewards(s, d), ["model_label"]), "aux_11_structure_chart": lambda s, d: ev.group_structure(_summary(s, d), "model_label"),
        "agg_14_runtime_summary": lambda s, d: ev.runtime_summary(runs(s, d), "model_label"), "agg_17_model_overview": lambda s, d: ev.model_overview(runs(s, d), _calls(s, d)),
        "agg_15_tool_errors": lambda s, d: ev.tool_errors(_calls(s, d), _cohorts(s, d)), "agg_15_error_messages": lambda s, d: ev.error_messages(_calls(s, d)), "agg_21_call_features": lambda s, d: ev.call_features(_calls(s, d)),
        "agg_18_transition_counts": agg_18_transition_counts, "agg_18_matrix": lambda s, d: ev.transition_matrix(_compared(s, d)), "agg_19_cohort_diagnostics": agg_19_cohort_diagnostics, "agg_20_task_transitions": lambda s, d: ev.task_transitions(_compared(s, d)),
        "agg_23_group_summary": agg_23_group_summary, "agg_24_rollout_metrics": agg_24_rollout_metrics, "agg_24_group_signal": agg_24_group_signal, "agg_25_reward_slots": agg_25_reward_slots,
        "jon_03_paired_trials": _pairs, "jon_04_key_diff": jon_04_key_diff, "jon_14_cohorts": jon_14_cohorts, "top_09_review_cases": top_09_review_cases, "top_11_task_changes": top_11_task_changes,
        "set_03_symmetric_tasks": set_03_symmetric_tasks, "src_03_run_audit": src_03_run_audit, "str_03_tool_family": str_03_tool_family, "win_06_consecutive": win_06_consecutive, "win_03_rollout_indices": win_03_rollout_indices, "flt_15_success": flt_15_success, "flt_17_overflow_rewrite": flt_17_overflow_rewrite,
    }


_K = lambda n, c, k: f"case when {n} >= {k} then round(" + " * ".join(f"greatest({c} - {i}, 0)::double / nullif(({n} - {i}), 0)" for i in range(k)) + ", 6) end"
_RUNS = "f as (select distinct * from trajectory_features)"
_REWARDS = f"""{_RUNS}, b as (select model_label, task_id, count(*) n, sum(case when abs(reward - 1) <= 1e-6 then 1 else 0 end)::bigint c, avg(reward) m, var_pop(reward) v
  from f where task_id is not null and reward is not null group by 1, 2),
 w as (select model_label, task_id, n as num_trials, c as success_count, n - c as failure_count, round(m, 6) as reward_mean, round(v, 6) as reward_variance, round(sqrt(v), 6) as reward_std, v <= 1e-12 as zero_variance,
  case when c = 0 then 'all_failure' when c = n then 'all_success' else 'mixed' end as group_type, {", ".join(_K("n", "c", k) + f" as pass_{k}" for k in (1, 2, 3, 4))} from b)"""
_SUMMARY = f"""{_REWARDS}, s as (select model_label, count(*) as tasks, {", ".join(f"round(avg(pass_{k}), 6) as pass_{k}" for k in (1, 2, 3, 4))},
  {", ".join(f"count(*) filter (group_type = '{t}') as {t}_groups, round(avg(case when group_type = '{t}' then 1.0 else 0.0 end), 6) as {t}_rate" for t in ("all_failure", "mixed", "all_success"))} from w group by 1)"""
_PICK = f"{_RUNS}, p as (select * from (select *, row_number() over (partition by model_label, task_id, trial order by trajectory_id) rn from f where task_id is not null and reward is not null) where rn = 1)"
_TR = lambda a, b: f"case when {a} and {b} then 'both_success' when {b} then 'improved' when {a} then 'regressed' else 'both_failure' end"
_PAIRS = f"""{_PICK}, q as (select task_id, trial, {", ".join(f"max(case when model_label = '{m}' then reward end) as {m}_reward, bool_or(case when model_label = '{m}' then abs(reward - 1) <= 1e-6 end) as {m}_success" for m in MODELS)}
  from p group by 1, 2 having count(distinct model_label) = 3),
 x as (select *, {", ".join(_TR(f"{a}_success", f"{b}_success") + f" as {a}_to_{b}" for a, b in (("sft", "vanilla"), ("sft", "potential"), ("vanilla", "potential")))} from q)"""
_COMPARED = f"{_PAIRS}, y as (" + " union all ".join(f"select '{a}_to_{b}' as comparison, task_id, trial, {a}_success as old, {b}_success as new, {a}_to_{b} as transition from x" for a, b in (("sft", "vanilla"), ("sft", "potential"), ("vanilla", "potential"))) + ")"
_ONCE = "o as (select * from (select *, row_number() over (partition by trajectory_id, call_id order by ingested_at, message_index, call_pos) rn from tool_calls) where rn = 1)"
_COHORTS = f"{_RUNS}, c as (select distinct trajectory_id, unnest(['overall', case when abs(reward - 1) <= 1e-6 then 'success' else 'failure' end, 'model_' || model_label]) as cohort from f where reward is not null)"
_TRANS = f"""{_COMPARED}, z as (select comparison, task_id, count(*) as trials, count(*) filter (old) as old_success, count(*) filter (new) as new_success,
  coalesce(string_agg(trial::varchar, ',' order by trial) filter (transition = 'improved'), '') as improved_trials, coalesce(string_agg(trial::varchar, ',' order by trial) filter (transition = 'regressed'), '') as regressed_trials from y group by 1, 2)"""
_GT = lambda c: f"case when {c} = 0 then 'all_failure' when {c} = trials then 'all_success' else 'mixed' end"


_SIG = f"""{_ONCE}, sg as (select *, case when json_valid(arguments) and json_type(arguments) = 'OBJECT' then '{{' || array_to_string(list_sort(list_transform(json_keys(arguments), lambda k: k || chr(1) ||
  case when json_type(arguments, '$."' || k || '"') in ('DOUBLE', 'BIGINT', 'UBIGINT') then cast(json_extract_string(arguments, '$."' || k || '"') as double)::varchar else json_extract(arguments, '$."' || k || '"')::varchar end)), chr(2)) else coalesce(arguments, '') end as doc from o),
 sq as (select *, coalesce(name, '') || chr(3) || doc as sig, lag(coalesce(name, '') || chr(3) || doc) over (partition by trajectory_id order by message_index, call_pos) as before from sg)"""


def oracle_sql() -> dict[str, str]:
    metrics = ["duration_seconds", "assistant_turns", "completion_tokens", "exact_repeated_calls", "consecutive_exact_retries"]
    return {
        "agg_05_task_rewards": f"with {_REWARDS} select * from w",
        "agg_06_pass_hat_k": f"with {_RUNS}, b as (select task_id, count(*) n, sum(case when abs(reward - 1) <= 1e-6 then 1 else 0 end)::bigint c from f where task_id is not null and reward is not null group by 1) select task_id, n, c, {', '.join(_K('n', 'c', k) + f' as pass_{k}' for k in (1, 2, 3))} from b",
        "agg_07_dataset_summary": f"with {_SUMMARY} select * from s",
        "agg_07_trial_stats": f"with {_RUNS} select model_label, trial, count(*) as trials, count(*) filter (abs(reward - 1) <= 1e-6) as successes, round(avg(reward), 6) as reward_mean from f where reward is not null group by 1, 2",
        "agg_07_terminations": f"with {_RUNS} select model_label, termination_reason, count(*) as trajectories from f group by 1, 2",
        "agg_07_group_ids": f"with {_REWARDS} select model_label, group_type, task_id::bigint as task_number from w",
        "aux_09_passk_chart": f"with {_SUMMARY} " + " union all ".join(f"select model_label, {k}::integer as k, round(pass_{k} * 100, 4) as pass_percent from s" for k in (1, 2, 3, 4)),
        "aux_10_success_chart": f"with {_REWARDS}, g as (select distinct model_label from w), h as (select model_label, success_count, count(*) k from w where success_count <= 4 group by 1, 2) select g.model_label, r.i as success_count, coalesce(h.k, 0) as tasks from g cross join (select unnest(range(0, 5)) as i) r left join h on h.model_label = g.model_label and h.success_count = r.i",
        "aux_11_structure_chart": f"with {_SUMMARY}, u as (select model_label, 0 as o, 'all_failure' as group_type, all_failure_groups / tasks * 100 as share from s union all select model_label, 1, 'mixed', mixed_groups / tasks * 100 from s union all select model_label, 2, 'all_success', all_success_groups / tasks * 100 from s) select model_label, group_type, round(share, 4) as share, round(coalesce(sum(share) over (partition by model_label order by o rows between unbounded preceding and 1 preceding), 0), 4) as start from u",
        "agg_14_runtime_summary": f"with {_RUNS} select model_label, count(*) as tasks, count(*) filter (reward = 1) as successes, count(*) filter (termination_reason = 'infrastructure_error') as infrastructure_errors, round(avg(duration_seconds) filter (termination_reason is distinct from 'infrastructure_error'), 6) as mean_seconds, round(quantile_cont(duration_seconds, 0.5) filter (termination_reason is distinct from 'infrastructure_error'), 6) as median_seconds, quantile_disc(duration_seconds, 0.9) filter (termination_reason is distinct from 'infrastructure_error') as p90_seconds from f group by 1",
        "agg_17_model_overview": f"with {_RUNS}, {_ONCE}, e as (select trajectory_id, count(*) calls, count(*) filter (error) errors from o group by 1), j as (select f.*, coalesce(e.calls, 0) calls, coalesce(e.errors, 0) errors from f left join e using (trajectory_id)) select model_label, count(*) as trajectories, count(*) filter (abs(reward - 1) <= 1e-6) as successes, round(avg(reward), 6) as avg_reward, round(avg(calls), 6) as avg_calls, round(avg(assistant_turns), 6) as avg_turns, round(avg(completion_tokens), 6) as avg_completion_tokens, round(coalesce(sum(errors) * 100.0 / nullif(sum(calls), 0), 0)::double, 4) as errors_per_100, count(*) filter (termination_reason not in ('user_stop', 'agent_stop')) as abnormal_terminations from j group by 1",
        "agg_15_tool_errors": f"with {_COHORTS}, {_ONCE}, z as (select cohort, count(distinct trajectory_id) as trajectories from c group by 1), j as (select c.cohort, o.* from o join c using (trajectory_id)) select z.cohort, case when family is null then 'all' when name is null then 'family' else 'tool' end as level, coalesce(family, '') as family, coalesce(name, '') as tool, trajectories, calls, errors, round(coalesce(errors * 100.0 / nullif(calls, 0), 0)::double, 4) as errors_per_100, affected_trajectories, affected_tasks from (select cohort, family, name, count(*) as calls, count(*) filter (error) as errors, count(distinct trajectory_id) filter (error) as affected_trajectories, count(distinct task_id) filter (error) as affected_tasks from j group by grouping sets ((cohort), (cohort, family), (cohort, family, name))) g join z on z.cohort = g.cohort",
        "agg_15_error_messages": f"""with {_ONCE}, m as (select lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(error_text, '')), '^error:\\s*', '', 'i'), '#W\\d+', '<order_id>', 'gi'), '\\b\\d{{5,}}\\b', '<id>', 'g'), '\\s+', ' ', 'g'))) as t from o where error) select case when t = '' then 'unspecified tool error' else left(t, 240) end as message, count(*) as calls from m group by 1""",
        "agg_21_call_features": f"with {_SIG} select trajectory_id, count(*) as total_calls, count(*) filter (error) as tool_errors, count(*) filter (error and family = 'read') as read_errors, count(*) filter (error and family = 'write') as write_errors, count(*) - count(distinct sig) as exact_repeated_calls, count(*) filter (sig = before) as consecutive_exact_retries from sq group by 1",
        "win_06_consecutive": f"with {_SIG} select trajectory_id, count(*) filter (sig = before) as consecutive_exact_retries from sq group by 1 having count(*) filter (sig = before) > 0",
        "agg_18_transition_counts": f"with {_COMPARED} select comparison, transition, count(*) as trials from y group by 1, 2",
        "agg_18_matrix": f"with {_COMPARED}, t as (select comparison, task_id, count(*) filter (old) a, count(*) filter (new) b from y group by 1, 2), g as (select distinct comparison from y) select g.comparison, r.i as old_success, {', '.join(f'count(*) filter (t.b = {i}) as new_{i}' for i in range(5))} from g cross join (select unnest(range(0, 5)) as i) r left join t on t.comparison = g.comparison and t.a = r.i group by 1, 2",
        "agg_19_cohort_diagnostics": f"with {_PAIRS} select x.sft_to_vanilla as transition, count(*) as trials, {', '.join(f'round(coalesce(avg({c}), 0), 6) as avg_{c}' for c in ('assistant_turns', 'completion_tokens', 'exact_repeated_calls'))} from x join p on p.model_label = 'vanilla' and p.task_id = x.task_id and p.trial = x.trial group by 1",
        "agg_20_task_transitions": f"with {_TRANS} select *, new_success - old_success as delta, case when new_success > old_success then 'improved' when new_success < old_success then 'regressed' when improved_trials <> '' or regressed_trials <> '' then 'net_zero_flip' else 'unchanged' end as change, case when (old_success = trials and new_success = 0) or new_success - old_success <= -2 then 'P0' when new_success < old_success then 'P1' when regressed_trials <> '' then 'P2' else '' end as priority, {_GT('old_success')} as old_group, {_GT('new_success')} as new_group from z",
        "agg_23_group_summary": f"with {_RUNS}, b as (select model_label, task_id, count(*) n, avg(reward) m, coalesce(stddev_samp(reward), 0) s, min(reward) < max(reward) x from f where task_id is not null and reward is not null group by 1, 2) select trajectory_id, f.model_label, f.task_id, reward, n as group_size, round(m, 6) as reward_mean, round(s, 6) as reward_std, round((reward - m) / (s + 1e-6), 4) as advantage, x as mixed from f join b on f.model_label = b.model_label and f.task_id = b.task_id where reward is not null",
        "agg_24_rollout_metrics": f"with {_RUNS}, l as (" + " union all ".join(f"select model_label, '{m}' as metric, {m}::double as value from f" for m in metrics) + " union all select model_label, 'success', case when reward > 0.5 then 1.0 else 0.0 end from f where reward is not null) select model_label, metric, round(avg(value), 6) as mean, round(quantile_cont(value, 0.9), 6) as p90, max(value) as most from l group by 1, 2",
        "agg_24_group_signal": f"with {_RUNS}, g as (select model_label, task_id, min(reward) < max(reward) as a, coalesce(bool_or(consecutive_exact_retries > 0), false) as b from f where task_id is not null and reward is not null group by 1, 2) select model_label, count(*) as groups, count(*) filter (a) as outcome_groups, count(*) filter (b) as local_groups, count(*) filter (a or b) as effective_groups from g group by 1",
        "agg_25_reward_slots": f"with {_PICK} select model_label, task_id, count(*) as size, {', '.join(f'max(case when trial = {i} then reward end) as reward_{i}' for i in range(4))}, round(avg(reward), 6) as reward_mean, round(coalesce(stddev_samp(reward), 0), 6) as reward_std, min(reward) < max(reward) as mixed from p group by 1, 2",
        "jon_03_paired_trials": f"with {_PAIRS} select * from x",
        "jon_04_key_diff": f"with {_RUNS}, a as (select distinct task_id, trial from f where model_label = 'sft' and task_id is not null), b as (select distinct task_id, trial from f where model_label = 'vanilla' and task_id is not null) select *, 'missing' as side from (select * from a except select * from b) union all select *, 'extra' from (select * from b except select * from a)",
        "jon_14_cohorts": f"with {_COHORTS} select cohort, count(*) as trajectories from c group by 1",
        "top_09_review_cases": f"with {_PAIRS} select task_id, trial, sft_to_vanilla, sft_to_potential, vanilla_to_potential from x where sft_to_vanilla in ('regressed', 'improved') or sft_to_potential in ('regressed', 'improved') or vanilla_to_potential in ('regressed', 'improved')",
        "top_11_task_changes": f"with {_TRANS} select comparison, task_id, new_success - old_success as delta, old_success || ' -> ' || new_success as shown from z where new_success <> old_success",
        "set_03_symmetric_tasks": f"with {_RUNS}, a as (select task_id from f where model_label = 'sft' and task_id is not null), b as (select task_id from f where model_label = 'potential' and task_id is not null) (select * from a except select * from b) union (select * from b except select * from a)",
        "src_03_run_audit": f"with {_RUNS}, k as (select model_label, task_id, trial, count(*) n from f where task_id is not null group by 1, 2, 3), g as (select model_label, task_id, count(*) filter (n > 1) as repeated_trials, 4 - count(*) as missing_trials from k group by 1, 2) select * from g where repeated_trials > 0 or missing_trials > 0",
        "str_03_tool_family": "select name, case when regexp_matches(name, '^(find|get|list|search)_') then 'read' when regexp_matches(name, '^(cancel|exchange|modify|return)_') then 'write' when name = 'calculate' then 'utility' when name like '%transfer%' or name like '%human%' then 'transfer' else 'other' end as by_name, count(*) as calls from tool_calls group by 1, 2",
        "win_03_rollout_indices": f"with {_RUNS}, u as (select distinct task_id, trajectory_id from f where task_id is not null) select task_id, trajectory_id, row_number() over (partition by task_id order by trajectory_id) - 1 as rollout_index from u",
        "flt_15_success": f"with {_RUNS} select abs(reward - 1) <= 1e-6 as ok, count(distinct trajectory_id) as trajectories from f group by 1",
        "flt_17_overflow_rewrite": f"with {_RUNS} select trajectory_id, model_label, case when termination_reason = 'max_steps' then 0.0 else reward end as reward, case when termination_reason = 'max_steps' then 'context_window_exceeded' else termination_reason end as termination_reason, case when termination_reason = 'max_steps' then termination_reason end as original_reason from f",
    }
