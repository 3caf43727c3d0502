"""Evaluation analytics: reliability over trials, paired runs, tool errors, run times.

Rows without a task or reward are dropped where a reward is judged; each
function says what else it leaves out.  All are plain aggregations and equi
joins, so a task with very many trials only costs partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.numbers import is_successful, pass_hat_k, ratio
from logloom.functions.text import canonical_json, normalize_error


def group_type(n: Column, c: Column) -> Column:
    return F.when(c == 0, "all_failure").when(c == n, "all_success").otherwise("mixed")


def task_rewards(runs: DataFrame, keys: Sequence[str], reward: str = "reward", most_k: int = 4) -> DataFrame:
    """Per key: trials, successes, mean, population variance and deviation, group type, pass_1..pass_k."""
    r = F.col(reward)
    base = runs.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("num_trials"), F.count_if(is_successful(r)).alias("success_count"), F.avg(r).alias("reward_mean"), F.var_pop(r).alias("reward_variance")
    )
    n, c = F.col("num_trials"), F.col("success_count")
    return base.select(
        *keys, "num_trials", "success_count", (n - c).alias("failure_count"), F.round("reward_mean", 6).alias("reward_mean"), F.round("reward_variance", 6).alias("reward_variance"),
        F.round(F.sqrt("reward_variance"), 6).alias("reward_std"), (F.col("reward_variance") <= 1e-12).alias("zero_variance"), group_type(n, c).alias("group_type"),
        *[F.round(pass_hat_k(n, c, k), 6).alias(f"pass_{k}") for k in range(1, most_k + 1)],
    )


def dataset_summary(rewards: DataFrame, keys: Sequence[str], most_k: int = 4) -> DataFrame:
    """Means of pass_k over tasks and how many tasks are of each group type."""
    kinds = ("all_failure", "mixed", "all_success")
    counts = [F.count_if(F.col("group_type") == t).alias(f"{t}_groups") for t in kinds]
    rates = [F.round(F.avg((F.col("group_type") == t).cast("double")), 6).alias(f"{t}_rate") for t in kinds]
    return rewards.groupBy(*keys).agg(F.count("*").alias("tasks"), *[F.round(F.avg(f"pass_{k}"), 6).alias(f"pass_{k}") for k in range(1, most_k + 1)], *counts, *rates)


def success_histogram(rewards: DataFrame, keys: Sequence[str], most: int = 4) -> DataFrame:
    """Tasks by success count, dense from 0 to ``most``."""
    have = rewards.filter(F.col("success_count") <= most).groupBy(*keys, "success_count").agg(F.count("*").alias("k"))
    grid = rewards.select(*keys).distinct().withColumn("success_count", F.explode(F.sequence(F.lit(0), F.lit(most)).cast("array<bigint>")))
    return grid.join(have, [*keys, "success_count"], "left").select(*keys, "success_count", F.coalesce("k", F.lit(0)).alias("tasks"))


def passk_series(summary: DataFrame, key: str, most_k: int = 4) -> DataFrame:
    """Chart data: one row for each k, in per cent."""
    pairs = ", ".join(f"{k}, pass_{k}" for k in range(1, most_k + 1))
    return summary.select(key, F.expr(f"stack({most_k}, {pairs}) as (k, share)")).select(key, F.col("k").cast("int").alias("k"), F.round(F.col("share") * 100, 4).alias("pass_percent"))


def group_structure(summary: DataFrame, key: str) -> DataFrame:
    """Chart data: share of each group type in per cent with the running start for stacking."""
    kinds = ("all_failure", "mixed", "all_success")
    pairs = ", ".join(f"{i}, '{t}', {t}_groups / tasks * 100" for i, t in enumerate(kinds))
    rows = summary.select(key, F.expr(f"stack(3, {pairs}) as (type_order, group_type, share)"))
    before = Window.partitionBy(key).orderBy("type_order").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, "group_type", F.round("share", 4).alias("share"), F.round(F.coalesce(F.sum("share").over(before), F.lit(0.0)), 4).alias("start"))


def relative_advantages(runs: DataFrame, group: Sequence[str], reward: str = "reward") -> DataFrame:
    """Adds each row's group mean, sample deviation (0 for one row) and advantage.

    The group's figures come from an aggregation that is joined back, so a
    group of any size is spread over tasks.
    """
    stats = runs.filter(F.col(reward).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("group_size"), F.avg(reward).alias("m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"), (F.min(reward) < F.max(reward)).alias("mixed")
    )
    joined = runs.filter(F.col(reward).isNotNull()).join(stats, list(group))
    return joined.withColumn("advantage", F.round((F.col(reward) - F.col("m")) / (F.col("s") + 1e-6), 4)).withColumn("reward_mean", F.round("m", 6)).withColumn("reward_std", F.round("s", 6)).drop("m", "s")


def one_per_trial(runs: DataFrame) -> DataFrame:
    """The run with the least trajectory id of each model, task and trial."""
    usable = runs.filter("task_id IS NOT NULL AND reward IS NOT NULL")
    rest = [c for c in usable.columns if c not in ("model_label", "task_id", "trial")]
    picked = usable.groupBy("model_label", "task_id", "trial").agg(F.min_by(F.struct(*rest), "trajectory_id").alias("r"))
    return picked.select("model_label", "task_id", "trial", *[F.col("r")[c].alias(c) for c in rest])


def transition(old: Column, new: Column) -> Column:
    return F.when(old & new, "both_success").when(~old & new, "improved").when(old & ~new, "regressed").otherwise("both_failure")


def paired_trials(runs: DataFrame, models: Sequence[str]) -> DataFrame:
    """One wide row for each task and trial that all ``models`` have: rewards, successes, pairwise transitions."""
    picked = one_per_trial(runs)
    out: DataFrame | None = None
    for m in models:
        side = picked.filter(F.col("model_label") == m).select("task_id", "trial", F.col("reward").alias(f"{m}_reward"), is_successful(F.col("reward")).alias(f"{m}_success"))
        out = side if out is None else out.join(side, ["task_id", "trial"])
    assert out is not None
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            out = out.withColumn(f"{a}_to_{b}", transition(F.col(f"{a}_success"), F.col(f"{b}_success")))
    return out


def comparisons(pairs: DataFrame, models: Sequence[str]) -> DataFrame:
    """The paired rows again, one for each comparison: ``comparison, task_id, trial, old, new, transition``."""
    rows = [(f"{a}_to_{b}", a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    many = F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(f"{a}_success").alias("old"), F.col(f"{b}_success").alias("new"), F.col(n).alias("transition")) for n, a, b in rows])
    return pairs.select("task_id", "trial", F.explode(many).alias("c")).select("c.comparison", "task_id", "trial", "c.old", "c.new", "c.transition")


def transition_matrix(compared: DataFrame, most: int = 4) -> DataFrame:
    """Tasks by successes before and after, dense: ``comparison, old_success, new_0..new_most``."""
    per_task = compared.groupBy("comparison", "task_id").agg(F.count_if("old").alias("old_success"), F.count_if("new").alias("k"))
    wide = per_task.groupBy("comparison", "old_success").agg(*[F.count_if(F.col("k") == i).alias(f"new_{i}") for i in range(most + 1)])
    grid = compared.select("comparison").distinct().withColumn("old_success", F.explode(F.sequence(F.lit(0), F.lit(most)).cast("array<bigint>")))
    return grid.join(wide, ["comparison", "old_success"], "left").na.fill(0)


def task_transitions(compared: DataFrame) -> DataFrame:
    """Per comparison and task: successes, delta, trials that flipped, change class and review priority."""
    flips = lambda t: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("transition") == t, F.col("trial")))), lambda x: x.cast("string")), ",")
    per = compared.groupBy("comparison", "task_id").agg(
        F.count("*").alias("trials"), F.count_if("old").alias("old_success"), F.count_if("new").alias("new_success"), flips("improved").alias("improved_trials"), flips("regressed").alias("regressed_trials")
    )
    delta = F.col("new_success") - F.col("old_success")
    change = F.when(delta > 0, "improved").when(delta < 0, "regressed").when((F.col("improved_trials") != "") | (F.col("regressed_trials") != ""), "net_zero_flip").otherwise("unchanged")
    lost_all = (F.col("old_success") == F.col("trials")) & (F.col("new_success") == 0)
    priority = F.when(lost_all | (delta <= -2), "P0").when(delta < 0, "P1").when(F.col("regressed_trials") != "", "P2").otherwise("")
    return per.withColumn("delta", delta).withColumn("change", change).withColumn("priority", priority).withColumn("old_group", group_type(F.col("trials"), F.col("old_success"))).withColumn("new_group", group_type(F.col("trials"), F.col("new_success")))


def call_features(calls: DataFrame) -> DataFrame:
    """Per trajectory: calls, errors by family, repeats of the same call, and such repeats at once.

    Sameness is name and canonical JSON.  Calls delivered again count once.
    Repeats come from counts per signature; only the adjacency needs an order.
    """
    sig = F.xxhash64(F.coalesce("name", F.lit("")), F.coalesce(canonical_json(F.col("arguments")), "arguments", F.lit("")))
    once = distinct_calls(calls).select("trajectory_id", "message_index", "call_pos", "family", F.coalesce("error", F.lit(False)).alias("error"), sig.alias("sig"))
    w = Window.partitionBy("trajectory_id").orderBy("message_index", "call_pos")
    marked = once.withColumn("again", (F.lag("sig").over(w) == F.col("sig")))
    return marked.groupBy("trajectory_id").agg(
        F.count("*").alias("total_calls"), F.count_if("error").alias("tool_errors"), F.count_if(F.col("error") & (F.col("family") == "read")).alias("read_errors"), F.count_if(F.col("error") & (F.col("family") == "write")).alias("write_errors"),
        (F.count("*") - F.count_distinct("sig")).alias("exact_repeated_calls"), F.count_if(F.coalesce("again", F.lit(False))).alias("consecutive_exact_retries"),
    )


def runtime_rows(sims: DataFrame) -> DataFrame:
    """``sims`` with messages counted by role, calls and errors, in place of the messages.

    ``duration``, ``reward`` and ``messages`` are given; where messages have
    ``usage``, the tokens that agent and user read and wrote are summed too.
    Columns such as costs are kept.
    """
    m = F.coalesce(F.col("messages"), F.array().cast(sims.schema["messages"].dataType))
    of = lambda r: F.filter(m, lambda x: x["role"].eqNullSafe(F.lit(r)))
    calls = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.coalesce(F.size(x["tool_calls"]), F.lit(0)), F.lit(0)))
    counts = {f"{r}_messages": F.size(of(r)) for r in ("assistant", "user", "tool")} | {"tool_calls": calls, "tool_errors": F.size(F.filter(of("tool"), lambda x: F.coalesce(x["error"], F.lit(False))))}
    if "usage" in sims.schema["messages"].dataType.elementType.fieldNames():
        read = lambda r, part: F.aggregate(F.transform(of(r), lambda x: x["usage"][part].cast("long")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
        counts |= {f"{who}_{way}_tokens": read(r, part) for who, r in (("agent", "assistant"), ("user", "user")) for way, part in (("input", "prompt_tokens"), ("output", "completion_tokens"))}
    kept = [c for c in sims.columns if c not in ("messages", "duration", "reward")]
    return sims.select(*kept, F.round("duration", 3).alias("duration_seconds"), F.col("reward").alias("env_reward"), *[c.cast("long").alias(n) for n, c in counts.items()])


def missing_trials(rows: DataFrame, label: str, labels: Sequence[str], trials: int) -> DataFrame:
    """``label, task_id, missing``: of every task that any label has, the trials (0 to ``trials`` - 1) that a label lacks, if any."""
    known = rows.filter(F.col(label).isin(list(labels)) & F.col("task_id").isNotNull())
    grid = known.select("task_id").distinct().select(F.explode(F.array(*[F.lit(v) for v in labels])).alias(label), "task_id")
    have = known.groupBy(label, "task_id").agg(F.collect_set(F.col("trial").cast("int")).alias("have"))
    gaps = F.array_except(F.sequence(F.lit(0), F.lit(trials - 1)), F.coalesce("have", F.array().cast("array<int>")))
    return grid.join(have, [label, "task_id"], "left").select(label, "task_id", gaps.alias("gaps")).filter("size(gaps) > 0").select(label, "task_id", F.array_join(F.array_sort("gaps"), ",").alias("missing"))


def call_recoveries(calls: DataFrame) -> DataFrame:
    """``trajectory_id, recovery`` of each failed or unanswered call, as far as calls alone tell: what the next call is."""
    doc = F.coalesce(canonical_json(F.col("arguments")), "arguments", F.lit(""))
    once = distinct_calls(calls).select("trajectory_id", "message_index", "call_pos", "name", "error", "response_message_index", F.xxhash64(doc).alias("doc"))
    w = Window.partitionBy("trajectory_id").orderBy("message_index", "call_pos")
    nx = F.col("nx")
    seen = once.withColumn("nx", F.lead(F.struct("name", "doc")).over(w)).filter(F.col("response_message_index").isNull() | F.coalesce("error", F.lit(False)))
    kind = F.when(F.col("response_message_index").isNull(), "missing_response").when(nx.isNull(), "abandon").when(~nx["name"].eqNullSafe(F.col("name")), "alternate_tool").when(nx["doc"] == F.col("doc"), "exact_retry").otherwise("corrected_retry")
    return seen.select("trajectory_id", kind.alias("recovery"))


def _counted_json(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``key, out``: how often each value occurs, as a JSON object with sorted keys."""
    per = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).alias("k"), "n")))  # the different values of one trajectory
    return per.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias(out))


def full_features(runs: DataFrame, calls: DataFrame, references: DataFrame) -> DataFrame:
    """``runs`` with all that its calls tell: counts by family, errors, repeats, sequence, error messages, recoveries, writes against the task's reference, flags.

    ``references(task_id, name)`` are a task's reference writes.  A trajectory
    without calls has counts of 0 and empty texts.
    """
    once = distinct_calls(calls)
    fam = lambda f: F.count_if(F.col("family") == f)
    bad = F.coalesce("error", F.lit(False))
    step = F.struct("message_index", "call_pos", "name")
    per = once.groupBy("trajectory_id").agg(
        F.count("*").alias("tool_calls"), fam("read").alias("read_calls"), fam("write").alias("write_calls"), fam("other").alias("utility_calls"), fam("transfer").alias("transfer_calls"), F.count_if(bad).alias("tool_errors"),
        F.count_if(bad & (F.col("family") == "read")).alias("read_errors"), F.count_if(bad & (F.col("family") == "write")).alias("write_errors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda c: F.coalesce(c["name"], F.lit(""))), " -> ").alias("tool_sequence"), F.array_sort(F.collect_set(F.when(F.col("family") == "write", F.col("name")))).alias("written"),
    )
    told = _counted_json(once.filter(bad).select("trajectory_id", "error_text"), "trajectory_id", "error_text", "error_messages")
    after = _counted_json(call_recoveries(calls), "trajectory_id", "recovery", "error_recoveries")
    wanted = references.groupBy("task_id").agg(F.array_sort(F.collect_set("name")).alias("wanted"))
    none = F.array().cast("array<string>")
    joined = runs.join(per, "trajectory_id", "left").join(told, "trajectory_id", "left").join(after, "trajectory_id", "left").join(wanted, "task_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("tool_calls", "read_calls", "write_calls", "utility_calls", "transfer_calls", "tool_errors", "read_errors", "write_errors")}
    have, want = F.coalesce("written", none), F.coalesce("wanted", none)
    full = joined.withColumns({**counts, "tool_sequence": F.coalesce("tool_sequence", F.lit("")), "error_messages": F.coalesce("error_messages", F.lit("{}")), "error_recoveries": F.coalesce("error_recoveries", F.lit("{}")), "unobserved_reference_writes": F.array_join(F.array_except(want, have), " | "), "nonreference_writes": F.array_join(F.array_except(have, want), " | ")})
    end = F.coalesce("termination_reason", F.lit(""))
    flags = [
        (~end.isin("user_stop", "agent_stop", ""), F.concat(F.lit("abnormal_termination:"), end)), (F.col("write_errors") > 0, F.lit("write_tool_error")), (F.coalesce("exact_repeated_calls", F.lit(0)) > 0, F.lit("exact_repeated_call")),
        (F.col("transfer_calls") > 0, F.lit("transfer_to_human")), (F.col("read_errors") > 0, F.lit("read_tool_error_needs_review")),
    ]
    return full.withColumn("diagnostic_flags", F.array_join(F.array_compact(F.array(*[F.when(t, n) for t, n in flags])), " | ")).drop("written", "wanted")


def side_by_side(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key with every label's columns, ``<label>_<column>``; null where a label has no row."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == v, F.col(c))).alias(f"{v}_{c}") for v in labels for c in columns])


def distinct_calls(calls: DataFrame) -> DataFrame:
    """Each call once, by its id: the row that came first."""
    rest = [c for c in calls.columns if c not in ("trajectory_id", "call_id")]
    firsts = calls.groupBy("trajectory_id", "call_id").agg(F.min_by(F.struct(*rest), F.struct("ingested_at", "message_index", "call_pos")).alias("r"))
    return firsts.select("trajectory_id", "call_id", *[F.col("r")[c].alias(c) for c in rest])


def tool_errors(calls: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Calls and errors by cohort at three levels: all, family and tool.

    ``cohorts(trajectory_id, cohort)`` may list a trajectory in several.  The
    number of trajectories counts those without calls too.
    """
    sizes = cohorts.groupBy("cohort").agg(F.count_distinct("trajectory_id").alias("trajectories"))
    rows = distinct_calls(calls).select("trajectory_id", "task_id", "family", "name", F.coalesce("error", F.lit(False)).alias("error")).join(cohorts.distinct(), "trajectory_id")
    # Distinct trajectories and tasks: one row each and tool first, so the sets shuffle once in small form.
    per = rows.groupBy("cohort", "family", "name", "trajectory_id", "task_id").agg(F.count("*").alias("n"), F.count_if("error").alias("e"))
    levels = per.groupingSets([["cohort"], ["cohort", "family"], ["cohort", "family", "name"]], "cohort", "family", "name").agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("calls"), F.sum("e").alias("errors"), F.count_distinct(F.when(F.col("e") > 0, F.col("trajectory_id"))).alias("affected_trajectories"), F.count_distinct(F.when(F.col("e") > 0, F.col("task_id"))).alias("affected_tasks")
    )
    level = F.when(F.col("family").isNull(), "all").when(F.col("name").isNull(), "family").otherwise("tool")
    return levels.join(sizes, "cohort").select("cohort", level.alias("level"), F.coalesce("family", F.lit("")).alias("family"), F.coalesce("name", F.lit("")).alias("tool"), "trajectories", "calls", "errors", F.round(ratio(F.col("errors") * 100, F.col("calls")), 4).alias("errors_per_100"), "affected_trajectories", "affected_tasks")


def error_messages(calls: DataFrame) -> DataFrame:
    """How often each normalised error message occurs: ``message, calls``."""
    return distinct_calls(calls).filter("error").groupBy(normalize_error(F.col("error_text")).alias("message")).agg(F.count("*").alias("calls"))


def model_overview(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Per model: trajectories, successes, averages, errors per 100 calls, abnormal ends."""
    per = distinct_calls(calls).groupBy("trajectory_id").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"))
    joined = runs.join(per, "trajectory_id", "left").na.fill(0, ["calls", "errors"])
    return joined.groupBy("model_label").agg(
        F.count("*").alias("trajectories"), F.count_if(is_successful(F.col("reward"))).alias("successes"), F.round(F.avg("reward"), 6).alias("avg_reward"), F.round(F.avg("calls"), 6).alias("avg_calls"),
        F.round(F.avg("assistant_turns"), 6).alias("avg_turns"), F.round(F.avg("completion_tokens"), 6).alias("avg_completion_tokens"), F.round(ratio(F.sum("errors") * 100, F.sum("calls")), 4).alias("errors_per_100"),
        F.count_if(~F.col("termination_reason").isin("user_stop", "agent_stop")).alias("abnormal_terminations"),
    )


def runtime_summary(runs: DataFrame, key: str) -> DataFrame:
    """Durations by ``key``: mean, median, nearest-rank p90; infrastructure errors count but aren't timed."""
    timed = F.when(~F.col("termination_reason").eqNullSafe(F.lit("infrastructure_error")), F.col("duration_seconds"))
    return runs.groupBy(key).agg(
        F.count("*").alias("tasks"), F.count_if(F.col("reward") == 1.0).alias("successes"), F.count_if(F.col("termination_reason") == "infrastructure_error").alias("infrastructure_errors"),
        F.round(F.avg(timed), 6).alias("mean_seconds"), F.round(F.percentile(timed, 0.5), 6).alias("median_seconds"), F.expr("percentile_disc(0.9) within group (order by case when not (termination_reason <=> 'infrastructure_error') then duration_seconds end)").alias("p90_seconds"),
    )
