"""Queries over fuller forms of operators: session replay, run audits, step lines, attempts, runtime rows, scan reports; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators import curation as cu
from logloom.operators import datasets as ds
from logloom.operators import evaluation as ev
from logloom.operators import facts as fc
from logloom.operators import rollout as ro
from logloom.operators.ordering import group_positions
from logloom.plans.curation import _N, newest
from logloom.plans.datasets import _SPANS, _spans
from logloom.plans.evaluation import _RUNS, runs
from logloom.plans.training import _metrics_sql, agg_24_step_metrics
from logloom.session import latest, table, task_number


def prj_02_audit_reference(spark: SparkSession, d: str) -> DataFrame:
    """What a task is checked against: its reward model and its orders, arrays never null."""
    t = table(spark, d, "tasks").filter("task_id IS NOT NULL")
    orders = F.array_join(F.array_sort(F.coalesce("order_ids", F.array().cast("array<string>"))), ",")
    return t.select("task_id", F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("ground_truth"), orders.alias("orders")).distinct()


def prj_07_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a judge is shown of each hard pass, as one JSON text (its hash)."""
    rows = newest(spark, d, "messages", "screening", "stats").filter("screening.hard_pass")
    payload = F.to_json(F.struct("trajectory_id", F.coalesce(cu.text_of(F.col("messages")), F.lit("")).alias("conversation"), F.coalesce("stats.tool_error_count", F.lit(0)).alias("tool_errors")))
    return rows.select("trajectory_id", F.md5(payload).alias("payload_md5"))


def prj_11_message_counts(spark: SparkSession, d: str) -> DataFrame:
    """Runtime rows: messages by role, calls and errors of each simulation with its reward and duration."""
    rows = newest(spark, d, "task_id", "trial", "seed", "outcome", "messages")
    return ev.runtime_rows(rows.select("trajectory_id", task_number(F.col("task_id")).alias("task_id"), "trial", "seed", F.col("outcome.duration_seconds").alias("duration"), F.col("outcome.termination_reason").alias("termination_reason"), F.col("outcome.reward").alias("reward"), "messages"))


def prj_13_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nested values by path, null where any step is missing; a place in a list is a step too."""
    v = F.try_parse_json("outcome.reward_breakdown")
    at = {"db_match": "$.DB.match", "db_score": "$.DB.score", "first_env": "$.ENV_ASSERTION[0]", "first_check": "$.COMMUNICATE.checks[0].info", "expected": "$.ACTION.expected"}
    kind = {"db_match": "string", "first_check": "string"}
    return newest(spark, d, "outcome").select("trajectory_id", *[F.try_variant_get(v, p, kind.get(n, "double")).alias(n) for n, p in at.items()])


def prj_21_step_summary(spark: SparkSession, d: str) -> DataFrame:
    """Two lines for each model's step, from its metrics; what isn't measured is 0."""
    return ro.step_lines(agg_24_step_metrics(spark, d), ["model_label"], 1)


def flt_14_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose rows disagree in seed, origin or scenario: such runs can't be compared."""
    rows = table(spark, d, "tasks").filter("task_id IS NOT NULL")
    per = rows.groupBy("task_id").agg(F.count_distinct("tau2_seed").alias("seeds"), F.count_distinct(F.to_json("instructions")).alias("scenarios"))
    return per.filter("seeds > 1 OR scenarios > 1")


def flt_19_over_limit(spark: SparkSession, d: str) -> DataFrame:
    """Each kind's longest text against a limit of 4,096: the length to train with, or none where it is too long."""
    longest = table(spark, d, "documents").groupBy("kind").agg(F.max("n_chars").alias("longest"))
    return longest.select("kind", "longest", ds.training_length(F.col("longest"), 512, 4096).alias("max_length"))


def src_04_task_sets(spark: SparkSession, d: str) -> DataFrame:
    """Trials that a model lacks of those that the first one has, by task: four are expected of each."""
    rows = ev.one_per_trial(runs(spark, d))
    return ev.missing_trials(rows, "model_label", ["sft", "vanilla", "potential"], 4)


def stm_02_replay(spark: SparkSession, d: str) -> DataFrame:
    """Sessions replayed message by message: where and why each would have ended (three errors, or thirty messages), or that it runs on."""
    rows = newest(spark, d, "messages").select("trajectory_id", F.posexplode("messages").alias("pos", "m"))
    events = rows.select("trajectory_id", "pos", (F.col("m.role").eqNullSafe(F.lit("tool")) & F.coalesce("m.error", F.lit(False))).alias("error"))
    return ro.replayed_ends(events, "trajectory_id", "pos", "error", most_errors=3, most_steps=30)


def stm_03_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each candidate as attempts: how many differ in their judgement, and the last decision."""
    rows = table(spark, d, "candidates").filter("trajectory_id IS NOT NULL").select("trajectory_id", "ingested_at", F.col("semantic_screening.decision").alias("decision"), F.col("semantic_screening.confidence").alias("confidence"))
    per = rows.groupBy("trajectory_id").agg(F.count("*").alias("attempts"), F.count_distinct("decision").alias("decisions"))
    return per.join(latest(rows.select("trajectory_id", "ingested_at", "decision"), ["trajectory_id"], "ingested_at").select("trajectory_id", "decision"), "trajectory_id")


def agg_12_scan_report(spark: SparkSession, d: str) -> DataFrame:
    """The scan of a text dataset as one long table: extremes, mean, percentiles and bins of lengths by kind."""
    rows = table(spark, d, "documents").filter("n_chars IS NOT NULL").select("kind", "n_chars")
    figures = ds.numeric_summary(rows, ["kind"], "n_chars")
    names = ["least", "most", "mean", "median", "p75", "p90", "p95", "p99"]
    long = figures.select("kind", F.expr(f"stack({len(names)}, {', '.join(f"'{n}', cast({n} as double)" for n in names)}) as (figure, value)"))
    binned = rows.groupBy("kind", ds.length_bin(F.col("n_chars")).alias("b")).agg(F.count("*").cast("double").alias("value"))
    return long.unionByName(binned.select("kind", F.concat(F.lit("bin "), F.col("b").cast("string")).alias("figure"), "value"))


def agg_27_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Each run's candidates with their range of seeds, trials and temperatures."""
    rows = newest(spark, d, "source_run", "trial", "seed", "temperature")
    return rows.groupBy("source_run").agg(F.count("*").alias("candidates"), F.min("seed").alias("least_seed"), F.max("seed").alias("most_seed"), F.count_distinct("trial").alias("trials"), F.count_distinct("temperature").alias("temperatures"))


def aux_06_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and trials in order, numbers before other texts, with their place."""
    keys = runs(spark, d).filter("task_id IS NOT NULL AND trial IS NOT NULL").select("task_id", "trial").distinct()
    number = F.col("task_id").try_cast("bigint")
    ready = keys.select("task_id", "trial", number.isNull().alias("t"), number.alias("n"))
    return group_positions(ready, None, [F.col("t").asc(), F.col("n").asc(), F.col("task_id").asc(), F.col("trial").asc()], "place").select("task_id", "trial", "place")


def aux_40_local_signal(spark: SparkSession, d: str) -> DataFrame:
    """Whether a trajectory has a local signal: any turn with progress or an error."""
    spans = _spans(spark, d).groupBy("trajectory_id").agg(F.collect_list(F.struct("progress", "fact", "error")).alias("spans"))  # one trajectory's turns
    return spans.select("trajectory_id", ro.has_local_signal(F.col("spans")).alias("local_signal"))


def jon_06_full_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's similarity to the best-ranked one of its task, by text and by trace."""
    rows = newest(spark, d, "task_id", "screening", "messages").filter("size(messages) > 0").select("trajectory_id", task_number(F.col("task_id")).alias("task_id"), F.col("screening.task_rank").alias("task_rank"), cu.grams(F.col("messages")).alias("grams"), cu.trace(F.col("messages")).alias("trace")).filter("task_id IS NOT NULL")
    best = rows.groupBy("task_id").agg(F.min_by(F.struct("trajectory_id", "grams", "trace"), F.struct(F.coalesce("task_rank", F.lit(1 << 30)), "trajectory_id")).alias("b"))
    joined = rows.join(best, "task_id")
    return joined.select("trajectory_id", F.col("b.trajectory_id").alias("best_id"), F.round(0.75 * tx.jaccard(F.col("grams"), F.col("b.grams")) + 0.25 * cu.match_ratio(F.col("trace"), F.col("b.trace")), 6).alias("similarity"))


def jon_12_changed_leaves(spark: SparkSession, d: str) -> DataFrame:
    """What judging a candidate anew changed in its judgement: leaves that are new or different, and leaves that are gone."""
    rows = table(spark, d, "candidates").filter("trajectory_id IS NOT NULL AND ingested_at IS NOT NULL").select("trajectory_id", "ingested_at", F.to_json("semantic_screening").alias("doc")).filter("doc <> '{}'")
    ends = rows.groupBy("trajectory_id").agg(F.min_by("doc", "ingested_at").alias("old"), F.max_by("doc", "ingested_at").alias("new")).filter("old <> new")
    found = fc.changed_leaves(fc.leaf_rows(ends, "trajectory_id", "old"), fc.leaf_rows(ends, "trajectory_id", "new"), "trajectory_id")
    return found.groupBy("trajectory_id").agg(F.count_if(F.col("vtype").isNotNull()).alias("changed"), F.count_if(F.col("vtype").isNull()).alias("gone"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import re

    return {k: v for k, v in globals().items() if callable(v) and v.__module__ == __name__ and re.match(r"(src|prj|flt|jon|agg|stm|aux)_\d+_", k)}


def oracle_sql() -> dict[str, str]:
    said = "array_to_string(list_transform(list_filter(messages, lambda m: m.role in ('user', 'assistant') and m.content <> ''), lambda m: m.content), ' ')"
    role = lambda r: f"len(list_filter(coalesce(messages, []), lambda m: m.role = '{r}'))"
    metric = lambda name: f"coalesce(max(case when metric = '{name}' then value end), 0)::bigint"
    figures = "min(n_chars)::double as least, max(n_chars)::double as most, round(avg(n_chars), 6) as mean, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 6)::double as {n}" for n, p in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return {
        "jon_12_changed_leaves": "with r as (select trajectory_id, ingested_at, semantic_screening as s from candidates where trajectory_id is not null and ingested_at is not null and (semantic_screening.decision is not null or semantic_screening.confidence is not null or semantic_screening.judge_model is not null or semantic_screening.prompt_version is not null)), e as (select trajectory_id, arg_min(s, ingested_at) as o, arg_max(s, ingested_at) as n from r group by 1), k as (select trajectory_id, "
        + " + ".join(f"case when n.{c} is not null and o.{c} is distinct from n.{c} then 1 else 0 end" for c in ("decision", "confidence", "judge_model", "prompt_version"))
        + " as changed, "
        + " + ".join(f"case when o.{c} is not null and n.{c} is null then 1 else 0 end" for c in ("decision", "confidence", "judge_model", "prompt_version"))
        + " as gone from e) select * from k where changed + gone > 0",
        "prj_02_audit_reference": "select distinct task_id, reward_model.style as style, reward_model.ground_truth as ground_truth, array_to_string(list_sort(list_filter(coalesce(order_ids, []), lambda x: x is not null)), ',') as orders from tasks where task_id is not null",
        "prj_07_payload": f"with {_N} select trajectory_id, md5(json_object('trajectory_id', trajectory_id, 'conversation', coalesce({said}, ''), 'tool_errors', coalesce(stats.tool_error_count, 0))::varchar) as payload_md5 from l where screening.hard_pass",
        "prj_11_message_counts": f"with {_N} select trajectory_id, cast(try_cast(regexp_extract(task_id, '([0-9]+)', 1) as bigint) as varchar) as task_id, trial, seed, round(outcome.duration_seconds, 3) as duration_seconds, outcome.termination_reason as termination_reason, outcome.reward as env_reward, {role('assistant')} as assistant_messages, {role('user')} as user_messages, {role('tool')} as tool_messages, coalesce(list_sum(list_transform(coalesce(messages, []), lambda m: len(coalesce(m.tool_calls, [])))), 0)::bigint as tool_calls, len(list_filter(coalesce(messages, []), lambda m: m.role = 'tool' and coalesce(m.error, false))) as tool_errors from l",
        "prj_13_paths": f"with {_N}, v as (select trajectory_id, case when json_valid(outcome.reward_breakdown) then outcome.reward_breakdown end as b from l) select trajectory_id, json_extract_string(b, '$.DB.match') as db_match, try_cast(json_extract_string(b, '$.DB.score') as double) as db_score, try_cast(json_extract_string(b, '$.ENV_ASSERTION[0]') as double) as first_env, json_extract_string(b, '$.COMMUNICATE.checks[0].info') as first_check, try_cast(json_extract_string(b, '$.ACTION.expected') as double) as expected from v",
        "prj_21_step_summary": f"with m as ({_metrics_sql()}) select model_label, '[step 1] reward ' || {metric('reward/success_count')} || '/' || {metric('rollout/valid_trajectories')} || ' | mixed ' || {metric('grpo/mixed_group_count')} || '/' || {metric('grpo/group_count')} || ' | rollout 0.0s | retries ' || {metric('infra/retry_attempt_count')} as first_line, '[step 1] ref 0.0s | actor 0.0s | KL 0.0000 | sync 0.0s | checkpoint 0.0s | total 0.0s | micro_batches 0 | MFU 0.0% | peak 0.0GB' as second_line from m group by 1",
        "flt_14_definitions": "select task_id, count(distinct tau2_seed) as seeds, count(distinct instructions::varchar) as scenarios from tasks where task_id is not null group by 1 having count(distinct tau2_seed) > 1 or count(distinct instructions::varchar) > 1",
        "flt_19_over_limit": "select kind, max(n_chars) as longest, case when ceil(max(n_chars) / 512.0) * 512 <= 4096 then (ceil(max(n_chars) / 512.0) * 512)::bigint end as max_length from documents group by 1",
        "src_04_task_sets": f"with {_RUNS}, p as (select distinct model_label, task_id, trial from f where task_id is not null and reward is not null), t as (select distinct task_id from p where model_label in ('sft', 'vanilla', 'potential')), e as (select m as model_label, task_id, k as trial from t, (values ('sft'), ('vanilla'), ('potential')) as a(m), (values (0), (1), (2), (3)) as b(k)) select e.model_label, e.task_id, array_to_string(list_sort(list(e.trial)), ',') as missing from e left join p on p.model_label = e.model_label and p.task_id = e.task_id and p.trial = e.trial where p.trial is null group by 1, 2",
        "stm_02_replay": f"with {_N}, u as (select trajectory_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages) as m from l), e as (select trajectory_id, pos, sum(case when m.role = 'tool' and coalesce(m.error, false) then 1 else 0 end) over (partition by trajectory_id order by pos rows unbounded preceding) as errors from u), h as (select trajectory_id, pos, case when errors >= 3 then 'too_many_errors' when pos + 1 >= 30 then 'max_steps' end as reason from e), r as (select trajectory_id, min(pos) filter (reason is not null) as ended_at, arg_min(reason, pos) filter (reason is not null) as reason from h group by 1) select trajectory_id, ended_at, coalesce(reason, 'running') as reason from r",
        "stm_03_attempts": f"with {_N}, c as (select trajectory_id, count(*) as attempts, count(distinct semantic_screening.decision) as decisions from candidates where trajectory_id is not null group by 1) select c.*, l.semantic_screening.decision as decision from c join l using (trajectory_id)",
        "agg_12_scan_report": f"with r as (select kind, n_chars from documents where n_chars is not null), g as (select kind, {figures} from r group by 1) select kind, figure, value from (unpivot g on least, most, mean, median, p75, p90, p95, p99 into name figure value value) union all select kind, 'bin ' || case when n_chars <= 4096 then '00000-04096' when n_chars <= 8192 then '04097-08192' when n_chars <= 12288 then '08193-12288' when n_chars <= 16384 then '12289-16384' else '>16384' end, count(*)::double from r group by 1, 2",
        "agg_27_lineage": f"with {_N} select source_run, count(*) as candidates, min(seed) as least_seed, max(seed) as most_seed, count(distinct trial) as trials, count(distinct temperature) as temperatures from l group by 1",
        "aux_06_key_order": f"with {_RUNS}, k as (select distinct task_id, trial from f where task_id is not null and trial is not null) select task_id, trial, row_number() over (order by try_cast(task_id as bigint) is null, try_cast(task_id as bigint), task_id, trial) as place from k",
        "aux_40_local_signal": f"with {_SPANS} select trajectory_id, bool_or(progress <> 0 or fact <> 0 or error) as local_signal from sp group by 1",
    }
