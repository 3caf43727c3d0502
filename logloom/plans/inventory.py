"""Queries over the smaller operators: projections, limits, joins, orders, facts; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions.numbers import ratio
from logloom.operators import curation as cu
from logloom.operators import datasets as ds
from logloom.operators import evaluation as ev
from logloom.operators import facts as fc
from logloom.operators import ordering
from logloom.plans.curation import _N, _TRAIN, GREETINGS, SYSTEM, newest
from logloom.plans.evaluation import _ONCE, _PICK, _RUNS, runs
from logloom.session import table, task_number


def prj_02_task_spec(spark: SparkSession, d: str) -> DataFrame:
    """The parts of a task's scenario, arrays never null."""
    t = table(spark, d, "tasks").filter("task_id IS NOT NULL")
    return t.select("task_id", F.col("instructions.reason_for_call").alias("reason_for_call"), F.col("instructions.unknown_info").alias("unknown_info"), F.size(F.coalesce("order_ids", F.array().cast("array<string>"))).cast("long").alias("orders")).distinct()


def prj_04_chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages in chat format: calls nested as functions; a call on another role than assistant is flagged."""
    rows = newest(spark, d, "messages").select("trajectory_id", F.posexplode("messages").alias("pos", "m"))
    calls = F.transform(cu._calls(F.col("m")), lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    names = F.array_join(F.transform(calls, lambda c: F.concat(c["type"], F.lit(":"), F.coalesce(c["function"]["name"], F.lit("")))), ",")
    return rows.select("trajectory_id", F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"), names.alias("calls"), ((F.size(calls) > 0) & ~F.col("m.role").eqNullSafe(F.lit("assistant"))).alias("misplaced"))


def prj_06_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows: ids, number of messages and the metadata as JSON."""
    rows = cu.training_messages(newest(spark, d, "task_id", "tier", "source_run", "messages"), GREETINGS, SYSTEM)
    meta = F.concat(F.lit('{"source_run":"'), F.coalesce("source_run", F.lit("")), F.lit('","tier":"'), F.coalesce("tier", F.lit("")), F.lit('"}'))
    return rows.select("trajectory_id", task_number(F.col("task_id")).alias("task_id"), F.size("messages").cast("long").alias("messages"), meta.alias("metadata"))


def prj_07_judge_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a judge is shown of each hard pass: how many characters of conversation, and how many errors."""
    rows = newest(spark, d, "messages", "screening", "stats").filter("screening.hard_pass")
    return rows.select("trajectory_id", F.length(cu.text_of(F.col("messages"))).cast("long").alias("characters"), F.col("stats.tool_error_count").alias("tool_errors"))


def prj_08_wide_features(spark: SparkSession, d: str) -> DataFrame:
    """Each task and trial with all models' features side by side."""
    picked = ev.one_per_trial(runs(spark, d))
    wide = [F.max(F.when(F.col("model_label") == m, F.col(c))).alias(f"{m}_{c}") for m in ("sft", "vanilla", "potential") for c in ("reward", "assistant_turns", "completion_tokens", "exact_repeated_calls")]
    return picked.groupBy("task_id", "trial").agg(*wide)


def prj_09_review_trace(spark: SparkSession, d: str) -> DataFrame:
    """Tool messages with the tool they answer, ``unknown`` where no call has their id."""
    rows = newest(spark, d, "messages").select("trajectory_id", "messages", F.posexplode("messages").alias("pos", "m")).filter("m.role = 'tool'")
    calls = F.flatten(F.transform("messages", lambda x: cu._calls(x)))
    name = F.get(F.filter(calls, lambda c: c["id"] == F.col("m.tool_call_id")), F.lit(0))["name"]
    return rows.select("trajectory_id", F.col("pos").cast("long").alias("pos"), F.coalesce(name, F.lit("unknown")).alias("tool_name"))


def prj_11_runtime_rows(spark: SparkSession, d: str) -> DataFrame:
    return newest(spark, d, "outcome", "stats").select("trajectory_id", F.round(F.col("outcome.duration_seconds"), 3).alias("duration_seconds"), F.col("stats.message_count").alias("messages"), F.col("stats.tool_call_count").alias("tool_calls"), F.col("stats.tool_error_count").alias("tool_errors"), ratio(F.col("stats.tool_error_count") * 100, F.col("stats.tool_call_count")).alias("errors_per_100"))


def prj_13_nested_values(spark: SparkSession, d: str) -> DataFrame:
    """A nested value, null where any step of the path is missing."""
    v = F.try_variant_get(F.try_parse_json("outcome.reward_breakdown"), "$.DB.score", "double")
    return newest(spark, d, "outcome").select("trajectory_id", v.alias("db_score"))


def prj_16_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Tasks without what names a person."""
    rows = table(spark, d, "tasks").filter("task_id IS NOT NULL").withColumn("instructions", F.col("instructions").dropFields("known_info", "unknown_info"))
    return rows.select("task_id", F.to_json("instructions").alias("instructions")).distinct()


def prj_21_step_lines(spark: SparkSession, d: str) -> DataFrame:
    per = runs(spark, d).groupBy("model_label", "trial").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 3).alias("r"))
    return per.select(F.format_string("step %d | %s | runs %d | reward %.3f", "trial", "model_label", "n", "r").alias("line"))


def flt_05_strict_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_records").select("record_id", F.coalesce(F.try_parse_json("body").isNotNull(), F.lit(False)).alias("strict"))


def flt_06_message_rules(spark: SparkSession, d: str) -> DataFrame:
    """Messages that break the rules of their role, by role and rule."""
    m = F.col("m")
    blank = F.length(F.trim(F.coalesce(m["content"], F.lit("")))) == 0
    calls = F.size(cu._calls(m))
    rule = (
        F.when(m["role"].isin("system", "user") & blank, "blank content").when((m["role"] == "assistant") & blank & (calls == 0), "neither text nor call").when((m["role"] == "assistant") & ~blank & (calls > 0), "text and call")
        .when((m["role"] == "assistant") & (calls > 1), "several calls").when((m["role"] == "tool") & (F.length(F.coalesce(m["tool_call_id"], F.lit(""))) == 0), "no call id").when(~F.coalesce(m["role"].isin("system", "user", "assistant", "tool"), F.lit(False)), "unknown role")
    )
    rows = newest(spark, d, "messages").select(F.explode("messages").alias("m")).select(m["role"].alias("role"), rule.alias("rule")).filter("rule IS NOT NULL")
    return rows.groupBy("role", "rule").agg(F.count("*").alias("messages"))


def flt_14_alignment(spark: SparkSession, d: str) -> DataFrame:
    """What keeps two models' runs from being compared: keys that one lacks, and different endings."""
    key = lambda m: ev.one_per_trial(runs(spark, d)).filter(F.col("model_label") == m).select("task_id", "trial", F.col("termination_reason").alias(m))
    both = key("sft").join(key("vanilla"), ["task_id", "trial"], "full_outer")
    problem = F.when(F.col("sft").isNull(), "extra").when(F.col("vanilla").isNull(), "missing").when(F.col("sft") != F.col("vanilla"), "ending differs")
    return both.select("task_id", "trial", problem.alias("problem")).filter("problem IS NOT NULL")


def flt_19_max_length(spark: SparkSession, d: str) -> DataFrame:
    """The length to train with: the longest text of each kind, rounded up to 512."""
    longest = table(spark, d, "documents").groupBy("kind").agg(F.max("n_chars").alias("longest"))
    return longest.select("kind", "longest", (F.ceil(F.col("longest") / 512) * 512).cast("long").alias("max_length"))


def flt_22_limits(spark: SparkSession, d: str) -> DataFrame:
    """Why a session would have to stop: errors first, then steps, then time."""
    rows = newest(spark, d, "stats", "outcome")
    why = F.when(F.col("stats.tool_error_count") > 3, "too_many_errors").when(F.col("stats.message_count") > 30, "max_steps").when(F.col("outcome.duration_seconds") > 90, "timeout").otherwise("none")
    return rows.groupBy(why.alias("stop")).agg(F.count("*").alias("sessions"))


def flt_24_id_range(spark: SparkSession, d: str) -> DataFrame:
    """Least and greatest character code of each kind's texts, as a token store checks its ids."""
    codes = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    rows = table(spark, d, "documents").select("kind", codes.alias("c")).filter("size(c) > 0")
    return rows.groupBy("kind").agg(F.min(F.array_min("c")).cast("long").alias("least"), F.max(F.array_max("c")).cast("long").alias("most"))


def jon_01_with_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their task's reason (the latest row of it), by whether there is one."""
    tasks = table(spark, d, "tasks").select(task_number(F.col("task_id")).alias("task_id"), "instructions.reason_for_call", "updated_at").groupBy("task_id").agg(F.max_by(F.struct("reason_for_call"), F.struct("updated_at", "reason_for_call")).alias("t"))
    rows = newest(spark, d, "task_id").select("trajectory_id", task_number(F.col("task_id")).alias("task_id")).filter("task_id IS NOT NULL")
    return rows.join(tasks, "task_id", "left").select("trajectory_id", "task_id", F.col("t.reason_for_call").alias("reason_for_call"))


def jon_02_calls_and_answers(spark: SparkSession, d: str) -> DataFrame:
    """Calls with their answer's state; of answers with one id the last counts, a call without one is no error."""
    messages = newest(spark, d, "messages").select("trajectory_id", F.posexplode("messages").alias("pos", "m"))
    calls = messages.filter("m.role = 'assistant'").select("trajectory_id", "pos", F.explode("m.tool_calls").alias("c")).select("trajectory_id", F.col("pos").cast("long").alias("pos"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"))
    answers = messages.filter("m.role = 'tool' AND m.tool_call_id IS NOT NULL").groupBy("trajectory_id", F.col("m.tool_call_id").alias("call_id")).agg(F.max_by(F.struct(F.coalesce("m.error", F.lit(False)).alias("error"), F.col("m.content").alias("content")), "pos").alias("a"))
    joined = calls.join(answers, ["trajectory_id", "call_id"], "left")
    error = F.coalesce("a.error", F.lit(False))
    return joined.select("trajectory_id", "pos", "call_id", "name", F.col("a").isNotNull().alias("answered"), error.alias("error"), F.when(error, tx.normalize_error(F.col("a.content"))).otherwise("").alias("error_text"))


def jon_08_read_before_write(spark: SparkSession, d: str) -> DataFrame:
    """Whether a lookup of the member came before the first write; null where nothing is written."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls"))
    first = calls.groupBy("trajectory_id").agg(F.min(F.when(F.col("family") == "write", F.col("message_index"))).alias("w"), F.min(F.when(F.col("name").startswith("find_member"), F.col("message_index"))).alias("r"))
    return first.select("trajectory_id", F.when(F.col("w").isNotNull(), F.coalesce(F.col("r") < F.col("w"), F.lit(False))).alias("authenticated_first"))


def agg_22_turns(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy("model_label").agg(F.coalesce(F.sum("assistant_turns"), F.lit(0)).cast("long").alias("turns"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("completion_tokens"), F.coalesce(F.max("completion_tokens"), F.lit(0)).cast("long").alias("most_tokens"))


def agg_33_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of batches of like lengths: least, greatest and mean of rows and characters."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").filter("n_chars IS NOT NULL")
    per = ds.length_batches(rows, "doc_id", "n_chars", 16, 128).groupBy("batch_id").agg(F.count("*").alias("k"), F.sum("n_chars").alias("t"))
    return per.agg(F.min("k").alias("least_rows"), F.max("k").alias("most_rows"), F.min("t").cast("long").alias("least_tokens"), F.max("t").cast("long").alias("most_tokens"), F.round(F.avg("t"), 4).alias("mean_tokens"))


def win_16_kept_range(spark: SparkSession, d: str) -> DataFrame:
    """First and last message that training keeps: behind a greeting, before the user's last words."""
    m = F.col("messages")
    first = F.when((F.get(m, F.lit(0))["role"] == "assistant") & F.get(m, F.lit(0))["content"].isin(GREETINGS), 1).otherwise(0)
    last = F.coalesce(F.array_max(F.transform(m, lambda x, i: F.when(~x["role"].eqNullSafe(F.lit("user")), i))), F.lit(-1))
    return newest(spark, d, "messages").filter("size(messages) > 0").select("trajectory_id", first.cast("long").alias("first"), last.cast("long").alias("last"))


def win_18_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first call at which a trajectory's arguments pass 500 characters in all."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls"))
    w = Window.partitionBy("trajectory_id").orderBy("message_index", "call_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = calls.withColumn("spent", F.sum(F.length("arguments")).over(w)).filter("spent > 500")
    return spent.groupBy("trajectory_id").agg(F.min("message_index").alias("over_at"))


def top_05_eligible(spark: SparkSession, d: str) -> DataFrame:
    """The 100 hard passes judged next: by rank, then task, then id."""
    rows = newest(spark, d, "task_id", "screening").filter("screening.hard_pass AND screening.task_rank IS NOT NULL").select("trajectory_id", task_number(F.col("task_id")).cast("long").alias("task"), F.col("screening.task_rank").alias("task_rank")).filter("task IS NOT NULL")
    return rows.orderBy("task_rank", "task", "trajectory_id").limit(100).select("trajectory_id", "task_rank")


def top_06_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The document at place 7 of the order by id."""
    return table(spark, d, "documents").select("doc_id", "kind").orderBy("doc_id").offset(7).limit(1)


def top_08_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Documents in a seeded random order with their place."""
    rows = table(spark, d, "documents").select("doc_id")
    return ordering.group_positions(rows, None, [F.xxhash64("doc_id", F.lit(7)).asc(), F.col("doc_id").asc()], "place")


def top_10_attribution_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Flips of the first comparison with empty columns to fill in."""
    rows = ev.paired_trials(runs(spark, d), ["sft", "vanilla"]).filter("sft_to_vanilla IN ('improved', 'regressed')")
    return rows.select("task_id", "trial", F.col("sft_to_vanilla").alias("transition"), F.lit("").alias("cause"), F.lit("").alias("notes"))


def str_04_action_families(spark: SparkSession, d: str) -> DataFrame:
    """Which families of writes a task's trajectories use, joined by plus signs."""
    calls = table(spark, d, "tool_calls").filter("task_id IS NOT NULL")
    verb = F.split_part("name", F.lit("_"), F.lit(1))
    per = calls.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") == "write", verb))), "+").alias("f"))
    return per.select("task_id", F.when(F.col("f") == "", "read_or_communication").otherwise(F.col("f")).alias("families"))


def str_12_call_paths(spark: SparkSession, d: str) -> DataFrame:
    """A trajectory's calls in order as one line."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls")).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("message_index", "call_pos", "name"))).alias("c"))
    return calls.select("trajectory_id", F.array_join(F.transform("c", lambda x: x["name"]), " -> ").alias("path"))


def mth_05_shifted_count(spark: SparkSession, d: str) -> DataFrame:
    """Labels that count from the second on: here the characters of each text that are no spaces."""
    labels = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.when(c == " ", -100).otherwise(1))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", ds.supervised(labels, True).cast("long").alias("supervised"))


def jsn_03_decoded_results(spark: SparkSession, d: str) -> DataFrame:
    """Tool results as documents or as plain text."""
    m = newest(spark, d, "messages").select(F.explode("messages").alias("m")).filter("m.role = 'tool'")
    v = F.try_parse_json("m.content")
    kind = F.when(v.isNull(), "text").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("other")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("results"))


def jsn_07_result_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the tool results of a trajectory show: every leaf of a result document under its tool's name."""
    rows = newest(spark, d, "messages").select("trajectory_id", "messages", F.explode("messages").alias("m")).filter("m.role = 'tool' AND startswith(m.content, '{')")
    calls = F.flatten(F.transform("messages", lambda x: cu._calls(x)))
    name = F.get(F.filter(calls, lambda c: c["id"] == F.col("m.tool_call_id")), F.lit(0))["name"]
    named = rows.select(F.concat_ws("|", "trajectory_id", F.coalesce(name, F.lit("unknown"))).alias("key"), F.col("m.content").alias("doc"))
    leaves = fc.leaf_rows(named, "key", "doc").distinct()
    return leaves.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("trajectory_id"), F.split_part("key", F.lit("|"), F.lit(2)).alias("tool"), F.array_join("path", ".").alias("field"), "vtype", "value")


def jsn_11_references(spark: SparkSession, d: str) -> DataFrame:
    """What each task's calls name: orders and items, once each."""
    calls = table(spark, d, "tool_calls").filter("task_id IS NOT NULL AND startswith(arguments, '{')")
    return fc.references(calls, "task_id", "arguments").select("task_id", "ref_kind", "id")


def set_07_task_targets(spark: SparkSession, d: str) -> DataFrame:
    """References of a task that its successful trajectories name and its failed ones don't."""
    calls = table(spark, d, "tool_calls").filter("task_id IS NOT NULL AND startswith(arguments, '{')").select("trajectory_id", "task_id", "arguments")
    good = runs(spark, d).filter("reward IS NOT NULL").select("trajectory_id", (F.col("reward") == 1.0).alias("good")).distinct()
    named = lambda rows: fc.references(rows, "task_id", "arguments")
    joined = calls.join(good, "trajectory_id")
    return named(joined.filter("good")).join(named(joined.filter("NOT good")), ["task_id", "ref_kind", "id"], "left_anti")


def stm_02_replayed_ends(spark: SparkSession, d: str) -> DataFrame:
    """Sessions replayed turn by turn: at which message errors would have ended them (more than two)."""
    rows = newest(spark, d, "messages").select("trajectory_id", F.posexplode("messages").alias("pos", "m"))
    w = Window.partitionBy("trajectory_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("errors", F.count_if((F.col("m.role") == "tool") & F.coalesce("m.error", F.lit(False))).over(w))
    return counted.filter("errors > 2").groupBy("trajectory_id").agg(F.min("pos").cast("long").alias("ended_at"))


def stm_03_last_attempt(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of each candidate: how many, and the last one's time."""
    rows = table(spark, d, "candidates").filter("trajectory_id IS NOT NULL")
    return rows.groupBy("trajectory_id").agg(F.count("*").alias("attempts"), F.max("ingested_at").alias("last_at"))


def aux_07_error_counts(spark: SparkSession, d: str) -> DataFrame:
    calls = ev.distinct_calls(table(spark, d, "tool_calls"))
    hit = lambda f: F.count_if(F.coalesce("error", F.lit(False)) & (F.col("family") == f)).alias(f"{f}_errors")
    return calls.groupBy("trajectory_id").agg(F.count("*").alias("total_calls"), *[F.count_if(F.col("family") == f).alias(f"{f}_calls") for f in ("read", "write")], hit("read"), hit("write"))


def aux_24_turn_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Where a message's own number differs from its place."""
    rows = newest(spark, d, "messages").select("trajectory_id", F.posexplode("messages").alias("pos", "m"))
    return rows.filter(~F.col("pos").eqNullSafe(F.col("m.turn_idx"))).groupBy("trajectory_id").agg(F.count("*").alias("renumbered"))


def aux_35_counters(spark: SparkSession, d: str) -> DataFrame:
    """Characters seen so far, in order of time."""
    rows = table(spark, d, "documents").select("doc_id", "created_at", "n_chars").filter("created_at IS NOT NULL")
    return ordering.group_running_sum(rows, None, [F.col("created_at").asc(), F.col("doc_id").asc()], F.col("n_chars").cast("long"), "seen").select("doc_id", "seen")


def aux_39_group_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows by group key: the task, else the trajectory itself."""
    return table(spark, d, "trajectory_features").groupBy(F.coalesce("task_id", "trajectory_id").alias("group_key")).agg(F.count("*").alias("rows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import re

    return {k: v for k, v in globals().items() if callable(v) and re.match(r"(prj|flt|jon|agg|win|top|str|mth|jsn|set|stm|aux)_\d+_", k)}


_M = "u as (select trajectory_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages) as m from l)"
_TN = "cast(try_cast(regexp_extract(task_id, '([0-9]+)', 1) as bigint) as varchar)"
_ERR = "case when t = '' then 'unspecified tool error' else left(t, 240) end"
_NORM = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(content, '')), '^error:\s*', '', 'i'), '#W\d+', '<order_id>', 'gi'), '\b\d{5,}\b', '<id>', 'g'), '\s+', ' ', 'g')))"""
_GREET = ", ".join("'" + g.replace("'", "''") + "'" for g in GREETINGS)


_REFS = """ra as (select trajectory_id, task_id, arguments, unnest(json_keys(arguments)) as k from tool_calls where task_id is not null and json_valid(arguments) and json_type(arguments) = 'OBJECT'),
 rk as (select *, case k when 'user_id' then 'user' when 'order_id' then 'order' when 'product_id' then 'product' when 'item_ids' then 'order_item' when 'new_item_ids' then 'item' when 'payment_method_id' then 'payment' end as ref_kind from ra),
 rf as (select trajectory_id, task_id, ref_kind, unnest(case when json_type(arguments, '$."' || k || '"') = 'ARRAY' then cast(json_extract(arguments, '$."' || k || '"') as varchar[]) else [json_extract_string(arguments, '$."' || k || '"')] end) as id from rk where ref_kind is not null and json_type(arguments, '$."' || k || '"') <> 'NULL')"""


def oracle_sql() -> dict[str, str]:
    calls = "coalesce(m.tool_calls, [])"
    blank = "trim(coalesce(m.content, '')) = ''"
    return {
        "prj_02_task_spec": "select distinct task_id, instructions.reason_for_call as reason_for_call, instructions.unknown_info as unknown_info, len(coalesce(order_ids, [])) as orders from tasks where task_id is not null",
        "prj_04_chat_messages": f"with {_N}, {_M} select trajectory_id, pos, m.role as role, array_to_string(list_transform({calls}, lambda c: 'function:' || coalesce(c.name, '')), ',') as calls, len({calls}) > 0 and m.role is distinct from 'assistant' as misplaced from u",
        "prj_07_judge_payload": f"with {_N} select trajectory_id, length(array_to_string(list_transform(list_filter(messages, lambda m: m.role in ('user', 'assistant') and m.content <> ''), lambda m: m.content), ' ')) as characters, stats.tool_error_count as tool_errors from l where screening.hard_pass",
        "prj_08_wide_features": f"with {_PICK} select task_id, trial, " + ", ".join(f"max(case when model_label = '{m}' then {c} end) as {m}_{c}" for m in ("sft", "vanilla", "potential") for c in ("reward", "assistant_turns", "completion_tokens", "exact_repeated_calls")) + " from p group by 1, 2",
        "prj_09_review_trace": f"with {_N}, u as (select trajectory_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages) as m, flatten(list_transform(messages, lambda x: coalesce(x.tool_calls, []))) as cs from l) select trajectory_id, pos, coalesce(list_filter(cs, lambda c: c.id = m.tool_call_id)[1].name, 'unknown') as tool_name from u where m.role = 'tool'",
        "prj_11_runtime_rows": f"with {_N} select trajectory_id, round(outcome.duration_seconds, 3) as duration_seconds, stats.message_count as messages, stats.tool_call_count as tool_calls, stats.tool_error_count as tool_errors, coalesce(stats.tool_error_count * 100.0::double / nullif(stats.tool_call_count, 0), 0) as errors_per_100 from l",
        "prj_13_nested_values": f"with {_N} select trajectory_id, try_cast(json_extract(outcome.reward_breakdown, '$.DB.score') as double) as db_score from l",
        "prj_21_step_lines": f"with {_RUNS}, g as (select model_label, trial, count(*) n, round(coalesce(avg(reward), 0), 3) r from f group by 1, 2) select printf('step %d | %s | runs %d | reward %.3f', trial, model_label, n, r) as line from g",
        "flt_05_strict_json": "select record_id, coalesce(json_valid(body) and trim(body) <> '', false) as strict from candidate_records",
        "flt_06_message_rules": f"with {_N}, {_M}, r as (select m.role as role, case when m.role in ('system', 'user') and {blank} then 'blank content' when m.role = 'assistant' and {blank} and len({calls}) = 0 then 'neither text nor call' when m.role = 'assistant' and not ({blank}) and len({calls}) > 0 then 'text and call' when m.role = 'assistant' and len({calls}) > 1 then 'several calls' when m.role = 'tool' and coalesce(m.tool_call_id, '') = '' then 'no call id' when coalesce(m.role not in ('system', 'user', 'assistant', 'tool'), true) then 'unknown role' end as rule from u) select role, rule, count(*) as messages from r where rule is not null group by 1, 2",
        "flt_14_alignment": f"with {_PICK}, a as (select task_id, trial, termination_reason t from p where model_label = 'sft'), b as (select task_id, trial, termination_reason t from p where model_label = 'vanilla'), j as (select coalesce(a.task_id, b.task_id) as task_id, coalesce(a.trial, b.trial) as trial, case when a.t is null then 'extra' when b.t is null then 'missing' when a.t <> b.t then 'ending differs' end as problem from a full join b on a.task_id = b.task_id and a.trial = b.trial) select * from j where problem is not null",
        "flt_19_max_length": "select kind, max(n_chars) as longest, (ceil(max(n_chars) / 512.0) * 512)::bigint as max_length from documents group by 1",
        "flt_22_limits": f"with {_N} select case when stats.tool_error_count > 3 then 'too_many_errors' when stats.message_count > 30 then 'max_steps' when outcome.duration_seconds > 90 then 'timeout' else 'none' end as stop, count(*) as sessions from l group by 1",
        "prj_16_redacted": "select distinct task_id, '{' || array_to_string(list_filter(['\"reason_for_call\":' || to_json(instructions.reason_for_call), '\"task_instructions\":' || to_json(instructions.task_instructions)], lambda x: x is not null), ',') || '}' as instructions from tasks where task_id is not null",
        "flt_24_id_range": "with r as (select kind, list_transform(string_split(text, ''), lambda c: unicode(c)) as c from documents where text <> '') select kind, min(list_min(c)) as least, max(list_max(c)) as most from r group by 1",
        "prj_06_training_rows": f"with {_TRAIN} select tr.trajectory_id, {_TN} as task_id, len(ms) + 1 as messages, '{{\"source_run\":\"' || coalesce(source_run, '') || '\",\"tier\":\"' || coalesce(tier, '') || '\"}}' as metadata from tr join l using (trajectory_id)",
        "jsn_11_references": f"with {_REFS} select distinct task_id, ref_kind, id from rf",
        "set_07_task_targets": f"with {_REFS}, {_RUNS}, gd as (select distinct trajectory_id, reward = 1 as good from f where reward is not null), j as (select rf.*, good from rf join gd using (trajectory_id)) select task_id, ref_kind, id from j where good except select task_id, ref_kind, id from j where not good",
        "jon_01_with_tasks": f"with {_N}, t as (select {_TN} as task_id, instructions.reason_for_call as r, updated_at from tasks), k as (select task_id, r from (select *, row_number() over (partition by task_id order by updated_at desc nulls last, r desc nulls last) rn from t) where rn = 1), c as (select trajectory_id, {_TN} as task_id from l) select trajectory_id, c.task_id, k.r as reason_for_call from c left join k on c.task_id = k.task_id where c.task_id is not null",
        "jon_02_calls_and_answers": f"with {_N}, {_M}, c as (select trajectory_id, pos, unnest(m.tool_calls) as c from u where m.role = 'assistant'), a as (select * from (select trajectory_id, m.tool_call_id as call_id, coalesce(m.error, false) as error, m.content as content, row_number() over (partition by trajectory_id, m.tool_call_id order by pos desc) rn from u where m.role = 'tool' and m.tool_call_id is not null) where rn = 1), j as (select c.trajectory_id, pos, c.c.id as call_id, c.c.name as name, a.rn is not null as answered, coalesce(a.error, false) as error, {_NORM} as t from c left join a on a.trajectory_id = c.trajectory_id and a.call_id = c.c.id) select trajectory_id, pos, call_id, name, answered, error, case when error then {_ERR} else '' end as error_text from j",
        "jon_08_read_before_write": f"with {_ONCE}, g as (select trajectory_id, min(message_index) filter (family = 'write') w, min(message_index) filter (name like 'find_member%') r from o group by 1) select trajectory_id, case when w is not null then coalesce(r < w, false) end as authenticated_first from g",
        "agg_22_turns": f"with {_RUNS} select model_label, coalesce(sum(assistant_turns), 0)::bigint as turns, coalesce(sum(completion_tokens), 0)::bigint as completion_tokens, coalesce(max(completion_tokens), 0)::bigint as most_tokens from f group by 1",
        "agg_33_micro_batches": "with r as (select n_chars, (row_number() over (order by n_chars, doc_id) - 1) // 16 as b from documents where n_chars is not null), g as (select b, count(*) k, sum(n_chars) t from r group by 1) select min(k) as least_rows, max(k) as most_rows, min(t)::bigint as least_tokens, max(t)::bigint as most_tokens, round(avg(t), 4) as mean_tokens from g",
        "win_16_kept_range": f"with {_N} select trajectory_id, case when messages[1].role = 'assistant' and messages[1].content in ({_GREET}) then 1 else 0 end::bigint as first, coalesce(list_max(list_transform(messages, lambda m, i: case when m.role is distinct from 'user' then i - 1 end)), -1) as last from l where len(messages) > 0",
        "win_18_token_budget": f"with {_ONCE}, s as (select trajectory_id, message_index, sum(length(arguments)) over (partition by trajectory_id order by message_index, call_pos rows unbounded preceding) as spent from o) select trajectory_id, min(message_index) as over_at from s where spent > 500 group by 1",
        "top_05_eligible": f"with {_N}, k as (select trajectory_id, {_TN}::bigint as task, screening.task_rank as task_rank from l where screening.hard_pass and screening.task_rank is not null) select trajectory_id, task_rank from k where task is not null order by task_rank, task, trajectory_id limit 100",
        "top_06_lookup": "select doc_id, kind from documents order by doc_id limit 1 offset 7",
        "top_10_attribution_sheet": f"with {_PICK}, q as (select task_id, trial, bool_or(case when model_label = 'sft' then abs(reward - 1) <= 1e-6 end) a, bool_or(case when model_label = 'vanilla' then abs(reward - 1) <= 1e-6 end) b from p where model_label in ('sft', 'vanilla') group by 1, 2 having count(distinct model_label) = 2) select task_id, trial, case when b then 'improved' else 'regressed' end as transition, '' as cause, '' as notes from q where a <> b",
        "str_04_action_families": "with g as (select task_id, coalesce(array_to_string(list_sort(list(distinct string_split(name, '_')[1]) filter (family = 'write')), '+'), '') as f from tool_calls where task_id is not null group by 1) select task_id, case when f = '' then 'read_or_communication' else f end as families from g",
        "str_12_call_paths": f"with {_ONCE} select trajectory_id, string_agg(name, ' -> ' order by message_index, call_pos) as path from o group by 1",
        "mth_05_shifted_count": "select doc_id, length(replace(substr(text, 2), ' ', '')) as supervised from documents where text is not null",
        "jsn_03_decoded_results": f"with {_N}, {_M} select case when m.content is null or not json_valid(m.content) then 'text' when json_type(m.content) = 'OBJECT' then 'object' else 'other' end as kind, count(*) as results from u where m.role = 'tool' group by 1",
        "stm_02_replayed_ends": f"with {_N}, {_M}, e as (select trajectory_id, pos, sum(case when m.role = 'tool' and coalesce(m.error, false) then 1 else 0 end) over (partition by trajectory_id order by pos rows unbounded preceding) as errors from u) select trajectory_id, min(pos) as ended_at from e where errors > 2 group by 1",
        "stm_03_last_attempt": "select trajectory_id, count(*) as attempts, max(ingested_at) as last_at from candidates where trajectory_id is not null group by 1",
        "aux_07_error_counts": f"with {_ONCE} select trajectory_id, count(*) as total_calls, count(*) filter (family = 'read') as read_calls, count(*) filter (family = 'write') as write_calls, count(*) filter (family = 'read' and coalesce(error, false)) as read_errors, count(*) filter (family = 'write' and coalesce(error, false)) as write_errors from o group by 1",
        "aux_24_turn_numbers": f"with {_N}, {_M} select trajectory_id, count(*) as renumbered from u where pos is distinct from m.turn_idx group by 1",
        "aux_35_counters": "select doc_id, (sum(coalesce(n_chars, 0)) over (order by created_at, doc_id rows unbounded preceding))::bigint as seen from documents where created_at is not null",
        "aux_39_group_keys": "select coalesce(task_id, trajectory_id) as group_key, count(*) as rows from trajectory_features group by 1",
    }
