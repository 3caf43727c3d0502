"""Queries over extracted, judged candidates, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions.numbers import ratio
from logloom.operators import curation as cu
from logloom.session import latest, table, task_number

GREETINGS = ["Hi! How can I help you today?", "Hello, how may I help?", "Welcome to the shop, what can I do for you?"]
SYSTEM = "Follow the policy of the shop."


def newest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest delivery of each candidate, with just the columns asked for."""
    rows = table(spark, d, "candidates").filter("trajectory_id IS NOT NULL").select("trajectory_id", "ingested_at", *columns)
    return latest(rows, ["trajectory_id"], "ingested_at")


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return cu.screen(newest(spark, d, "task_id", "tier", "trial", "outcome", "stats", "messages"))


def agg_01_trajectory_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = cu.message_stats(F.col("messages"))
    return newest(spark, d, "messages").select("trajectory_id", *[c.cast("long").alias(n) for n, c in stats.items()])


def prj_01_simplified(spark: SparkSession, d: str) -> DataFrame:
    return cu.simplify_messages(newest(spark, d, "messages"), "trajectory_id").withColumn("pos", F.col("pos").cast("long")).withColumn("calls", F.col("calls").cast("long"))


def prj_03_quality(spark: SparkSession, d: str) -> DataFrame:
    """Rejection reasons as extraction writes them: reward_zero, the raw ending, tool_error."""
    rows = newest(spark, d, "outcome", "stats")
    end = F.col("outcome.termination_reason")
    reasons = F.filter(F.array(F.when(~F.col("outcome.reward").eqNullSafe(F.lit(1.0)), "reward_zero"), F.when(~end.isin(cu.NORMAL_ENDS), end), F.when(F.col("stats.tool_error_count") > 0, "tool_error")), lambda x: x.isNotNull())
    return rows.select("trajectory_id", F.col("outcome.reward").eqNullSafe(F.lit(1.0)).alias("reward_pass"), F.array_join(reasons, ",").alias("rejection_reasons"))


def flt_01_screening(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d).select("trajectory_id", F.array_join("hard_reasons", ",").alias("hard_reasons"), F.array_join("review_flags", ",").alias("review_flags"), "hard_pass")


def agg_02_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _screened(spark, d)
    both = rows.select(F.explode("hard_reasons").alias("name"), F.lit("hard").alias("kind")).unionByName(rows.select(F.explode("review_flags").alias("name"), F.lit("flag").alias("kind")))
    return both.groupBy("kind", "name").agg(F.count("*").alias("candidates"))


def agg_02_task_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _screened(spark, d).select(task_number(F.col("task_id")).alias("task_id"), "hard_pass", (F.size("review_flags") > 0).alias("flagged")).filter("task_id IS NOT NULL")
    return rows.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if("hard_pass").alias("hard_pass"), F.count_if(F.col("hard_pass") & F.col("flagged")).alias("needs_review"))


def win_01_task_rank(spark: SparkSession, d: str) -> DataFrame:
    return cu.rank_by_task(_screened(spark, d), task_number(F.col("task_id")))


def flt_02_judgment(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(spark, d, "outcome", "stats", "semantic_screening")
    decided = cu.judge_decision(F.col("semantic_screening.confidence"), [F.col("outcome.reward") == 1.0, F.coalesce(F.col("outcome.db_match"), F.lit(True))], F.col("stats.tool_error_count") <= 1, F.col("stats.tool_error_count") > 0)
    return rows.select("trajectory_id", decided.alias("decision"))


def agg_03_semantic_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(spark, d, "semantic_screening")
    c = F.col("semantic_screening.confidence")
    usable = F.when(~F.isnan(c), c)
    return rows.groupBy(F.col("semantic_screening.decision").alias("decision")).agg(F.count("*").alias("candidates"), F.round(F.avg(usable), 6).alias("avg_confidence"))


def agg_26_role_counts(spark: SparkSession, d: str) -> DataFrame:
    made = cu.training_messages(newest(spark, d, "messages"), GREETINGS, SYSTEM)
    return made.select(F.explode("messages").alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("messages"))


def prj_05_training_messages(spark: SparkSession, d: str) -> DataFrame:
    made = cu.training_messages(newest(spark, d, "messages"), GREETINGS, SYSTEM)
    return made.select("trajectory_id", F.size("messages").cast("long").alias("messages"), F.get("messages", F.lit(1))["role"].alias("first_role"), F.element_at("messages", -1)["role"].alias("last_role"))


def flt_09_conversation_errors(spark: SparkSession, d: str) -> DataFrame:
    made = cu.training_messages(newest(spark, d, "messages"), GREETINGS, SYSTEM)
    return made.select("trajectory_id", F.array_join(cu.conversation_errors(F.col("messages")), ",").alias("errors"))


def win_07_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often each role follows each other role."""
    rows = newest(spark, d, "messages").filter("size(messages) > 1")
    roles = F.transform("messages", lambda m: m["role"])
    pairs = F.arrays_zip(F.slice(roles, 1, F.size(roles) - 1).alias("a"), F.slice(roles, 2, F.size(roles)).alias("b"))
    return rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("role"), F.col("p.b").alias("next_role")).agg(F.count("*").alias("times"))


def jon_07_recoveries(spark: SparkSession, d: str) -> DataFrame:
    return cu.recoveries(newest(spark, d, "messages").filter("size(messages) > 0"), "trajectory_id")


def mth_01_quality_score(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(spark, d, "stats", "screening", "semantic_screening").filter("semantic_screening.confidence IS NOT NULL AND NOT isnan(semantic_screening.confidence)")
    return rows.select("trajectory_id", F.round(cu.quality_score(F.col("semantic_screening.confidence"), F.col("stats"), F.coalesce("screening.review_flags", F.array().cast("array<string>"))), 6).alias("quality_score"))


def jon_05_pending(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed judging run still has to do: hard passes without a decision."""
    rows = newest(spark, d, "screening", "semantic_screening")
    done = rows.filter("semantic_screening.decision IS NOT NULL").select("trajectory_id")
    return rows.filter("screening.hard_pass").select("trajectory_id", F.col("screening.task_rank").alias("task_rank")).join(done, "trajectory_id", "left_anti")


def jon_06_similarity_to_best(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's text similarity to the best-ranked one of its task: one comparison a row, however large the task."""
    rows = newest(spark, d, "task_id", "screening", "messages").filter("size(messages) > 0").select("trajectory_id", task_number(F.col("task_id")).alias("task_id"), F.col("screening.task_rank").alias("task_rank"), cu.grams(F.col("messages")).alias("grams")).filter("task_id IS NOT NULL")
    best = rows.groupBy("task_id").agg(F.min_by(F.struct("trajectory_id", "grams"), F.struct(F.coalesce("task_rank", F.lit(1 << 30)), "trajectory_id")).alias("b"))
    joined = rows.join(best, "task_id")
    return joined.select("trajectory_id", F.col("b.trajectory_id").alias("best_id"), F.round(tx.jaccard(F.col("grams"), F.col("b.grams")), 6).alias("similarity"))


def top_01_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(spark, d, "task_id", "tier", "stats", "screening", "semantic_screening", "messages").filter("semantic_screening.decision = 'accepted' AND semantic_screening.confidence IS NOT NULL AND NOT isnan(semantic_screening.confidence)")
    calls = F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.transform(cu._calls(m), lambda c: F.xxhash64(c["name"], F.coalesce(tx.canonical_json(c["arguments"]), c["arguments"])))))
    ready = rows.select(
        "trajectory_id", task_number(F.col("task_id")).alias("task_id"), F.lower(F.trim(F.coalesce("tier", F.lit("")))).alias("tier"), cu.quality_score(F.col("semantic_screening.confidence"), F.col("stats"), F.coalesce("screening.review_flags", F.array().cast("array<string>"))).alias("quality"),
        F.coalesce("screening.task_rank", F.lit(1 << 30)).alias("task_rank"), F.transform(cu.grams(F.col("messages")), lambda g: F.xxhash64(g)).alias("grams"), calls.alias("trace"),
    ).filter("task_id IS NOT NULL")
    return cu.select_greedily(ready, 256, 2)


def agg_04_selection_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many of the chosen came in by each phase."""
    return top_01_greedy(spark, d).groupBy("phase").agg(F.count("*").alias("selected"), F.count_distinct("task_id").alias("tasks"))


def agg_27_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(spark, d, "outcome", "source_run")
    return rows.groupBy("source_run", F.col("outcome.termination_reason").alias("termination_reason"), F.col("outcome.reward").alias("reward")).agg(F.count("*").alias("candidates"))


def agg_28_bag_difference(spark: SparkSession, d: str) -> DataFrame:
    """Tools a trajectory calls more often than its task's best-ranked one, by how many (a difference of bags)."""
    rows = newest(spark, d, "task_id", "screening", "messages").filter("size(messages) > 0").select("trajectory_id", task_number(F.col("task_id")).alias("task_id"), F.col("screening.task_rank").alias("task_rank"), "messages").filter("task_id IS NOT NULL")
    best = rows.groupBy("task_id").agg(F.min_by("trajectory_id", F.struct(F.coalesce("task_rank", F.lit(1 << 30)), "trajectory_id")).alias("best_id"))
    called = rows.select("trajectory_id", "task_id", F.explode("messages").alias("m")).filter("m.role = 'assistant'").select("trajectory_id", "task_id", F.explode("m.tool_calls").alias("c")).groupBy("trajectory_id", "task_id", F.col("c.name").alias("name")).agg(F.count("*").alias("k"))
    wanted = called.join(best, F.col("trajectory_id") == F.col("best_id"), "left_semi").select("task_id", "name", F.col("k").alias("kb"))
    return called.join(wanted, ["task_id", "name"], "left").select("trajectory_id", "name", (F.col("k") - F.coalesce("kb", F.lit(0))).alias("more")).filter("more > 0")


def set_05_call_bags(spark: SparkSession, d: str) -> DataFrame:
    """Whether the bag of call ids equals the bag of answered ids."""
    m = F.col("messages")
    ids = F.array_sort(F.flatten(F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: F.transform(cu._calls(x), lambda c: c["id"]))))
    answers = F.array_sort(F.transform(F.filter(m, lambda x: x["role"] == "tool"), lambda x: x["tool_call_id"]))
    return newest(spark, d, "messages").filter("size(messages) > 0").select("trajectory_id", F.size(ids).cast("long").alias("calls"), F.size(answers).cast("long").alias("answers"), (ids == answers).alias("paired"))


def jsn_05_breakdown_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path in the reward breakdown: missing, null or a number."""
    v = F.try_parse_json("outcome.reward_breakdown")
    at = F.try_variant_get(v, "$.NL", "variant")
    state = F.when(v.isNull(), "no document").when(at.isNull(), "missing").when(F.is_variant_null(at), "null").otherwise("value")
    return newest(spark, d, "outcome").groupBy(state.alias("nl_state")).agg(F.count("*").alias("candidates"))


def agg_30_turn_credit(spark: SparkSession, d: str) -> DataFrame:
    """Error turns and their share, by tier as spelled plainly."""
    rows = newest(spark, d, "tier", "stats").select(F.lower(F.trim("tier")).alias("tier"), "stats")
    return rows.groupBy("tier").agg(F.sum("stats.tool_error_count").cast("long").alias("error_turns"), F.sum("stats.assistant_turns").cast("long").alias("turns"), F.round(ratio(F.sum("stats.tool_error_count"), F.sum("stats.assistant_turns")), 6).alias("error_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [agg_01_trajectory_stats, prj_01_simplified, prj_03_quality, flt_01_screening, agg_02_reason_counts, agg_02_task_counts, win_01_task_rank, flt_02_judgment, agg_03_semantic_summary, agg_26_role_counts, prj_05_training_messages, flt_09_conversation_errors, win_07_transitions, jon_07_recoveries, mth_01_quality_score, jon_05_pending, jon_06_similarity_to_best, top_01_greedy, agg_04_selection_summary, agg_27_manifest, agg_28_bag_difference, set_05_call_bags, jsn_05_breakdown_paths, agg_30_turn_credit]
    return {f.__name__: f for f in own}


_N = "l as (select * exclude (rn) from (select *, row_number() over (partition by trajectory_id order by ingested_at desc nulls last) rn from candidates where trajectory_id is not null) where rn = 1)"
_TASK = "cast(try_cast(regexp_extract(task_id, '([0-9]+)', 1) as bigint) as varchar)"
_CALLS = "coalesce(m.tool_calls, [])"
_AS = "list_filter(coalesce(messages, []), lambda m: m.role = 'assistant')"
_BAD = f"len(list_filter({_AS}, lambda m: len(list_filter({_CALLS}, lambda c: coalesce(c.name, '') = '' or not json_valid(c.arguments) or json_type(c.arguments) <> 'OBJECT')) > 0)) > 0"
_TEXT = "trim(coalesce(m.content, '')) <> ''"
_SCREEN = f"""{_N}, sc as (select *, list_sort(list_filter([case when outcome.reward is distinct from 1 then 'reward_zero' end, case when outcome.db_match = false then 'db_mismatch' end, case when coalesce(outcome.termination_reason in ('user_stop', 'agent_stop'), false) = false then 'abnormal_termination' end,
   case when messages is null or len(messages) = 0 then 'missing_messages' end, case when coalesce(stats.assistant_turns, 0) = 0 then 'missing_assistant_turn' end, case when {_BAD} then 'malformed_tool_call' end], lambda x: x is not null)) as hr,
  list_sort(list_filter([case when len(list_filter({_AS}, lambda m: len({_CALLS}) > 1)) > 0 then 'parallel_tool_calls' end, case when len(list_filter({_AS}, lambda m: len({_CALLS}) > 0 and {_TEXT})) > 0 then 'text_with_tool_call' end, case when stats.tool_error_count > 0 then 'tool_error_needs_review' end,
   case when stats.assistant_turns > 20 then 'long_trajectory' end, case when stats.tool_call_count > 15 then 'many_tool_calls' end], lambda x: x is not null)) as rf from l)"""
_GREET = ", ".join("'" + g.replace("'", "''") + "'" for g in GREETINGS)
_TRAIN = f"""{_N}, g as (select trajectory_id, messages, case when messages[1].role = 'assistant' and messages[1].content in ({_GREET}) then 2 else 1 end as f, coalesce(list_max(list_transform(messages, lambda m, i: case when m.role is distinct from 'user' then i end)), 0) as t from l where len(messages) > 0),
 tr as (select trajectory_id, messages[f:t] as ms from g)"""
_BEST = f"""{_N}, k as (select trajectory_id, {_TASK} as task_id, screening.task_rank as task_rank, messages from l where len(messages) > 0), r as (select * from k where task_id is not null),
 b as (select task_id, trajectory_id as best_id from (select *, row_number() over (partition by task_id order by coalesce(task_rank, 1073741824), trajectory_id) rn from r) where rn = 1)"""
_GRAMS = "list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else w end)"


def oracle_sql() -> dict[str, str]:
    return {
        "agg_01_trajectory_stats": f"with {_N} select trajectory_id, coalesce(len(messages), 0) as message_count, len({_AS}) as assistant_turns, len(list_filter(coalesce(messages, []), lambda m: m.role = 'user')) as user_turns, coalesce(list_sum(list_transform({_AS}, lambda m: len({_CALLS}))), 0)::bigint as tool_call_count, len(list_filter(coalesce(messages, []), lambda m: m.role = 'tool' and coalesce(m.error, false))) as tool_error_count, len(list_filter({_AS}, lambda m: len({_CALLS}) > 0 and {_TEXT})) as mixed_count from l",
        "prj_01_simplified": f"with {_N}, u as (select trajectory_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages) as m from l) select trajectory_id, pos, m.role as role, case when not (m.role = 'assistant' and len({_CALLS}) > 0) then m.content end as content, case when m.role = 'tool' then m.tool_call_id end as tool_call_id, case when m.role = 'tool' then coalesce(m.error, false) end as error, case when m.role = 'assistant' then len({_CALLS}) else 0 end as calls from u",
        "prj_03_quality": f"with {_N} select trajectory_id, outcome.reward is not distinct from 1 as reward_pass, array_to_string(list_filter([case when outcome.reward is distinct from 1 then 'reward_zero' end, case when outcome.termination_reason not in ('user_stop', 'agent_stop') then outcome.termination_reason end, case when stats.tool_error_count > 0 then 'tool_error' end], lambda x: x is not null), ',') as rejection_reasons from l",
        "flt_01_screening": f"with {_SCREEN} select trajectory_id, array_to_string(hr, ',') as hard_reasons, array_to_string(rf, ',') as review_flags, len(hr) = 0 as hard_pass from sc",
        "agg_02_reason_counts": f"with {_SCREEN}, u as (select unnest(hr) as name, 'hard' as kind from sc union all select unnest(rf), 'flag' from sc) select kind, name, count(*) as candidates from u group by 1, 2",
        "agg_02_task_counts": f"with {_SCREEN}, t as (select {_TASK} as task_id, len(hr) = 0 as hp, len(rf) > 0 as fl from sc) select task_id, count(*) as total, count(*) filter (hp) as hard_pass, count(*) filter (hp and fl) as needs_review from t where task_id is not null group by 1",
        "win_01_task_rank": f"with {_SCREEN}, t as (select trajectory_id, {_TASK} as task_id, len(hr) = 0 as hard_pass, len(rf) as nf, stats, trial, case lower(trim(tier)) when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end as o from sc) select trajectory_id, task_id, row_number() over (partition by task_id order by not hard_pass, nf, stats.tool_error_count nulls last, stats.assistant_turns nulls last, stats.tool_call_count nulls last, o, trial nulls last, trajectory_id)::integer as task_rank, hard_pass from t where task_id is not null",
        "flt_02_judgment": f"with {_N} select trajectory_id, case when semantic_screening.confidence is null or isnan(semantic_screening.confidence) then null when semantic_screening.confidence < 0.8 then 'needs_human_review' when coalesce(outcome.reward = 1, false) and coalesce(outcome.db_match, true) and (not stats.tool_error_count > 0 or coalesce(stats.tool_error_count <= 1, false)) then 'accepted' else 'rejected' end as decision from l",
        "agg_03_semantic_summary": f"with {_N} select semantic_screening.decision as decision, count(*) as candidates, round(avg(semantic_screening.confidence) filter (not isnan(semantic_screening.confidence)), 6) as avg_confidence from l group by 1",
        "agg_26_role_counts": f"with {_TRAIN}, u as (select unnest(ms).role as role from tr union all select 'system' from tr) select role, count(*) as messages from u group by 1",
        "prj_05_training_messages": f"with {_TRAIN} select trajectory_id, len(ms) + 1 as messages, ms[1].role as first_role, case when len(ms) > 0 then ms[-1].role else 'system' end as last_role from tr",
        "win_07_transitions": f"with {_N}, u as (select trajectory_id, unnest(list_zip(list_transform(messages[:-2], lambda m: m.role), list_transform(messages[2:], lambda m: m.role))) as p from l where len(messages) > 1) select p[1] as role, p[2] as next_role, count(*) as times from u group by 1, 2",
        "flt_09_conversation_errors": f"""with {_TRAIN}, r as (select trajectory_id, ms, list_concat(['system'], list_transform(ms, lambda m: m.role)) as r, list_concat([0], list_transform(ms, lambda m: len({_CALLS}))) as k from tr),
          e as (select trajectory_id, list_sort(list_filter([case when len(r) < 3 then 'too_short' end, case when not (r[-1] is not distinct from 'assistant' and k[-1] = 0) then 'bad_end' end,
           case when len(list_filter(range(1, len(r)), lambda i: r[i + 1] is distinct from case when r[i] = 'system' then 'user' when r[i] in ('user', 'tool') then 'assistant' when r[i] = 'assistant' and k[i] > 0 then 'tool' else 'user' end)) > 0 then 'bad_transition' end,
           case when len(list_filter(k, lambda x: x > 1)) > 0 then 'parallel_calls' end,
           case when list_sort(flatten(list_transform(list_filter(ms, lambda m: m.role = 'assistant'), lambda m: list_transform({_CALLS}, lambda c: c.id)))) <> list_sort(list_transform(list_filter(ms, lambda m: m.role = 'tool'), lambda m: m.tool_call_id)) then 'unpaired_calls' end], lambda x: x is not null)) as x from r)
          select trajectory_id, array_to_string(x, ',') as errors from e""",
        "jon_07_recoveries": f"""with {_N}, u as (select trajectory_id, generate_subscripts(messages, 1) - 1 as pos, unnest(messages) as m from l where len(messages) > 0),
          c0 as (select trajectory_id, pos, generate_subscripts(m.tool_calls, 1) as j, unnest(m.tool_calls) as c from u where m.role = 'assistant'),
          c1 as (select trajectory_id, pos, j, c.id as id, c.name as name, case when json_valid(c.arguments) and json_type(c.arguments) = 'OBJECT' then '{{' || array_to_string(list_sort(list_transform(json_keys(c.arguments), lambda k: k || chr(1) || json_extract(c.arguments, '$."' || k || '"')::varchar)), chr(2)) else c.arguments end as doc from c0),
          c2 as (select *, row_number() over w - 1 as ord, lead(pos) over w as npos, lead(name) over w as nname, lead(doc) over w as ndoc from c1 window w as (partition by trajectory_id order by pos, j)),
          a as (select trajectory_id, m.tool_call_id as id, min(pos) as apos, arg_min(coalesce(m.error, false), pos) as error from u where m.role = 'tool' and m.tool_call_id is not null group by 1, 2),
          q as (select c2.*, a.apos, a.error, (select min(x.pos) from u x where x.trajectory_id = c2.trajectory_id and x.m.role = 'user' and x.pos > a.apos) as asked from c2 left join a on a.trajectory_id = c2.trajectory_id and a.id = c2.id)
          select trajectory_id, ord::integer as ord, name, case when apos is null then 'missing_response' when asked is not null and (npos is null or asked < npos) then 'ask_user' when npos is null then 'abandon' when nname is distinct from name then 'alternate_tool' when ndoc is not distinct from doc then 'exact_retry' else 'corrected_retry' end as recovery from q where apos is null or error""",
        "mth_01_quality_score": f"with {_N} select trajectory_id, round(greatest(semantic_screening.confidence - 0.02 * least(stats.tool_error_count, 3) - 0.002 * greatest(stats.assistant_turns - 10, 0) - case when list_contains(screening.review_flags, 'long_trajectory') then 0.04 else 0 end - case when list_contains(screening.review_flags, 'many_tool_calls') then 0.04 else 0 end, 0), 6) as quality_score from l where semantic_screening.confidence is not null and not isnan(semantic_screening.confidence)",
        "jon_05_pending": f"with {_N} select trajectory_id, screening.task_rank as task_rank from l where screening.hard_pass and semantic_screening.decision is null",
        "jon_06_similarity_to_best": f"""with {_BEST}, w as (select trajectory_id, task_id, regexp_extract_all(lower(array_to_string(list_transform(list_filter(messages, lambda m: m.role in ('user', 'assistant') and m.content <> ''), lambda m: m.content), ' ')), '[a-z0-9]+') as w from r), g as (select trajectory_id, task_id, {_GRAMS} as g from w)
          select a.trajectory_id, b.best_id, round(case when len(list_distinct(list_concat(a.g, c.g))) = 0 then 1 else len(list_intersect(a.g, c.g))::double / len(list_distinct(list_concat(a.g, c.g))) end, 6) as similarity from g a join b on a.task_id = b.task_id join g c on c.trajectory_id = b.best_id""",
        "agg_27_manifest": f"with {_N} select source_run, outcome.termination_reason as termination_reason, outcome.reward as reward, count(*) as candidates from l group by 1, 2, 3",
        "agg_28_bag_difference": f"with {_BEST}, u as (select trajectory_id, task_id, unnest(messages) as m from r), v as (select trajectory_id, task_id, unnest(m.tool_calls).name as name from u where m.role = 'assistant'), k2 as (select trajectory_id, task_id, name, count(*) k from v group by 1, 2, 3) select a.trajectory_id, a.name, a.k - coalesce(c.k, 0) as more from k2 a join b on a.task_id = b.task_id left join k2 c on c.trajectory_id = b.best_id and c.name = a.name where a.k > coalesce(c.k, 0)",
        "set_05_call_bags": f"with {_N}, s as (select trajectory_id, list_sort(flatten(list_transform({_AS}, lambda m: list_transform({_CALLS}, lambda c: c.id)))) as i, list_sort(list_transform(list_filter(messages, lambda m: m.role = 'tool'), lambda m: m.tool_call_id)) as a from l where len(messages) > 0) select trajectory_id, len(i) as calls, len(a) as answers, i = a as paired from s",
        "jsn_05_breakdown_paths": f"with {_N} select case when outcome.reward_breakdown is null or not json_valid(outcome.reward_breakdown) then 'no document' when not json_exists(outcome.reward_breakdown, '$.NL') then 'missing' when json_type(outcome.reward_breakdown, '$.NL') = 'NULL' then 'null' else 'value' end as nl_state, count(*) as candidates from l group by 1",
        "agg_30_turn_credit": f"with {_N} select lower(trim(tier)) as tier, sum(stats.tool_error_count)::bigint as error_turns, sum(stats.assistant_turns)::bigint as turns, round(coalesce(sum(stats.tool_error_count)::double / nullif(sum(stats.assistant_turns), 0), 0), 6) as error_share from l group by 1",
    }
