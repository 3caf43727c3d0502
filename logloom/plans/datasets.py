"""Queries over texts as token datasets, text functions and turn credit, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.functions.numbers import ratio, round_up
from logloom.operators import credit as cr
from logloom.operators import datasets as ds
from logloom.operators import evaluation as ev
from logloom.operators.nested import leaves
from logloom.plans.curation import _N, newest
from logloom.plans.evaluation import runs
from logloom.session import table


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *columns)


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "n_chars", "kind").filter("n_chars IS NOT NULL")


def agg_10_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).groupBy("kind").agg(F.expr("percentile_disc(0.9) within group (order by n_chars)").cast("long").alias("p90"))


def agg_11_four_figures(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).groupBy("kind").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.median("n_chars"), 6).alias("median"))


def agg_12_dataset_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d, "n_chars", "kind", "lang", "text")
    return rows.groupBy("kind").agg(
        F.count("*").alias("rows"), F.count_distinct("text").alias("distinct_texts"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(F.col("text") == "").alias("empty_texts"),
        F.sum("n_chars").cast("long").alias("characters"), F.count_if(F.col("n_chars") > 2048).alias("over_limit"), F.count_distinct(F.lower("lang")).alias("languages"),
    )


def win_02_offsets(spark: SparkSession, d: str) -> DataFrame:
    return ds.offsets(docs(spark, d, "n_chars"), "doc_id", "n_chars").select("doc_id", "offset_start", "offset_end")


def win_08_longest(spark: SparkSession, d: str) -> DataFrame:
    """The ten longest texts, then by id."""
    return _lengths(spark, d).orderBy(F.col("n_chars").desc(), F.col("doc_id").asc()).limit(10).select("doc_id", "n_chars")


def win_08_shortest(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).orderBy(F.col("n_chars").asc(), F.col("doc_id").asc()).limit(10).select("doc_id", "n_chars")


def _batched(spark: SparkSession, d: str) -> DataFrame:
    return ds.length_batches(_lengths(spark, d).select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 128)


def win_13_shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    return ds.length_batches(_lengths(spark, d).select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 128, seed=7)


def win_14_count_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 64 evaluated trajectories: what a completion token took in seconds, weighted by tokens."""
    rows = table(spark, d, "trajectory_features").groupBy("trajectory_id").agg(F.max("completion_tokens").alias("completion_tokens"), F.max("duration_seconds").alias("duration_seconds"))
    ready = rows.select("trajectory_id", F.coalesce("completion_tokens", F.lit(0)).alias("tokens"), F.coalesce(ratio(F.col("duration_seconds"), F.col("completion_tokens")), F.lit(0.0)).alias("loss"))
    return ds.count_windows(ready, "trajectory_id", 64, "loss", "tokens")


def mth_03_round_up(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("doc_id", round_up(F.col("n_chars"), 512, 17408).alias("target_length"))


def mth_04_padding(spark: SparkSession, d: str) -> DataFrame:
    """Code points as ids, padded to the next eight: sizes and sums of ids, labels and mask."""
    ids = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c))
    rows = docs(spark, d, "text").select("doc_id", ids.alias("ids"))
    a, b, m = ds.pad(F.col("ids"), F.col("ids"), round_up(F.size("ids"), 8), 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("doc_id", F.size(a).alias("width"), total(a).alias("ids"), total(b).alias("labels"), total(m).alias("attended"))


def str_01_ngrams(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d, "text").select("doc_id", tx.words(F.coalesce("text", F.lit(""))).alias("w"))
    return rows.select("doc_id", F.size("w").alias("words"), F.size(tx.word_ngrams(F.col("w"))).alias("ngrams"))


def str_07_first_upper(spark: SparkSession, d: str) -> DataFrame:
    """Where a text first differs from its lower-case form, if that is as long."""
    low = F.lower("text")
    rows = docs(spark, d, "text").filter(F.length(low) == F.length("text"))
    return rows.select("doc_id", tx.first_difference(F.col("text"), low).alias("at"))


def str_09_hashes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d, "text").select("doc_id", F.sha2("text", 256).alias("sha256"))


def str_10_slots(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).filter("task_id IS NOT NULL").select("trajectory_id", tx.slot_id(F.lit(1), F.col("task_id").cast("int"), F.col("trial")).alias("slot_id"))


def str_11_sources(spark: SparkSession, d: str) -> DataFrame:
    """Queue names for display: what follows the last underscore, unless it is the desk."""
    name = F.when(F.col("source").contains("desk"), "Support").otherwise(F.element_at(F.split("source", "_"), -1))
    return docs(spark, d, "source").groupBy(name.alias("shown")).agg(F.count("*").alias("rows"))


def set_06_jaccard_to_source(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of each text with the first text of its source: one comparison a row."""
    rows = docs(spark, d, "text", "source").filter("text IS NOT NULL").select("doc_id", "source", F.array_distinct(tx.words(F.col("text"))).alias("w"))
    first = rows.groupBy("source").agg(F.min_by("w", "doc_id").alias("w0"))
    return rows.join(first, "source").select("doc_id", F.round(tx.jaccard(F.col("w"), F.col("w0")), 6).alias("similarity"))


def jsn_01_canonical(spark: SparkSession, d: str) -> DataFrame:
    """How many ways of writing and how many distinct argument documents each tool has."""
    rows = table(spark, d, "tool_calls").select("name", "arguments", tx.canonical_json(F.col("arguments")).alias("c"))
    return rows.groupBy("name").agg(F.count_distinct("arguments").alias("written"), F.count_distinct("c").alias("documents"), F.count_if(F.col("c").isNull()).alias("no_json"))


def jsn_02_embedded_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidate_records").select("record_id", tx.json_object_in(F.col("body")).alias("j"))
    return rows.select("record_id", F.col("j").isNotNull().alias("has_json"))


def jsn_04_breakdown_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null leaf of the reward breakdowns with its path."""
    import json

    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    continue
                rows += [(key, p, v if isinstance(v, str) else json.dumps(v)) for p, v in leaves(value)]
            yield pa.RecordBatch.from_pydict({"trajectory_id": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.string())})

    return newest(spark, d, "outcome").select("trajectory_id", "outcome.reward_breakdown").mapInArrow(run, "trajectory_id string, path string, value string")


def set_08_breakdown_diff(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that differ between a trajectory's breakdown and that of its task's first trajectory."""
    rows = newest(spark, d, "task_id").filter("task_id IS NOT NULL")
    mine = jsn_04_breakdown_leaves(spark, d)
    first = rows.groupBy("task_id").agg(F.min("trajectory_id").alias("base_id"))
    base = first.join(mine.withColumnsRenamed({"trajectory_id": "base_id", "value": "base_value"}), "base_id").select("task_id", "path", "base_value")
    own = rows.join(mine, "trajectory_id").select("trajectory_id", "task_id", "path", "value")
    want = rows.select("trajectory_id", "task_id").join(base, "task_id").select("trajectory_id", "task_id", "path", "base_value")
    both = own.join(want, ["trajectory_id", "task_id", "path"], "full_outer")
    return both.filter(~F.col("value").eqNullSafe(F.col("base_value"))).select("trajectory_id", "path", "base_value", "value")


def flt_04_argument_keys(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose arguments lack the order they must name, or hold a key that isn't known."""
    known = ["order_id", "item_ids", "new_item_ids", "payment_id", "street", "city", "postcode", "reason", "mail", "first_name", "last_name", "member_id", "item_id", "article_id", "article", "colour", "max_price", "amount", "quantity", "summary", "size", "page"]
    keys = F.json_object_keys("arguments")
    rows = table(spark, d, "tool_calls").filter("family = 'write'").select("call_id", keys.alias("k"))
    missing = F.array_except(F.array(F.lit("order_id")), F.coalesce("k", F.array().cast("array<string>")))
    extra = F.array_sort(F.array_except(F.coalesce("k", F.array().cast("array<string>")), F.array(*map(F.lit, known))))
    return rows.select("call_id", F.array_join(missing, ",").alias("missing"), F.array_join(extra, ",").alias("unexpected")).filter("missing <> '' OR unexpected <> ''").distinct()


def flt_07_argument_kinds(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("arguments")
    kind = F.when(v.isNull(), "no JSON").when(F.is_variant_null(v), "null").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("other")
    return table(spark, d, "tool_calls").groupBy(kind.alias("kind")).agg(F.count("*").alias("calls"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    calls = ev.distinct_calls(table(spark, d, "tool_calls")).filter("task_id IS NOT NULL")
    args = F.from_json("arguments", "map<string,string>")
    return calls.select("trajectory_id", "task_id", "message_index", "family", F.coalesce("error", F.lit(False)).alias("error"), F.explode(args).alias("k", "v")).filter("v IS NOT NULL AND v <> ''").select("trajectory_id", "task_id", "message_index", "family", "error", F.concat_ws("=", "k", "v").alias("fact"))


def win_05_fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Progress over the facts that any write of the task names, each counted when first seen in a good call."""
    facts = _facts(spark, d)
    return cr.fact_progress(facts.filter("NOT error"), facts.filter("family = 'write'").select("task_id", "fact").distinct(), "trajectory_id", "message_index")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    calls = ev.distinct_calls(table(spark, d, "tool_calls"))
    good = F.when((F.col("family") == "write") & ~F.coalesce("error", F.lit(False)), 1).otherwise(0)
    bad = F.when(F.coalesce("error", F.lit(False)), 1).otherwise(0)
    w = Window.partitionBy("trajectory_id").orderBy("message_index", "call_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    potential = (F.sum(good).over(w) * 0.25 - F.sum(bad).over(w) * 0.125).cast("double")
    return calls.select("trajectory_id", "message_index", "call_pos", F.coalesce("error", F.lit(False)).alias("error"), F.greatest(F.length("arguments"), F.lit(1)).alias("tokens"), potential.alias("potential"))


def win_04_progress(spark: SparkSession, d: str) -> DataFrame:
    return cr.new_progress(_turns(spark, d), "trajectory_id", ["message_index", "call_pos"], "potential").select("trajectory_id", "message_index", "call_pos", "potential", "new_progress")


def agg_30_progress_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = cr.new_progress(_turns(spark, d), "trajectory_id", ["message_index", "call_pos"], "potential")
    return rows.groupBy("trajectory_id").agg(F.round(F.sum("new_progress"), 6).alias("progress"), F.count_if(F.col("new_progress") > 0).alias("progress_turns"), F.count_if("error").alias("error_turns"), F.max_by("potential", F.struct("message_index", "call_pos")).alias("final_potential"), F.max("potential").alias("best_potential"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    found = ev.relative_advantages(runs(spark, d).filter("task_id IS NOT NULL"), ["model_label", "task_id"])
    return found.groupBy("trajectory_id").agg(F.max("advantage").alias("outcome"), F.max("reward").alias("reward"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = cr.new_progress(_turns(spark, d), "trajectory_id", ["message_index", "call_pos"], "potential")
    # What a message shows first is credited to its first call.
    shown = win_05_fact_coverage(spark, d).groupBy("trajectory_id", "message_index").agg(F.sum("new_fact_progress").alias("shown"))
    first = rows.groupBy("trajectory_id", "message_index").agg(F.min("call_pos").alias("call_pos"))
    facts = first.join(shown, ["trajectory_id", "message_index"])
    joined = rows.join(facts, ["trajectory_id", "message_index", "call_pos"], "left").join(_outcomes(spark, d), "trajectory_id")
    return joined.select("trajectory_id", "message_index", "call_pos", "tokens", "error", F.col("new_progress").alias("progress"), F.coalesce("shown", F.lit(0.0)).alias("fact"), "outcome", "reward")


def win_10_potential_advantage(spark: SparkSession, d: str) -> DataFrame:
    a = cr.potential_advantage(F.col("outcome"), F.col("progress"), F.col("fact"), F.col("error"), 0.4, 0.1, 0.3)
    return _spans(spark, d).select("trajectory_id", "message_index", "call_pos", F.round(a, 8).alias("advantage"))


def win_11_anchored_advantage(spark: SparkSession, d: str) -> DataFrame:
    return cr.anchored_advantages(_spans(spark, d), "trajectory_id").select("trajectory_id", "message_index", "call_pos", F.round("q", 4).alias("q"), F.round("advantage", 4).alias("advantage"))


def src_11_first_of_split(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 tasks of the test split, by number."""
    rows = table(spark, d, "tasks").filter("extra_info.split = 'test'").select("task_id").distinct()
    return rows.orderBy(*tx.task_order(F.col("task_id"))).limit(40)


def src_12_task_rows(spark: SparkSession, d: str) -> DataFrame:
    """Task rows as a trainer reads them, made from the tasks' numbers."""
    rows = table(spark, d, "tasks").select("task_id", "tau2_seed").filter("task_id IS NOT NULL").groupBy("task_id").agg(F.max("tau2_seed").alias("tau2_seed"))
    prompt = F.format_string("Work on retail task %s.", "task_id")
    return rows.select("task_id", F.lit("retail_sim").alias("data_source"), prompt.alias("prompt"), "tau2_seed")


def top_04_task_order(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by the sort key of ids, with their place."""
    from logloom.operators.ordering import group_positions

    rows = table(spark, d, "tasks").select("task_id").filter("task_id IS NOT NULL").distinct()
    return group_positions(rows, None, tx.task_order(F.col("task_id")), "place")


def set_01_union(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories of three places under one another with where they come from."""
    a = table(spark, d, "candidates").select("trajectory_id", "task_id", F.lit("candidates").alias("origin"))
    b = table(spark, d, "trajectory_features").select("trajectory_id", "task_id", F.lit("features").alias("origin"))
    c = table(spark, d, "tool_calls").select("trajectory_id", "task_id", F.lit("calls").alias("origin")).distinct()
    return a.unionByName(b).unionByName(c).groupBy("origin").agg(F.count("*").alias("rows"), F.count_distinct("trajectory_id").alias("trajectories"))


def set_02_unobserved_writes(spark: SparkSession, d: str) -> DataFrame:
    """Write tools that others used on a task and a trajectory didn't."""
    calls = table(spark, d, "tool_calls").filter("family = 'write' AND task_id IS NOT NULL")
    used = calls.groupBy("task_id", "trajectory_id").agg(F.collect_set("name").alias("own"))
    wanted = calls.groupBy("task_id").agg(F.collect_set("name").alias("all"))
    return used.join(wanted, "task_id").select("trajectory_id", F.array_join(F.array_sort(F.array_except("all", "own")), "|").alias("unobserved"))


def agg_32_throughput(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d)
    return rows.groupBy("model_label").agg(F.round(F.sum("completion_tokens") / F.greatest(F.sum("duration_seconds"), F.lit(1e-12)), 4).alias("tokens_per_second"), F.round(ratio(F.sum("completion_tokens"), F.sum("assistant_turns")), 4).alias("tokens_per_turn"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [agg_10_nearest_rank, agg_11_four_figures, agg_12_dataset_scan, win_02_offsets, win_08_longest, win_08_shortest, win_13_shuffled_batches, win_14_count_windows, mth_03_round_up, mth_04_padding, str_01_ngrams, str_07_first_upper, str_09_hashes, str_10_slots, str_11_sources, set_06_jaccard_to_source, jsn_01_canonical, jsn_02_embedded_json, jsn_04_breakdown_leaves, set_08_breakdown_diff, flt_04_argument_keys, flt_07_argument_kinds, win_05_fact_coverage, win_04_progress, agg_30_progress_summary, win_10_potential_advantage, win_11_anchored_advantage, src_11_first_of_split, src_12_task_rows, top_04_task_order, set_01_union, set_02_unobserved_writes, agg_32_throughput]
    return {
        "agg_08_numeric_summary": lambda s, d: ds.numeric_summary(_lengths(s, d), ["kind"], "n_chars"), "agg_13_length_bins": lambda s, d: ds.bins(_lengths(s, d), "n_chars"), "win_13_length_batches": _batched,
        "agg_29_padding": lambda s, d: ds.padding_report(_batched(s, d), "n_chars"), **{f.__name__: f for f in own},
    }


_L = "l as (select doc_id, n_chars, kind from documents where n_chars is not null)"
_W = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_G = "list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else w end)"
_ONCE = "o as (select * from (select *, row_number() over (partition by trajectory_id, call_id order by ingested_at, message_index, call_pos) rn from tool_calls) where rn = 1)"
_TURNS = f"""{_ONCE}, t as (select trajectory_id, message_index, call_pos, coalesce(error, false) as error, greatest(length(arguments), 1) as tokens,
  (sum(case when family = 'write' and not coalesce(error, false) then 1 else 0 end) over w * 0.25 - sum(case when coalesce(error, false) then 1 else 0 end) over w * 0.125)::double as potential
  from o window w as (partition by trajectory_id order by message_index, call_pos rows unbounded preceding)),
 p as (select *, greatest(potential - greatest(coalesce(max(potential) over (partition by trajectory_id order by message_index, call_pos rows between unbounded preceding and 1 preceding), 0), 0), 0) as new_progress from t)"""
_FACTS = f"{_ONCE}, e as (select trajectory_id, task_id, message_index, family, coalesce(error, false) as error, unnest(json_keys(arguments)) as k, arguments from o where task_id is not null and json_valid(arguments) and json_type(arguments) = 'OBJECT'), fa as (select trajectory_id, task_id, message_index, family, error, k, json_extract_string(arguments, '$.\"' || k || '\"') as v from e)"
_SHOWN = """h as (select *, k || '=' || v as fact from fa where v is not null and v <> ''), hg as (select distinct task_id, fact from h where family = 'write'), hn as (select task_id, count(*) total from hg group by 1),
 hm as (select trajectory_id, h.task_id, h.fact, min(message_index) as message_index from h join hg on hg.task_id = h.task_id and hg.fact = h.fact where not error group by 1, 2, 3),
 sh as (select trajectory_id, message_index, count(*) as new_facts, round(count(*)::double / max(total), 6) as new_fact_progress from hm join hn using (task_id) group by trajectory_id, message_index, task_id)"""
_SPANS = f"""{_TURNS}, {_FACTS[len(_ONCE) + 2 :]}, {_SHOWN}, st as (select trajectory_id, message_index, sum(new_fact_progress) as shown from sh group by 1, 2), f as (select distinct * from trajectory_features), b as (select model_label, task_id, avg(reward) m, coalesce(stddev_samp(reward), 0) s from f where task_id is not null and reward is not null group by 1, 2),
 a as (select trajectory_id, max(round((reward - m) / (s + 1e-6), 4)) as outcome, max(reward) as reward from f join b on f.model_label = b.model_label and f.task_id = b.task_id where reward is not null group by 1),
 sp as (select p.trajectory_id, p.message_index, call_pos, tokens, error, new_progress as progress, case when call_pos = min(call_pos) over (partition by p.trajectory_id, p.message_index) then coalesce(st.shown, 0) else 0 end as fact, outcome, reward, sum(tokens) over (partition by p.trajectory_id) as all_tokens from p join a using (trajectory_id) left join st on st.trajectory_id = p.trajectory_id and st.message_index = p.message_index),
 q as (select *, case when error then 0 else least(greatest((0.8 * progress + 0.2 * fact) * sqrt(least(all_tokens::double / tokens, 16)), 0), 1) end as q from sp)"""

_LEAVES = f"""{_N}, lt as (select trajectory_id, '' as path, outcome.reward_breakdown::json as v from l where json_valid(outcome.reward_breakdown) and outcome.reward_breakdown <> ''
   union all select trajectory_id, case when path = '' then k else path || '.' || k end, json_extract(v, case when json_type(v) = 'ARRAY' then '$[' || k || ']' else '$."' || k || '"' end)
   from (select trajectory_id, path, v, unnest(case when json_type(v) = 'OBJECT' then json_keys(v) when json_type(v) = 'ARRAY' then list_transform(range(0, json_array_length(v)::bigint), lambda i: i::varchar) else [] end) as k from lt)),
 lv as (select trajectory_id, path, case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') else v::varchar end as value from lt where json_type(v) not in ('OBJECT', 'ARRAY', 'NULL'))"""
_KNOWN = "['order_id', 'item_ids', 'new_item_ids', 'payment_id', 'street', 'city', 'postcode', 'reason', 'mail', 'first_name', 'last_name', 'member_id', 'item_id', 'article_id', 'article', 'colour', 'max_price', 'amount', 'quantity', 'summary', 'size', 'page']"


def oracle_sql() -> dict[str, str]:
    return {
        "jsn_02_embedded_json": "select record_id, coalesce(json_valid(regexp_extract(body, '(?s)(\\{.*\\})', 1)) and regexp_extract(body, '(?s)(\\{.*\\})', 1) <> '', false) as has_json from candidate_records",
        "jsn_04_breakdown_leaves": f"with recursive {_LEAVES} select * from lv",
        "set_08_breakdown_diff": f"with recursive {_LEAVES}, tk as (select trajectory_id, task_id from l where task_id is not null), fb as (select task_id, min(trajectory_id) as base_id from tk group by 1), own as (select tk.trajectory_id, path, value from tk join lv using (trajectory_id)), want as (select tk.trajectory_id, lv.path, lv.value as base_value from tk join fb using (task_id) join lv on lv.trajectory_id = fb.base_id) select coalesce(own.trajectory_id, want.trajectory_id) as trajectory_id, coalesce(own.path, want.path) as path, base_value, value from own full join want on own.trajectory_id = want.trajectory_id and own.path = want.path where value is distinct from base_value",
        "flt_04_argument_keys": f"with c as (select distinct call_id, case when json_valid(arguments) and json_type(arguments) = 'OBJECT' then json_keys(arguments) else [] end as k from tool_calls where family = 'write'), r as (select call_id, case when list_contains(k, 'order_id') then '' else 'order_id' end as missing, array_to_string(list_sort(list_distinct(list_filter(k, lambda x: not list_contains({_KNOWN}, x)))), ',') as unexpected from c) select * from r where missing <> '' or unexpected <> ''",
        "agg_08_numeric_summary": f"with {_L} select kind, min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 6) as mean, {', '.join(f'round(quantile_cont(n_chars, {p}), 6) as {n}' for n, p in (('median', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)))} from l group by 1",
        "agg_10_nearest_rank": f"with {_L} select kind, quantile_disc(n_chars, 0.9) as p90 from l group by 1",
        "agg_11_four_figures": f"with {_L} select kind, min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 6) as mean, round(median(n_chars), 6) as median from l group by 1",
        "agg_12_dataset_scan": "select kind, count(*) as rows, count(distinct text) as distinct_texts, count(*) filter (text is null) as null_texts, count(*) filter (text = '') as empty_texts, sum(n_chars)::bigint as characters, count(*) filter (n_chars > 2048) as over_limit, count(distinct lower(lang)) as languages from documents group by 1",
        "agg_13_length_bins": f"with {_L} select case when n_chars <= 4096 then '00000-04096' when n_chars <= 8192 then '04097-08192' when n_chars <= 12288 then '08193-12288' when n_chars <= 16384 then '12289-16384' else '>16384' end as length_bin, count(*) as rows from l group by 1",
        "win_02_offsets": "select doc_id, (sum(coalesce(n_chars, 0)) over (order by doc_id) - coalesce(n_chars, 0))::bigint as offset_start, (sum(coalesce(n_chars, 0)) over (order by doc_id))::bigint as offset_end from documents",
        "win_08_longest": f"with {_L} select doc_id, n_chars from l order by n_chars desc, doc_id limit 10",
        "win_08_shortest": f"with {_L} select doc_id, n_chars from l order by n_chars, doc_id limit 10",
        "win_13_length_batches": f"with {_L} select doc_id, n_chars, ((row_number() over (order by n_chars, doc_id) - 1) // 16)::bigint as batch_id from l",
        "agg_29_padding": f"with {_L}, b as (select n_chars, ((row_number() over (order by n_chars, doc_id) - 1) // 16)::bigint as batch_id from l), g as (select batch_id, count(*) as rows, (ceil(max(n_chars) / 8.0) * 8)::bigint as width, sum(n_chars)::bigint as real_tokens from b group by 1) select batch_id, rows, width, real_tokens, rows * width - real_tokens as padding_tokens, round(coalesce((rows * width - real_tokens)::double / nullif(rows * width, 0), 0), 6) as padding_fraction from g",
        "win_14_count_windows": "with g as (select trajectory_id, max(completion_tokens) as c, max(duration_seconds) as t from trajectory_features group by 1), r as (select coalesce(c, 0) as tokens, coalesce(t / nullif(c, 0), 0) as loss, (row_number() over (order by trajectory_id) - 1) // 64 as w from g) select w::bigint as window, count(*) as micro_batches, sum(tokens)::bigint as tokens, round(coalesce(sum(loss * tokens) / nullif(sum(tokens), 0), 0), 6) as loss from r group by 1",
        "str_07_first_upper": "with r as (select doc_id, text, lower(text) as low from documents) select doc_id, list_min(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 1) <> substr(low, i + 1, 1))) as at from r where length(low) = length(text)",
        "jsn_01_canonical": """with a as (select distinct name, arguments from tool_calls), v as (select *, case when json_valid(arguments) then arguments end as doc from a),
          l as (select name, arguments, fullkey, type, case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then (atom::varchar::double)::varchar when type in ('OBJECT', 'ARRAY') then '' else atom::varchar end as x from v, json_tree(doc) where doc is not null),
          c as (select name, arguments, string_agg(fullkey || chr(1) || case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'N' else type end || chr(1) || coalesce(x, ''), chr(2) order by fullkey) as c from l group by 1, 2)
          select t.name, count(distinct t.arguments) as written, count(distinct c.c) as documents, count(*) filter (c.c is null) as no_json from tool_calls t left join c on c.name is not distinct from t.name and c.arguments = t.arguments group by 1""",
        "mth_03_round_up": f"with {_L} select doc_id, least((ceil(n_chars / 512.0) * 512)::bigint, 17408) as target_length from l",
        "mth_04_padding": "with r as (select doc_id, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c)) as p from documents) select doc_id, (ceil(len(p) / 8.0) * 8)::integer as width, coalesce(list_sum(p), 0)::bigint as ids, coalesce(list_sum(p), 0)::bigint - 100 * ((ceil(len(p) / 8.0) * 8)::bigint - len(p)) as labels, len(p) as attended from r",
        "str_01_ngrams": f"with r as (select doc_id, {_W} as w from documents) select doc_id, len(w)::integer as words, len({_G})::integer as ngrams from r",
        "str_09_hashes": "select doc_id, sha256(text) as sha256 from documents",
        "str_10_slots": "with f as (select distinct * from trajectory_features) select trajectory_id, printf('step_%06d:sample_%06d:rollout_%06d', 1, task_id::integer, trial) as slot_id from f where task_id is not null",
        "str_11_sources": "select case when source like '%desk%' then 'Support' else string_split(source, '_')[-1] end as shown, count(*) as rows from documents group by 1",
        "set_06_jaccard_to_source": f"with r as (select doc_id, source, list_distinct({_W}) as w from documents where text is not null), b as (select source, arg_min(w, doc_id) as w0 from r group by 1) select doc_id, round(case when len(list_distinct(list_concat(w, w0))) = 0 then 1 else len(list_intersect(w, w0))::double / len(list_distinct(list_concat(w, w0))) end, 6) as similarity from r join b using (source)",
        "flt_07_argument_kinds": "select case when not json_valid(arguments) then 'no JSON' when json_type(arguments) = 'NULL' then 'null' when json_type(arguments) = 'OBJECT' then 'object' else 'other' end as kind, count(*) as calls from tool_calls group by 1",
        "win_05_fact_coverage": f"with {_FACTS}, {_SHOWN} select trajectory_id, message_index, new_facts, new_fact_progress from sh",
        "win_04_progress": f"with {_TURNS} select trajectory_id, message_index, call_pos, potential, new_progress from p",
        "agg_30_progress_summary": f"with {_TURNS} select trajectory_id, round(sum(new_progress), 6) as progress, count(*) filter (new_progress > 0) as progress_turns, count(*) filter (error) as error_turns, arg_max(potential, message_index * 1000 + call_pos) as final_potential, max(potential) as best_potential from p group by 1",
        "win_10_potential_advantage": f"with {_SPANS} select trajectory_id, message_index, call_pos, round(case when error then -0.3 when 0.4 * progress + 0.1 * fact > 0 then greatest(outcome, 0) + 0.4 * progress + 0.1 * fact else outcome end, 8) as advantage from q",
        "win_11_anchored_advantage": f"with {_SPANS}, z as (select *, sum(q * tokens) over (partition by trajectory_id) / all_tokens as mq from q) select trajectory_id, message_index, call_pos, round(q, 4) as q, round(case when reward > 0.5 and outcome > 0 then outcome * (1 + 0.4 * (q - mq)) else outcome end, 4) as advantage from z",
        "src_11_first_of_split": "select task_id from (select distinct task_id from tasks where extra_info.split = 'test') order by task_id::bigint limit 40",
        "src_12_task_rows": "select task_id, 'retail_sim' as data_source, printf('Work on retail task %s.', task_id) as prompt, max(tau2_seed) as tau2_seed from tasks where task_id is not null group by task_id",
        "top_04_task_order": "select task_id, row_number() over (order by try_cast(task_id as bigint) is null, try_cast(task_id as bigint), task_id) as place from (select distinct task_id from tasks where task_id is not null)",
        "set_01_union": "with u as (select trajectory_id, 'candidates' as origin from candidates union all select trajectory_id, 'features' from trajectory_features union all select * from (select distinct trajectory_id, 'calls' from (select trajectory_id, task_id from tool_calls))) select origin, count(*) as rows, count(distinct trajectory_id) as trajectories from u group by 1",
        "set_02_unobserved_writes": "with c as (select distinct task_id, trajectory_id, name from tool_calls where family = 'write' and task_id is not null), u as (select task_id, trajectory_id, list(name) as own from c group by 1, 2), a as (select task_id, list(distinct name) as everything from c group by 1) select trajectory_id, coalesce(array_to_string(list_sort(list_filter(everything, lambda x: not list_contains(own, x))), '|'), '') as unobserved from u join a using (task_id)",
        "agg_32_throughput": "with f as (select distinct * from trajectory_features) select model_label, round(sum(completion_tokens) / greatest(sum(duration_seconds), 1e-12), 4) as tokens_per_second, round(coalesce(sum(completion_tokens)::double / nullif(sum(assistant_turns), 0), 0), 4) as tokens_per_turn from f group by 1",
    }
