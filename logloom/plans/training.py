"""Queries over training rows, tokens, the flat store, rollouts, readers and writers, with SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text as tx
from logloom.operators import curation as cu
from logloom.operators import datasets as ds
from logloom.operators import evaluation as ev
from logloom.operators import facts as fc
from logloom.operators import preprocess as pp
from logloom.operators import rollout as ro
from logloom.operators import rows as rw
from logloom.plans.curation import _N, _TRAIN, GREETINGS, SYSTEM, newest
from logloom.plans.evaluation import _ONCE, _RUNS, _SIG, runs
from logloom.plans.preprocess import labelled, rendered
from logloom.session import latest, shared_path, table, task_number
from logloom.sinks import writers
from logloom.sources import files, readers


def _made(spark: SparkSession, d: str) -> DataFrame:
    return cu.training_messages(newest(spark, d, "messages", "task_id", "tier", "source_run"), GREETINGS, SYSTEM)


def _tools(spark: SparkSession, d: str) -> str:
    """The catalogue (a fixed table of sixteen rows) as tool definitions."""
    rows = table(spark, d, "tool_catalog").orderBy("name").collect()
    return json.dumps([{"type": "function", "function": {"name": r.name, "description": r.description, "parameters": {"type": "object"}}} for r in rows])


def _training_rows(spark: SparkSession, d: str) -> DataFrame:
    return rw.training_json(_made(spark, d).withColumn("task_id", task_number(F.col("task_id"))), _tools(spark, d), ["tier", "source_run"])


def flt_03_row_errors(spark: SparkSession, d: str) -> DataFrame:
    """Where each candidate's training row breaks the format first, and how."""
    first = F.get("errors", F.lit(0))
    return rw.with_row_errors(_training_rows(spark, d), "row").select("trajectory_id", first["location"].alias("location"), first["error"].alias("error"))


def flt_04_record_keys(spark: SparkSession, d: str) -> DataFrame:
    """What keeps raw records from being training rows, at their top."""
    first = F.get("errors", F.lit(0))
    return rw.with_row_errors(table(spark, d, "candidate_records").select("record_id", "body"), "body").select("record_id", first["location"].alias("location"), first["error"].alias("error"))


def aux_29_chat_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows read back from their JSON: messages, calls, whether null content stayed, tools."""
    row = F.from_json("row", "task_id string, messages array<struct<role:string,content:string,tool_calls:array<struct<id:string>>,tool_call_id:string>>, tools array<struct<type:string>>, metadata struct<tier:string,source_run:string>")
    read = _training_rows(spark, d).select("trajectory_id", row.alias("r"), F.col("row").contains('"content":null').alias("null_content"))
    calls = F.aggregate("r.messages", F.lit(0).cast("long"), lambda a, m: a + F.greatest(F.coalesce(F.size(m["tool_calls"]), F.lit(0)), F.lit(0)))
    return read.select("trajectory_id", "r.task_id", F.size("r.messages").cast("long").alias("messages"), calls.alias("calls"), "null_content", F.size("r.tools").cast("long").alias("tools"), "r.metadata.tier", "r.metadata.source_run")


def flt_10_loose_errors(spark: SparkSession, d: str) -> DataFrame:
    """The looser check of a conversation: the first of its errors."""
    return _made(spark, d).select("trajectory_id", cu.loose_error(F.col("messages")).alias("error"))


def flt_23_turn_errors(spark: SparkSession, d: str) -> DataFrame:
    """Turns that a session would refuse, by role and reason."""
    rows = newest(spark, d, "messages").select(F.explode("messages").alias("m"))
    return rows.select(F.col("m.role").alias("role"), cu.turn_error(F.col("m")).alias("error")).filter("error IS NOT NULL").groupBy("role", "error").agg(F.count("*").alias("messages"))


def jsn_13_serialized(spark: SparkSession, d: str) -> DataFrame:
    """Messages numbered by place, each as one JSON text."""
    rows = newest(spark, d, "messages").select("trajectory_id", F.posexplode("messages").alias("turn_index", "m"))
    return rows.select("trajectory_id", F.col("turn_index").cast("long").alias("turn_index"), F.to_json(F.struct(F.col("turn_index"), F.col("m.role").alias("role"), F.size(cu._calls(F.col("m"))).alias("calls"))).alias("message"))


def jsn_15_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each rendered conversation comes back from its tokens, and these from it."""
    made = rendered(spark, d)
    found = pp.round_trip(made, "trajectory_id", "rendered")
    return found.select("trajectory_id", (F.col("tokens") > 0).alias("encoded"), "difference", "reencodes")


def prj_20_span_audit(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant target with its exact tokens: the header of its audit, and the text that the tokens hold."""
    made = rendered(spark, d)
    audited = pp.span_audit(pp.token_rows(pp.label(made, "trajectory_id"), "trajectory_id"), made, "trajectory_id")
    return audited.select("trajectory_id", "ordinal", "kind", "supervised", "masked_leading", "header", F.md5("target").alias("target_md5"))


def aux_26_first_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token that begins where each conversation's first assistant header stands; null where none begins there."""
    at = F.get("spans", F.lit(0))["header_start"]
    made = rendered(spark, d).select("trajectory_id", "spans")
    return labelled(spark, d).join(made.filter("size(spans) > 0"), "trajectory_id").select("trajectory_id", pp.first_token_at(F.col("starts"), at).alias("token"))


def aux_28_call_counts(spark: SparkSession, d: str) -> DataFrame:
    """Calls of all assistants of a conversation, and the hash of the format it is rendered by."""
    calls = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.when(m["role"] == "assistant", F.size(cu._calls(m))).otherwise(0))
    return _made(spark, d).select("trajectory_id", calls.alias("calls"), F.lit(pp.template_sha256(pp.START + "{role}\n{content}" + pp.END + "\n")).alias("template_sha256"))


def aux_46_render_report(spark: SparkSession, d: str) -> DataFrame:
    """Messages by role and marks of each rendered conversation."""
    made = rendered(spark, d)
    role = lambda r: F.size(F.filter("messages", lambda m: m["role"] == r)).cast("long").alias(r)
    marks = lambda m: (F.size(F.split("rendered", m.replace("|", r"\|"))) - 1).cast("long")
    return made.select("trajectory_id", role("system"), role("user"), role("assistant"), role("tool"), marks(pp.START).alias("starts"), marks(pp.END).alias("ends"), F.sha2("rendered", 256).alias("sha256"))


def _code_points(text: str) -> F.Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c))


def _store(spark: SparkSession, d: str) -> tuple[str, dict[str, int]]:
    """All documents with text as rows of a flat store, code points for ids; the first is ignored in the labels."""
    ids = table(spark, d, "documents").select("doc_id", _code_points("text").alias("input_ids")).filter("size(input_ids) > 1")
    numbered = ds.numbered(ids, "doc_id", "idx")
    rows = numbered.select("idx", "doc_id", "input_ids", F.concat(F.array(F.lit(ds.IGNORED)), F.slice("input_ids", 2, F.size("input_ids"))).alias("labels"))
    path = shared_path(spark, "store")
    return path, writers.write_flat_arrays(rows, path, "idx", keep=["doc_id"], source={"source": "documents"})


def flt_13_store(spark: SparkSession, d: str) -> DataFrame:
    """A flat store written, published and validated: its counts by the manifest, and how many errors it has."""
    path, counts = _store(spark, d)
    found = readers.store_errors(spark, path)
    return found.groupBy().agg(F.lit(counts["rows"]).cast("long").alias("trajectories"), F.lit(counts["tokens"]).cast("long").alias("tokens"), F.count("*").alias("errors"))


def src_08_token_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The store read back: rows, tokens, supervised ones and the range of ids."""
    made = readers.TokenDataset(spark, _store(spark, d)[0])
    return made.rows.agg(F.count("*").alias("rows"), F.sum(F.size("input_ids")).cast("long").alias("tokens"), F.sum(ds.supervised(F.col("labels"))).cast("long").alias("supervised_tokens"), F.min(F.array_min("input_ids")).cast("long").alias("least_id"), F.max(F.array_max("input_ids")).cast("long").alias("most_id"))


def src_09_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last row of the store by place."""
    made = readers.TokenDataset(spark, _store(spark, d)[0])
    last = len(made) - 1
    return made.rows.filter(F.col("idx") == last).select(F.col("idx").cast("long").alias("idx"), F.size("input_ids").cast("long").alias("tokens"), F.slice("input_ids", 1, 3).cast("array<string>").alias("head"))


def aux_32_store_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The store's metadata against its arrays: every document's place, length and supervised tokens."""
    path, _ = _store(spark, d)
    meta, arrays = spark.read.parquet(f"{path}/metadata"), spark.read.parquet(f"{path}/arrays")
    size = F.size("input_ids").cast("long")
    return meta.join(arrays.select("idx", size.alias("size"), ds.supervised(F.col("labels")).cast("long").alias("own")), "idx").select("doc_id", F.col("token_count").alias("tokens"), ((F.col("token_count") == F.col("size")) & (F.col("supervised_tokens") == F.col("own")) & (F.col("offset_end") - F.col("offset_start") == F.col("size"))).alias("agrees"), (F.col("size") - F.col("own")).alias("masked"))


def aux_45_sample_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each document's ids at a glance: how many, the first and last twelve, whether all labels are ignored or equal their ids."""
    ids = table(spark, d, "documents").filter("text <> ''").select("doc_id", _code_points("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("tokens"), F.array_join(F.slice("ids", 1, 12), " ").alias("first_ids"), F.array_join(F.slice("ids", F.greatest(F.size("ids") - 11, F.lit(1)), F.lit(12)), " ").alias("last_ids"))


def aux_33_padded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of like lengths, each padded to its longest row, rounded up to eight."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").filter("n_chars > 0")
    return ds.padded_batches(ds.length_batches(rows, "doc_id", "n_chars", 16, 128), "batch_id", "n_chars", 8)


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Evaluated trajectories in the words of rollouts, with what their calls add up to."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls")).groupBy("trajectory_id").agg(F.count("*").alias("tool_call_count"), F.count_if("error").alias("num_errors"), F.sum(F.coalesce(F.length("error_text"), F.lit(0))).cast("long").alias("tool_response_tokens"))
    own = runs(spark, d).select("trajectory_id", "model_label", "task_id", F.col("trial").alias("rollout_index"), "reward", "termination_reason", "assistant_turns", F.col("completion_tokens").alias("assistant_tokens"), F.col("duration_seconds").alias("trajectory_seconds"), F.col("consecutive_exact_retries").alias("infrastructure_retry_count"))
    joined = own.join(calls, "trajectory_id", "left").withColumn("response_tokens", F.coalesce("assistant_tokens", F.lit(0)) + F.coalesce("tool_response_tokens", F.lit(0)))
    return ro.summarize(joined)


def prj_14_rollout_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rollouts(spark, d).select("trajectory_id", "model_label", "rollout_index", "tool_call_count", "num_errors", "response_tokens", "observation_tokens", F.round("assistant_tokens_per_turn", 6).alias("assistant_tokens_per_turn"), F.round("tool_response_tokens_per_call", 6).alias("tool_response_tokens_per_call"))


def prj_15_trajectory_table(spark: SparkSession, d: str) -> DataFrame:
    """The fixed table of one step; columns that the source lacks are null."""
    made = ro.trajectory_table(_rollouts(spark, d), 1)
    return made.select(*[F.col(c).cast("string").alias(c) if c in ("slot_id", "generation_seconds", "user_seconds", "user_turns", "num_preempted", "user_observation_tokens") or c.startswith("turn_credit") else c for c in made.columns if c not in ("assistant_tokens_per_turn", "tool_response_tokens_per_call")])


def agg_24_step_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of a step by model, one row each."""
    found = ro.step_metrics(_rollouts(spark, d), ["model_label"], "task_id", local=F.col("infrastructure_retry_count") > 0)
    return found.select("model_label", "metric", F.round("value", 5).alias("value"))


def aux_38_sequence_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's summed score: one for a message, less two for a failed call."""
    scores = F.transform("messages", lambda m: F.when((m["role"] == "tool") & F.coalesce(m["error"], F.lit(False)), -2.0).otherwise(1.0))
    return newest(spark, d, "messages").select("trajectory_id", ro.sequence_score(scores).alias("score"))


def aux_41_trajectory_info(spark: SparkSession, d: str) -> DataFrame:
    """Step, sample, rollout and kind of every message of a conversation, zipped from parallel arrays."""
    rows = newest(spark, d, "messages").filter("size(messages) > 0").select("trajectory_id", F.transform("messages", lambda m, i: i).alias("samples"), F.transform("messages", lambda m: F.coalesce(m["turn_idx"], F.lit(-1))).alias("rollouts"), F.transform("messages", lambda m: F.coalesce(m["role"] == "user", F.lit(False))).alias("validate"))
    return ro.zipped_info(rows, 3, "samples", "rollouts", "validate").groupBy("step", "rollout_index", "validate").agg(F.count("*").alias("rows"), F.sum("sample_index").alias("samples"))


def aux_42_target_positions(spark: SparkSession, d: str) -> DataFrame:
    """Places whose next message is the assistant's, and the messages' lengths put back at them."""
    mask = F.transform("messages", lambda m: m["role"] == "assistant")
    rows = newest(spark, d, "messages").filter("size(messages) > 0").select("trajectory_id", "messages", ro.predicting_positions(mask).alias("at"))
    picked = F.transform("at", lambda i: F.coalesce(F.length(F.get("messages", i)["content"]), F.lit(0)))
    dense = ro.restored(picked, F.col("at"), F.size("messages"), F.lit(0))
    return rows.select("trajectory_id", F.array_join("at", ",").alias("places"), F.array_join(dense, ",").alias("lengths"))


def aux_14_policy_specs(spark: SparkSession, d: str) -> DataFrame:
    return ro.policy_specs(table(spark, d, "trajectory_features"), "model_label", "trial")


def aux_03_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Of each raw record's reward whether it is a finite number (a truth value counts as one), another value or missing."""
    v = F.try_parse_json("body")
    at = F.coalesce(*[F.try_variant_get(v, p, "variant") for p in ("$.outcome.reward", "$.reward_info.reward", "$.reward")])
    kind = F.schema_of_variant(at)
    number = F.try_variant_get(at, "$", "double")
    state = F.when(v.isNull(), "no document").when(at.isNull(), "missing").when(kind == "VOID", "null").when(kind.isin("STRING") | kind.startswith("OBJECT") | kind.startswith("ARRAY"), "no number").when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), "not finite").otherwise("number")
    return table(spark, d, "candidate_records").groupBy(state.alias("state")).agg(F.count("*").alias("records"))


def aux_05_reference_actions(spark: SparkSession, d: str) -> DataFrame:
    """Messages of raw records that are objects; a missing list is empty and other elements are left out."""
    v = F.try_parse_json("body")
    items = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    return table(spark, d, "candidate_records").filter(v.isNotNull()).select("record_id", F.size(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))).cast("long").alias("objects"))


def aux_08_signatures(spark: SparkSession, d: str) -> DataFrame:
    """How often each call is made: its tool and its arguments' values by field."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls")).filter("startswith(arguments, '{')")
    doc = F.array_join(F.array_sort(F.transform(F.map_entries(F.from_json("arguments", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")
    return calls.groupBy("name", doc.alias("arguments")).agg(F.count("*").alias("calls")).filter(F.col("arguments").isNotNull() & ~F.col("arguments").contains("[") & ~F.col("arguments").contains("{")).select(F.concat("name", F.lit(":"), "arguments").alias("signature"), "calls")


def aux_20_paired_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each trajectory's calls as pairs of a call and its response, in order: how many messages that makes, and which tools they begin with."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls"))
    made = calls.select("trajectory_id", F.struct("message_index", "call_pos", "name", "call_id", F.coalesce("error", F.lit(False)).alias("error")).alias("c"))
    listed = made.groupBy("trajectory_id").agg(F.array_sort(F.collect_list("c")).alias("c"))  # one trajectory's calls
    pairs = F.flatten(F.transform("c", lambda c: F.array(F.struct(F.lit("assistant").alias("role"), c["name"].alias("name"), c["call_id"].alias("id")), F.struct(F.lit("tool").alias("role"), c["name"].alias("name"), c["call_id"].alias("id")))))
    return listed.select("trajectory_id", pairs.alias("m")).select("trajectory_id", F.size("m").cast("long").alias("messages"), F.array_join(F.transform(F.slice("m", 1, 4), lambda m: F.concat(m["role"], F.lit(":"), m["name"])), ",").alias("head"))


def prj_10_review_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer is shown of each run of a model, as one JSON text."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls")).groupBy("trajectory_id").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"))
    rows = ev.one_per_trial(runs(spark, d)).join(calls, "trajectory_id", "left")
    flag = F.when(F.coalesce("errors", F.lit(0)) > 0, "tool_error").otherwise("none")
    payload = F.to_json(F.struct(F.col("model_label").alias("model"), "termination_reason", flag.alias("diagnostic_flag"), F.coalesce("calls", F.lit(0)).alias("calls")))
    return rows.select("trajectory_id", payload.alias("payload"))


# The features that are shown side by side.
WIDE = [
    "reward", "success", "termination_reason", "duration_seconds", "assistant_turns", "completion_tokens", "max_prompt_tokens", "tool_calls", "read_calls", "write_calls", "utility_calls", "transfer_calls", "tool_errors", "read_errors", "write_errors",
    "exact_repeated_calls", "consecutive_exact_retries", "mixed_reply_turns", "unobserved_reference_writes", "nonreference_writes", "tool_sequence", "error_messages", "error_recoveries", "diagnostic_flags",
]


def prj_08_all_features(spark: SparkSession, d: str) -> DataFrame:
    """Each task and trial with all features of all models side by side.

    A task's reference writes are those of its successful runs.  The source has
    neither prompts' tokens nor replies with text and calls, so these are 0.
    """
    calls = table(spark, d, "tool_calls")
    one = ev.one_per_trial(runs(spark, d)).withColumns({"max_prompt_tokens": F.lit(0), "mixed_reply_turns": F.lit(0)})
    good = runs(spark, d).filter("abs(reward - 1) <= 1e-6").select("trajectory_id").distinct()
    references = ev.distinct_calls(calls).filter("family = 'write' AND task_id IS NOT NULL").join(good, "trajectory_id", "left_semi").select("task_id", "name").distinct()
    return ev.side_by_side(ev.full_features(one, calls, references), ["task_id", "trial"], "model_label", ["sft", "vanilla", "potential"], WIDE)


def agg_22_assistant_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Turns, completion tokens and longest prompt of each conversation; the source has no usage, so only turns with calls count."""
    return newest(spark, d, "messages").select("trajectory_id", *[c.cast("long").alias(n) for n, c in cu.assistant_tokens(F.col("messages"), usage=False).items()])


def dat_01_call_times(spark: SparkSession, d: str) -> DataFrame:
    """When each call was made, in ISO form, and how long it took."""
    calls = ev.distinct_calls(table(spark, d, "tool_calls")).filter("called_at IS NOT NULL")
    return calls.select("call_id", F.date_format("called_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("called_at"), (F.timestamp_diff("MICROSECOND", F.col("called_at"), F.col("finished_at")) / 1e6).alias("seconds"))


def str_05_communicated(spark: SparkSession, d: str) -> DataFrame:
    """What tool results tell: every value and key, normalised, and the words of texts; how many trajectories are told each."""
    rows = newest(spark, d, "messages").select("trajectory_id", F.explode("messages").alias("m")).filter("m.role = 'tool' AND m.content IS NOT NULL")
    told = fc.communicated_values(rows.select("trajectory_id", F.col("m.content").alias("content")), "trajectory_id", "content")
    return told.groupBy("vtype", "value").agg(F.count_distinct("trajectory_id").alias("trajectories"))


def jon_10_expanded_references(spark: SparkSession, d: str) -> DataFrame:
    """What each task's calls name, with the users that the named orders belong to."""
    calls = table(spark, d, "tool_calls").filter("task_id IS NOT NULL AND startswith(arguments, '{')")
    orders = table(spark, d, "tasks").filter("user_id IS NOT NULL").select("user_id", F.explode("order_ids").alias("order_id")).filter("order_id IS NOT NULL").groupBy("order_id").agg(F.min("user_id").alias("user_id"))
    refs = fc.references(calls, "task_id", "arguments")
    return fc.expand_references(refs, "task_id", orders, spark.createDataFrame([], "user_id string, payment_id string"))


def _order_facts(spark: SparkSession, d: str) -> DataFrame:
    """What looking up each task's orders would show."""
    rows = table(spark, d, "tasks").filter("task_id IS NOT NULL").select("task_id", "user_id", F.explode("order_ids").alias("order_id")).filter("order_id IS NOT NULL").distinct()
    docs = rows.select("task_id", F.lit("get_order_details").alias("tool"), F.to_json(F.struct("order_id", "user_id")).alias("result"))
    return fc.observed_facts(docs, "task_id", "tool", "result").distinct()


def _shown(facts: DataFrame) -> DataFrame:
    return facts.select("task_id", "kind", F.array_join("subject", "|").alias("subject"), "value")


def jsn_09_order_facts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_order_facts(spark, d))


def jsn_08_user_facts(spark: SparkSession, d: str) -> DataFrame:
    """What looking up each task's user would show."""
    rows = table(spark, d, "tasks").filter("task_id IS NOT NULL AND user_id IS NOT NULL").select("task_id", "user_id", "order_ids").distinct()
    docs = rows.select("task_id", F.lit("get_user_details").alias("tool"), F.to_json(F.struct("user_id", F.col("order_ids").alias("orders"))).alias("result"))
    return _shown(fc.observed_facts(docs, "task_id", "tool", "result").distinct())


def jsn_10_product_facts(spark: SparkSession, d: str) -> DataFrame:
    """What looking up each part as a product with one variant would show."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("n"), F.col("p_size").cast("string").alias("s"))
    variant = F.struct(F.concat(F.lit("v"), "k").alias("item_id"), F.create_map(F.lit("size"), F.col("s")).alias("options"))
    docs = part.select(F.col("k").alias("task_id"), F.lit("get_product_details").alias("tool"), F.to_json(F.struct(F.col("k").alias("product_id"), F.col("n").alias("name"), F.create_map(F.concat(F.lit("v"), "k"), variant).alias("variants"))).alias("result"))
    return _shown(fc.observed_facts(docs, "task_id", "tool", "result")).groupBy("kind").agg(F.count("*").alias("facts"), F.count_distinct("subject", "value").alias("different"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "tool_calls").filter("task_id IS NOT NULL AND startswith(arguments, '{')")
    return fc.references(calls, "task_id", "arguments", "name")


def flt_20_relevant_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each task's order facts those about an order that its calls name."""
    return _shown(fc.relevant_facts(_order_facts(spark, d), _named(spark, d), "task_id"))


def flt_21_write_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each task's order facts those that justify a write."""
    return _shown(fc.relevant_facts(_order_facts(spark, d), _named(spark, d), "task_id", before_writes=True))


def set_07_target_facts(spark: SparkSession, d: str) -> DataFrame:
    """What each task wants found out: its relevant order facts, and the user as a value to tell where nothing else is wanted."""
    users = table(spark, d, "tasks").filter("task_id IS NOT NULL AND user_id IS NOT NULL").select("task_id", F.lit("communicate").alias("ref_kind"), F.col("user_id").alias("id")).distinct()
    facts = _order_facts(spark, d)
    none = spark.createDataFrame([], "task_id string, value string")
    return _shown(fc.target_facts(facts, facts, _named(spark, d).unionByName(users), none, "task_id"))


def jon_11_variants(spark: SparkSession, d: str) -> DataFrame:
    """The first product, by its text, among whose variants each size is."""
    part = table(spark, d, "part").select(F.struct(F.col("p_partkey").cast("string").alias("product_id"), F.create_map(F.col("p_size").cast("string"), F.col("p_brand")).alias("variants")).alias("product"))
    return fc.variants(part)


# Readers and writers: written to the shared folder, read back.


def src_02_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw records written as lines and read back with their numbers: how many, whether each is numbered once, how many are JSON."""
    path = shared_path(spark, "lines")
    bodies = table(spark, d, "candidate_records").select(F.regexp_replace(F.coalesce("body", F.lit("")), r"[\r\n\x0b\x0c\x85  ]", " ").alias("value"))
    bodies.repartition(3).write.text(path)
    lines = readers.json_lines(spark, path)
    return lines.groupBy().agg(F.count("*").alias("lines"), F.count_distinct("file", "line").alias("numbered"), F.count_if("ok").alias("json"))


def src_04_clean_runs(spark: SparkSession, d: str) -> DataFrame:
    """What an audit finds in the runs of each model: repeated trials, trials missing of four, runs without a reward."""
    rows = table(spark, d, "trajectory_features").distinct().filter("task_id IS NOT NULL AND model_label IS NOT NULL").select(F.concat_ws("|", "model_label", "task_id").alias("task_id"), "trial", "termination_reason", F.struct("reward").alias("reward_info"))
    return readers.audit_runs(rows, rows.select("task_id").distinct(), 4).groupBy("problem").agg(F.count("*").alias("found"))


def src_05_existing(spark: SparkSession, d: str) -> DataFrame:
    """Tasks written in as many files as there are splits, found by pattern and read."""
    path = shared_path(spark, "parts")
    table(spark, d, "tasks").select("task_id", F.coalesce("extra_info.split", F.lit("none")).alias("part")).write.partitionBy("part").json(path)
    found = [p for folder in files.matching(f"{path}/part=*") for p in readers.existing(folder)]
    return spark.read.schema("task_id string").json(found).groupBy("task_id").agg(F.count("*").alias("rows"))


def src_06_logs(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory logs, one file a partition, read without those that have no reward."""
    path = shared_path(spark, "logs")
    runs(spark, d).select(F.col("trajectory_id").alias("request_id"), F.col("model_label").alias("run_id"), "task_id", "reward", "termination_reason", F.col("completion_tokens").alias("response_tokens")).write.option("multiLine", "false").json(path)
    rows = spark.read.schema(readers.TRAJECTORY_LOG).json(path).filter("reward IS NOT NULL")
    return rows.groupBy("run_id").agg(F.count("*").alias("logs"), F.round(F.avg("reward"), 6).alias("reward"))


def src_07_resumed(spark: SparkSession, d: str) -> DataFrame:
    """A judging run broken off and resumed: what is written in either part, each once."""
    path = shared_path(spark, "judged")
    rows = newest(spark, d, "semantic_screening").select("trajectory_id", F.col("semantic_screening.decision").alias("decision"))
    left = lambda: rows.join(readers.completed_ids(spark, f"{path}/*.json"), "trajectory_id", "left_anti")
    writers.append_finished(left().filter("decision = 'accepted'"), path)
    writers.append_finished(left(), path)
    return spark.read.schema("trajectory_id string, decision string").json(path).select("trajectory_id", "decision")


def snk_02_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "jsonl")
    rows = table(spark, d, "tool_catalog")
    writers.write_jsonl(rows, path, ["name"])
    return spark.read.schema(rows.schema).json(path)


def snk_03_csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv")
    writers.write_csv(runs(spark, d).select("trajectory_id", "model_label", "trial", "reward"), path)
    return spark.read.schema("trajectory_id string, model_label string, trial int, reward double").option("header", "true").csv(path)


def snk_04_union_csv(spark: SparkSession, d: str) -> DataFrame:
    """Tools and settings in one table, each with its own columns."""
    path = shared_path(spark, "union")
    writers.write_union_csv([table(spark, d, "tool_catalog").select("name", "family"), table(spark, d, "run_settings")], path)
    return spark.read.schema("name string, family string, setting_name string, setting_value double").option("header", "true").csv(path)


def snk_06_published(spark: SparkSession, d: str) -> DataFrame:
    """Settings published only whole: a failed attempt leaves nothing, the next one is read."""
    path = shared_path(spark, "published")
    rows = table(spark, d, "run_settings")

    def refuse(_: str) -> None:
        raise readers.InputError("refused")

    try:
        writers.publish(path, rows.limit(1).write.parquet, refuse)
    except readers.InputError:
        pass
    left = files.exists(path)
    writers.publish(path, rows.write.parquet)
    return spark.read.parquet(path).withColumn("left_before", F.lit(left))


def snk_08_log_table(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows of two steps, the first logged twice: a step written again replaces itself."""
    path = shared_path(spark, "metrics")
    rows = runs(spark, d).groupBy("model_label").agg(F.count("*").alias("runs"))
    for step in (1, 2, 1):
        writers.log_table(rows, path, step)
    return spark.read.parquet(path).select(F.col("step").cast("long").alias("step"), "model_label", "runs")


def snk_15_side_output(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts beside good ones: how many of each, and how many failed ones carry a reward."""
    path = shared_path(spark, "sides")
    writers.split_errors(runs(spark, d).select("trajectory_id", "termination_reason", "reward"), path, "infrastructure_error")
    read = lambda part: spark.read.schema("trajectory_id string, termination_reason string, reward double").json(f"{path}/{part}").select(F.lit(part).alias("part"), "reward")
    return read("trajectories").unionByName(read("infrastructure_errors")).groupBy("part").agg(F.count("*").alias("rows"), F.count("reward").alias("with_reward"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import re

    return {k: v for k, v in globals().items() if callable(v) and re.match(r"(src|snk|prj|flt|jon|agg|set|str|jsn|aux|dat)_\d+_", k)}


_TN = "cast(try_cast(regexp_extract(l.task_id, '([0-9]+)', 1) as bigint) as varchar)"
_FROM_0 = "list_transform(range(0, len(m)), lambda i: {})"
# Training messages with the system message, as a list m; and every message's first error, in order.
_MSG = f"""{_TRAIN}, mm as (select tr.trajectory_id, {_TN} as task_id, l.tier, l.source_run, list_concat([{{'role': 'system', 'content': '{SYSTEM}', 'tool_call_id': null, 'tool_calls': []}}], list_transform(ms, lambda x: {{'role': x.role, 'content': x.content, 'tool_call_id': x.tool_call_id, 'tool_calls': coalesce(x.tool_calls, [])}})) as m from tr join l using (trajectory_id)),
 mu as (select trajectory_id, unnest(m) as x, generate_subscripts(m, 1) - 1 as i from mm),
 cu as (select trajectory_id, i, unnest(x.tool_calls) as c, generate_subscripts(x.tool_calls, 1) - 1 as j from mu where x.role = 'assistant'),
 ce as (select trajectory_id, i, min_by(e, j) as e from (select trajectory_id, i, j, case when trim(coalesce(c.id, '')) = '' then ['.tool_calls[' || j || '].id', 'empty'] when trim(coalesce(c.name, '')) = '' then ['.tool_calls[' || j || '].function.name', 'empty']
   when not coalesce(json_valid(c.arguments) and json_type(c.arguments) = 'OBJECT', false) then ['.tool_calls[' || j || '].function.arguments', 'not an object'] end as e from cu) where e is not null group by 1, 2),
 me as (select mu.trajectory_id, mu.i, x, case when trim(coalesce(x.role, '')) = '' then ['.role', 'empty'] when x.role not in ('system', 'user', 'assistant', 'tool') then ['.role', 'unsupported']
   when x.role in ('system', 'user') then case when trim(coalesce(x.content, '')) = '' then ['.content', 'empty'] end
   when x.role = 'tool' then case when x.content is null then ['.content', 'no text'] when trim(coalesce(x.tool_call_id, '')) = '' then ['.tool_call_id', 'empty'] end
   when ce.e is not null then ce.e when (trim(coalesce(x.content, '')) = '') = (len(x.tool_calls) = 0) then ['', 'neither or both of text and calls'] when len(x.tool_calls) > 1 then ['', 'more than one call'] end as e from mu left join ce on ce.trajectory_id = mu.trajectory_id and ce.i = mu.i),
 fe as (select trajectory_id, min_by(struct_pack(i := i, e := e), i) as f from me where e is not null group by 1)"""
_ROLE = "case when m[i].role = 'system' then 'user' when m[i].role in ('user', 'tool') then 'assistant' when len(m[i].tool_calls) > 0 then 'tool' else 'user' end"
_ROW_ERRORS = f"""with {_MSG}, cat as (select list(name) as names from tool_catalog),
 pl as (select trajectory_id, min_by(struct_pack(l := l, e := e), i * 10 + k) as p from (
   select mm.trajectory_id, i, 0 as k, 'messages[' || (i - 1) || '].tool_calls[0].function.name' as l, 'unknown tool' as e from (select *, unnest(range(1, len(m) + 1)) as i from mm) mm, cat where len(m[i].tool_calls) > 0 and not list_contains(names, m[i].tool_calls[1].name)
   union all select trajectory_id, i, 1, 'messages[' || (i - 1) || ']', 'call without a result' from (select *, unnest(range(1, len(m) + 1)) as i from mm) where len(m[i].tool_calls) > 0 and m[i + 1].role is distinct from 'tool'
   union all select trajectory_id, i, 2, 'messages[' || i || '].tool_call_id', 'answers another call' from (select *, unnest(range(1, len(m) + 1)) as i from mm) where len(m[i].tool_calls) > 0 and m[i + 1].role = 'tool' and m[i + 1].tool_call_id <> m[i].tool_calls[1].id
   union all select trajectory_id, i, 3, 'messages[' || (i - 1) || ']', 'result without a call' from (select *, unnest(range(1, len(m) + 1)) as i from mm) where m[i].role = 'tool' and (i = 1 or coalesce(len(m[i - 1].tool_calls), 0) = 0)) group by 1),
 ids as (select trajectory_id, list_transform(list_filter(m, lambda x: len(x.tool_calls) > 0), lambda x: x.tool_calls[1].id) as a, list_transform(list_filter(m, lambda x: x.role = 'tool'), lambda x: x.tool_call_id) as b from mm),
 rep as (select trajectory_id, string_agg(id, ', ' order by id) as twice from (select trajectory_id, id from (select trajectory_id, unnest(a) as id from ids) group by 1, 2 having count(*) > 1) group by 1),
 tn as (select trajectory_id, min_by(struct_pack(l := 'messages[' || i || ']', e := 'after ' || m[i].role || ': ' || m[i + 1].role), i) as p from (select *, unnest(range(1, len(m))) as i from mm) where m[i + 1].role <> {_ROLE} group by 1),
 r as (select mm.*, fe.f, pl.p, rep.twice, list_sort(ids.a) <> list_sort(ids.b) as apart, tn.p as t from mm left join fe using (trajectory_id) left join pl using (trajectory_id) left join ids using (trajectory_id) left join rep using (trajectory_id) left join tn using (trajectory_id)),
 x as (select trajectory_id, case when trim(trajectory_id) = '' then ['trajectory_id', 'empty'] when coalesce(task_id, '') = '' then ['task_id', 'empty'] when f is not null then ['messages[' || f.i || ']' || f.e[1], f.e[2]] when len(m) < 3 then ['messages', 'fewer than three'] when m[2].role <> 'user' then ['messages[1]', 'no user message']
   when m[-1].role <> 'assistant' or coalesce(m[-1].content, '') = '' then ['messages[' || (len(m) - 1) || ']', 'no text at the end'] when len(list_filter(m[2:], lambda x: x.role = 'system')) > 0 then ['messages', 'system message inside'] when p is not null then [p.l, p.e] when twice is not null then ['messages', 'repeated call ids: ' || twice]
   when apart then ['messages', 'calls and results don''t pair'] when t is not null then [t.l, t.e] end as e from r)
 select trajectory_id, e[1] as location, e[2] as error from x"""
_BODY = """b as (select record_id, body, case when json_valid(body) and json_type(body) = 'OBJECT' then list_sort(list_filter(['trajectory_id', 'task_id', 'messages', 'tools', 'metadata'], lambda k: not list_contains(json_keys(body), k))) end as lack from candidate_records)"""
_POINTS = "list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c))"
_ROLLOUTS = f"""{_RUNS}, {_ONCE}, oc as (select trajectory_id, count(*) as tool_call_count, count(*) filter (error) as num_errors, sum(coalesce(length(error_text), 0))::bigint as tool_response_tokens from o group by 1),
 ro as (select f.trajectory_id, model_label, task_id, trial as rollout_index, reward, termination_reason, assistant_turns, completion_tokens as assistant_tokens, duration_seconds as trajectory_seconds, consecutive_exact_retries as infrastructure_retry_count, tool_call_count, num_errors, tool_response_tokens,
   coalesce(completion_tokens, 0) + coalesce(tool_response_tokens, 0) as response_tokens from f left join oc using (trajectory_id)),
 rs as (select *, response_tokens - assistant_tokens as observation_tokens, {{ratio_a}} as assistant_tokens_per_turn, {{ratio_b}} as tool_response_tokens_per_call from ro)"""
_RATIO = lambda a, b: f"coalesce({a}::double / nullif({b}, 0), 0)"
_RO = _ROLLOUTS.format(ratio_a=_RATIO("assistant_tokens", "assistant_turns"), ratio_b=_RATIO("tool_response_tokens", "tool_call_count"))
_OF = """ot as (select distinct task_id, user_id, unnest(order_ids) as o from tasks where task_id is not null),
 oa as (select distinct task_id, 'order_known' as kind, o as subject, null::varchar as value from ot where o is not null union select task_id, 'order_user', o, user_id from ot where o is not null and user_id is not null)"""
_NAMED = """nk as (select distinct task_id, name, k, unnest(case when json_type(arguments, '$."' || k || '"') = 'ARRAY' then cast(json_extract(arguments, '$."' || k || '"') as varchar[]) else [json_extract_string(arguments, '$."' || k || '"')] end) as id from (select task_id, name, arguments, unnest(json_keys(arguments)) as k from tool_calls where task_id is not null and json_valid(arguments) and json_type(arguments) = 'OBJECT') where k in ('order_id') and json_type(arguments, '$."' || k || '"') <> 'NULL'),
 nr as (select distinct task_id, 'order' as ref_kind, id from nk)"""
_NULLS = ["user_turns", "slot_id", "user_observation_tokens", "generation_seconds", "user_seconds", "num_preempted", *[c for c in ro.TABLE if c.startswith("turn_credit")]]


def _metrics_sql() -> str:
    here = {c: p for c, p in ro.DISTRIBUTIONS.items() if c in ("assistant_turns", "tool_call_count", "num_errors", "response_tokens", "assistant_tokens", "observation_tokens", "tool_response_tokens", "assistant_tokens_per_turn", "tool_response_tokens_per_call", "trajectory_seconds")}
    one = lambda metric, value, of: f"select model_label, '{metric}' as metric, {value} as value from {of} group by 1"
    parts = [one(f"{p}/{n}", v.format(c=f"{c}::double"), "k") for c, p in here.items() for n, v in (("mean", "avg({c})"), ("p90", "quantile_cont({c}, 0.9)"), ("max", "max({c})"))]
    won = "count(*) filter (reward > 0.5)"
    parts += [one("reward/success_count", f"{won}::double", "k"), one("reward/failure_count", f"(count(*) - {won})::double", "k"), one("reward/success_rate", f"{won} / count(*)", "k"), one("rollout/valid_trajectories", "count(*)::double", "k")]
    parts += [one("infra/retry_attempt_count", "sum(infrastructure_retry_count)::double", "k"), one("infra/retried_trajectory_count", "(count(*) filter (infrastructure_retry_count > 0))::double", "k"), one("rollout/assistant_token_fraction", "sum(assistant_tokens) / nullif(sum(response_tokens), 0)", "k")]
    parts += [one("grpo/group_count", "count(*)::double", "g"), one("grpo/zero_signal_group_count", "(count(*) filter (not a))::double", "g"), one("grpo/mixed_group_count", "(count(*) filter (a))::double", "g"), one("grpo/mixed_group_ratio", "(count(*) filter (a)) / count(*)", "g")]
    for n, c in (("outcome", "a"), ("local", "b"), ("effective", "a or b")):
        parts += [one(f"grpo/{n}_signal_group_count", f"(count(*) filter ({c}))::double", "g"), one(f"grpo/{n}_signal_group_ratio", f"(count(*) filter ({c})) / count(*)", "g")]
    parts += [one("grpo/group_reward_mean_min", "min(mean)", "g"), one("grpo/group_reward_mean_max", "max(mean)", "g"), one("grpo/group_reward_mean", "avg(mean)", "g")]
    parts.append("select model_label, 'termination/' || regexp_replace(coalesce(termination_reason, 'none'), '[- ]', '_', 'g') || '_count', count(*)::double from k group by 1, 2")
    return f"with {_RO}, k as (select * from rs where reward is not null), g as (select model_label, task_id, avg(reward) as mean, min(reward) < max(reward) as a, bool_or(coalesce(infrastructure_retry_count > 0, false)) as b from k where task_id is not null group by 1, 2) select model_label, metric, round(value, 5) as value from (" + " union all ".join(parts) + ") where value is not null"


def oracle_sql() -> dict[str, str]:
    from logloom.plans.preprocess import rendered_sql

    signature = "array_to_string(list_sort(list_transform(json_keys(arguments), lambda k: k || '=' || coalesce(json_extract_string(arguments, '$.\"' || k || '\"'), 'null'))), ';')"
    return {
        "flt_03_row_errors": _ROW_ERRORS,
        "flt_04_record_keys": f"with {_BODY} select record_id, case when lack is null then '' else '' end as location, case when lack is null then 'not an object' else 'missing keys: ' || array_to_string(lack, ', ') end as error from b",
        "aux_29_chat_rows": f"with {_MSG} select trajectory_id, task_id, len(m) as messages, coalesce(list_sum(list_transform(m, lambda x: case when x.role = 'assistant' then len(x.tool_calls) else 0 end)), 0)::bigint as calls, len(list_filter(m, lambda x: x.content is null)) > 0 as null_content, (select count(*) from tool_catalog) as tools, tier, source_run from mm",
        "flt_10_loose_errors": f"""with {_MSG}, t as (select trajectory_id, min_by(e, i) as e from (select trajectory_id, i, case when coalesce(x.role in ('system', 'user', 'assistant', 'tool'), false) = false then 'unsupported role' when x.role = 'assistant' and (trim(coalesce(x.content, '')) = '') = (len(x.tool_calls) = 0) then 'neither or both of text and calls' end as e from mu) where e is not null group by 1)
          select mm.trajectory_id, case when t.e is not null then t.e when list_sort(flatten(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: list_transform(x.tool_calls, lambda c: c.id)))) is distinct from list_sort(list_transform(list_filter(m, lambda x: x.role = 'tool'), lambda x: x.tool_call_id)) then 'calls and results don''t pair' when len(list_filter(m, lambda x: x.role = 'assistant')) = 0 then 'no assistant' end as error from mm left join t using (trajectory_id)""",
        "flt_23_turn_errors": f"""with {_N}, u as (select unnest(messages) as m from l), e as (select m.role as role, case when m.role not in ('assistant', 'user') then null when trim(coalesce(m.content, '')) = '' and len(coalesce(m.tool_calls, [])) = 0 then 'empty' when trim(coalesce(m.content, '')) <> '' and len(coalesce(m.tool_calls, [])) > 0 then 'text and calls' when m.role = 'user' and len(coalesce(m.tool_calls, [])) > 0 then 'users call nothing' end as error from u)
          select role, error, count(*) as messages from e where error is not null group by 1, 2""",
        "jsn_13_serialized": f"with {_N}, u as (select trajectory_id, generate_subscripts(messages, 1) - 1 as turn_index, unnest(messages) as m from l) select trajectory_id, turn_index, case when m.role is null then json_object('turn_index', turn_index, 'calls', len(coalesce(m.tool_calls, [])))::varchar else json_object('turn_index', turn_index, 'role', m.role, 'calls', len(coalesce(m.tool_calls, [])))::varchar end as message from u",
        "jsn_15_round_trip": f"with {_TRAIN} select trajectory_id, true as encoded, null::bigint as difference, true as reencodes from tr",
        "aux_28_call_counts": f"with {_TRAIN} select trajectory_id, coalesce(list_sum(list_transform(ms, lambda m: case when m.role = 'assistant' then len(coalesce(m.tool_calls, [])) else 0 end)), 0)::bigint as calls, sha256('<|im_start|>{{role}}' || chr(10) || '{{content}}<|im_end|>' || chr(10)) as template_sha256 from tr",
        "aux_46_render_report": f"with {rendered_sql()} select trajectory_id, 1 as system, {', '.join(f"len(list_filter(ms, lambda m: m.role = '{r}')) as \"{r}\"" for r in ("user", "assistant", "tool"))}, len(ms) + 1 as starts, len(ms) + 1 as ends, sha256(t) as sha256 from re",
        "flt_13_store": f"with r as (select {_POINTS} as p from documents) select count(*) as trajectories, sum(len(p))::bigint as tokens, 0 as errors from r where len(p) > 1",
        "src_08_token_dataset": f"with r as (select {_POINTS} as p from documents) select count(*) as rows, sum(len(p))::bigint as tokens, sum(len(p) - 1)::bigint as supervised_tokens, min(list_min(p)) as least_id, max(list_max(p)) as most_id from r where len(p) > 1",
        "src_09_lookup": f"with r as (select {_POINTS} as p, doc_id from documents), k as (select *, row_number() over (order by doc_id) - 1 as idx from r where len(p) > 1) select idx, len(p) as tokens, list_transform(p[1:3], lambda x: x::varchar) as head from k order by idx desc limit 1",
        "aux_32_store_metadata": f"with r as (select {_POINTS} as p, doc_id from documents) select doc_id, len(p) as tokens, true as agrees, 1 as masked from r where len(p) > 1",
        "aux_45_sample_summary": f"with r as (select doc_id, {_POINTS} as p from documents where text <> '') select doc_id, len(p) as tokens, array_to_string(p[1:12], ' ') as first_ids, array_to_string(p[greatest(len(p) - 11, 1):], ' ') as last_ids from r",
        "aux_33_padded_batches": "with r as (select n_chars, (row_number() over (order by n_chars, doc_id) - 1) // 16 as b from documents where n_chars > 0) select b::bigint as batch_id, count(*) as rows, sum(n_chars)::bigint as tokens, (ceil(max(n_chars) / 8.0) * 8)::bigint as width, count(*) * (ceil(max(n_chars) / 8.0) * 8)::bigint - sum(n_chars)::bigint as padding from r group by 1",
        "prj_14_rollout_summary": f"with {_RO} select trajectory_id, model_label, rollout_index, tool_call_count, num_errors, response_tokens, observation_tokens, round(assistant_tokens_per_turn, 6) as assistant_tokens_per_turn, round(tool_response_tokens_per_call, 6) as tool_response_tokens_per_call from rs",
        "prj_15_trajectory_table": f"with {_RO} select 1 as step, reward, task_id, rollout_index, termination_reason, assistant_turns, tool_call_count, num_errors, assistant_tokens, observation_tokens, tool_response_tokens, trajectory_seconds, infrastructure_retry_count, {', '.join(f'null::varchar as {c}' for c in _NULLS)} from rs",
        "agg_24_step_metrics": _metrics_sql(),
        "aux_38_sequence_scores": f"with {_N} select trajectory_id, coalesce(list_sum(list_transform(messages, lambda m: case when m.role = 'tool' and coalesce(m.error, false) then -2.0 else 1.0 end)), 0)::double as score from l",
        "aux_41_trajectory_info": f"with {_N}, u as (select generate_subscripts(messages, 1) - 1 as i, unnest(messages) as m from l) select 3 as step, coalesce(m.turn_idx, -1) as rollout_index, coalesce(m.role = 'user', false) as validate, count(*) as rows, sum(i)::bigint as samples from u group by 2, 3",
        "aux_42_target_positions": f"with {_N} select trajectory_id, array_to_string(list_filter(range(0, len(messages)), lambda i: coalesce(messages[i + 2].role = 'assistant', false)), ',') as places, array_to_string(list_transform(range(0, len(messages)), lambda i: case when coalesce(messages[i + 2].role = 'assistant', false) then coalesce(length(messages[i + 1].content), 0) else 0 end), ',') as lengths from l where len(messages) > 0",
        "aux_14_policy_specs": "select distinct model_label, trial as step, printf('step_%03d', trial) as policy from trajectory_features where trial is not null",
        "aux_03_rewards": """with j as (select case when json_valid(body) then body end as b from candidate_records), r as (select b, coalesce(json_extract(b, '$.outcome.reward'), json_extract(b, '$.reward_info.reward'), json_extract(b, '$.reward')) as r from j),
          s as (select case when b is null then 'no document' when r is null then 'missing' when json_type(r) = 'NULL' then 'null' when json_type(r) in ('VARCHAR', 'OBJECT', 'ARRAY') then 'no number' else 'number' end as state from r) select state, count(*) as records from s group by 1""",
        "aux_05_reference_actions": "with j as (select record_id, body from candidate_records where json_valid(body)) select record_id, case when json_type(body, '$.messages') = 'ARRAY' then len(list_filter(json_extract(body, '$.messages[*]'), lambda x: json_type(x) = 'OBJECT')) else 0 end as objects from j",
        "aux_08_signatures": f"with {_ONCE}, s as (select name || ':' || {signature} as signature from o where starts_with(arguments, '{{') and json_valid(arguments)) select signature, count(*) as calls from s where not contains(signature, '[') and not contains(signature, '{{') group by 1",
        "aux_20_paired_messages": f"with {_ONCE}, c as (select trajectory_id, list(name order by message_index, call_pos, name, call_id) as n from o group by 1) select trajectory_id, len(n) * 2 as messages, case when len(n) > 1 then 'assistant:' || n[1] || ',tool:' || n[1] || ',assistant:' || n[2] || ',tool:' || n[2] else 'assistant:' || n[1] || ',tool:' || n[1] end as head from c",
        "prj_10_review_payload": f"with {_RUNS}, {_ONCE}, p as (select * from (select *, row_number() over (partition by model_label, task_id, trial order by trajectory_id) rn from f where task_id is not null and reward is not null) where rn = 1), oc as (select trajectory_id, count(*) as k, count(*) filter (error) as e from o group by 1) select trajectory_id, case when termination_reason is null then json_object('model', model_label, 'diagnostic_flag', case when coalesce(e, 0) > 0 then 'tool_error' else 'none' end, 'calls', coalesce(k, 0))::varchar else json_object('model', model_label, 'termination_reason', termination_reason, 'diagnostic_flag', case when coalesce(e, 0) > 0 then 'tool_error' else 'none' end, 'calls', coalesce(k, 0))::varchar end as payload from p left join oc using (trajectory_id)",
        "prj_08_all_features": f"""with {_RUNS}, {_SIG}, p as (select * from (select *, row_number() over (partition by model_label, task_id, trial order by trajectory_id) rn from f where task_id is not null and reward is not null) where rn = 1),
          gd as (select distinct trajectory_id from f where abs(reward - 1) <= 1e-6), wr as (select task_id, list(distinct name) as wanted from o where family = 'write' and task_id is not null and trajectory_id in (select * from gd) group by 1),
          pc as (select trajectory_id, count(*) as tool_calls, {", ".join(f"count(*) filter (family = '{f}') as {n}_calls" for f, n in (("read", "read"), ("write", "write"), ("other", "utility"), ("transfer", "transfer")))}, count(*) filter (error) as tool_errors, count(*) filter (error and family = 'read') as read_errors, count(*) filter (error and family = 'write') as write_errors,
            string_agg(coalesce(name, ''), ' -> ' order by message_index, call_pos) as tool_sequence, list(distinct name) filter (family = 'write') as written from o group by 1),
          er as (select trajectory_id, '{{' || string_agg(to_json(error_text)::varchar || ':' || n, ',' order by error_text) || '}}' as error_messages from (select trajectory_id, error_text, count(*) n from o where error and error_text is not null group by 1, 2) group by 1),
          nx as (select *, lead(name) over w as nname, lead(doc) over w as ndoc, lead(trajectory_id) over w as nt from sg window w as (partition by trajectory_id order by message_index, call_pos)),
          rc as (select trajectory_id, case when response_message_index is null then 'missing_response' when nt is null then 'abandon' when nname is distinct from name then 'alternate_tool' when ndoc is not distinct from doc then 'exact_retry' else 'corrected_retry' end as recovery from nx where response_message_index is null or error),
          rj as (select trajectory_id, '{{' || string_agg('"' || recovery || '":' || n, ',' order by recovery) || '}}' as error_recoveries from (select trajectory_id, recovery, count(*) n from rc group by 1, 2) group by 1),
          a as (select p.*, abs(reward - 1) <= 1e-6 as ok, {", ".join(f"coalesce(pc.{c}, 0) as {c}" for c in ("tool_calls", "read_calls", "write_calls", "utility_calls", "transfer_calls", "tool_errors", "read_errors", "write_errors"))}, coalesce(tool_sequence, '') as tool_sequence, coalesce(error_messages, '{{}}') as error_messages, coalesce(error_recoveries, '{{}}') as error_recoveries, 0 as max_prompt_tokens, 0 as mixed_reply_turns,
            array_to_string(list_sort(list_filter(coalesce(wanted, []), lambda x: not list_contains(coalesce(written, []), x))), ' | ') as unobserved_reference_writes, array_to_string(list_sort(list_filter(coalesce(written, []), lambda x: not list_contains(coalesce(wanted, []), x))), ' | ') as nonreference_writes
            from p left join pc using (trajectory_id) left join er using (trajectory_id) left join rj using (trajectory_id) left join wr using (task_id)),
          b as (select *, array_to_string(list_filter([case when coalesce(termination_reason, '') not in ('user_stop', 'agent_stop', '') then 'abnormal_termination:' || termination_reason end, case when write_errors > 0 then 'write_tool_error' end, case when exact_repeated_calls > 0 then 'exact_repeated_call' end, case when transfer_calls > 0 then 'transfer_to_human' end, case when read_errors > 0 then 'read_tool_error_needs_review' end], lambda x: x is not null), ' | ') as diagnostic_flags from a)
          select task_id, trial, """ + ", ".join(f"max(case when model_label = '{m}' then {c} end) as {m}_{c}" for m in ("sft", "vanilla", "potential") for c in WIDE) + " from b group by 1, 2",
        "agg_22_assistant_tokens": f"with {_N} select trajectory_id, len(list_filter(coalesce(messages, []), lambda m: m.role = 'assistant' and len(coalesce(m.tool_calls, [])) > 0)) as turns, 0 as completion_tokens, 0 as max_prompt_tokens from l",
        "dat_01_call_times": f"with {_ONCE} select call_id, strftime(called_at, '%Y-%m-%dT%H:%M:%S.%f') as called_at, date_diff('microsecond', called_at, finished_at) / 1e6 as seconds from o where called_at is not null",
        "jon_10_expanded_references": """with c as (select task_id, json_extract_string(arguments, '$.order_id') as o from tool_calls where task_id is not null and json_valid(arguments) and json_type(arguments) = 'OBJECT'), """
        + """rk as (select distinct task_id, k, unnest(case when json_type(arguments, '$."' || k || '"') = 'ARRAY' then cast(json_extract(arguments, '$."' || k || '"') as varchar[]) else [json_extract_string(arguments, '$."' || k || '"')] end) as id from (select task_id, arguments, unnest(json_keys(arguments)) as k from tool_calls where task_id is not null and json_valid(arguments) and json_type(arguments) = 'OBJECT') where k in ('user_id', 'order_id', 'product_id', 'item_ids', 'new_item_ids', 'payment_method_id') and json_type(arguments, '$."' || k || '"') <> 'NULL'),
          r as (select distinct task_id, case k when 'user_id' then 'user' when 'order_id' then 'order' when 'product_id' then 'product' when 'item_ids' then 'order_item' when 'new_item_ids' then 'item' else 'payment' end as ref_kind, id from rk),
          w as (select o, min(user_id) as u from (select user_id, unnest(order_ids) as o from tasks where user_id is not null) where o is not null group by 1)
          select * from r union select r.task_id, 'user', w.u from r join w on r.ref_kind = 'order' and r.id = w.o""",
        "jsn_09_order_facts": f"with {_OF} select * from oa",
        "jsn_08_user_facts": "with t as (select distinct task_id, user_id, order_ids from tasks where task_id is not null and user_id is not null) select distinct task_id, 'user_known' as kind, user_id as subject, null::varchar as value from t union select task_id, 'user_order', user_id || '|' || o, null from (select task_id, user_id, unnest(order_ids) as o from t) where o is not null union select task_id, 'user_order', user_id, null from (select task_id, user_id, unnest(order_ids) as o from t) where o is null",
        "jsn_10_product_facts": "with p as (select p_partkey::varchar as k, p_name as n, p_size::varchar as s from part), f as (select 'product_known' as kind, k as subject, null as value from p union all select 'product_name', k, n from p where n is not null union all select 'product_variant_count', k, '1' from p union all select 'product_item', k || '|v' || k, null from p union all select 'item_known', 'v' || k, null from p union all select 'item_option', 'v' || k || '|size', s from p) select kind, count(*) as facts, count(distinct case when value is not null then subject || '#' || value end) as different from f group by 1",
        "flt_20_relevant_facts": f"with {_OF}, {_NAMED} select oa.* from oa join nr on nr.task_id = oa.task_id and nr.ref_kind = 'order' and nr.id = oa.subject",
        "flt_21_write_facts": f"with {_OF}, {_NAMED} select oa.* from oa join nr on nr.task_id = oa.task_id and nr.ref_kind = 'order' and nr.id = oa.subject",
        "set_07_target_facts": f"with {_OF}, {_NAMED}, k as (select oa.* from oa join nr on nr.task_id = oa.task_id and nr.ref_kind = 'order' and nr.id = oa.subject), c as (select distinct task_id, user_id from tasks where task_id is not null and user_id is not null) select * from k union select task_id, 'communicate_value', '', user_id from c where task_id not in (select task_id from k)",
        "jon_11_variants": "select p_size::varchar as item_id, min(p_partkey::varchar) as product_id, arg_min(p_brand, p_partkey::varchar) as variant from part group by 1",
        "src_02_json_lines": "select count(*) as lines, count(*) as numbered, count(*) filter (json_valid(regexp_replace(body, '[\r\n\x0b\x0c]', ' ', 'g'))) as json from candidate_records where trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) <> ''",
        "src_04_clean_runs": """with f as (select distinct * from trajectory_features), r as (select model_label || '|' || task_id as t, trial, termination_reason, reward from f where task_id is not null and model_label is not null), p as (select t, trial, count(*) k from r group by 1, 2),
          a as (select 'repeated trial' as problem from p where k > 1 union all select 'missing trials' from (select t from p group by 1 having count(*) < 4) union all select 'infrastructure error' from r where termination_reason = 'infrastructure_error' union all select 'no reward' from r where reward is null or isnan(reward)) select problem, count(*) as found from a group by 1""",
        "src_05_existing": "select task_id, count(*) as rows from tasks group by 1",
        "src_06_logs": f"with {_RUNS} select model_label as run_id, count(*) as logs, round(avg(reward), 6) as reward from f where reward is not null group by 1",
        "src_07_resumed": f"with {_N} select trajectory_id, semantic_screening.decision as decision from l",
        "snk_02_jsonl": "select * from tool_catalog",
        "snk_03_csv": f"with {_RUNS} select trajectory_id, model_label, trial, reward from f",
        "snk_04_union_csv": "select name, family, null::varchar as setting_name, null::double as setting_value from tool_catalog union all select null, null, setting_name, setting_value from run_settings",
        "snk_06_published": "select *, false as left_before from run_settings",
        "snk_08_log_table": f"with {_RUNS}, k as (select model_label, count(*) as runs from f group by 1) select step::bigint as step, model_label, runs from k, (values (1), (2)) as s(step)",
        "snk_15_side_output": f"with {_RUNS} select case when termination_reason = 'infrastructure_error' then 'infrastructure_errors' else 'trajectories' end as part, count(*) as rows, count(case when termination_reason <> 'infrastructure_error' then reward end) as with_reward from f where termination_reason is not null group by 1",
    }
