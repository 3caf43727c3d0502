import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logloom.operators import curation, datasets, facts, preprocess, rollout
from logloom.functions.tokens import offset_tokenizer, public_tokenizer, tokenizer_path
from logloom.sinks import writers
from logloom.sources import files, readers
from tests.conftest import MESSAGES, message

SCHEMA = "step int, g string, reward double, assistant_turns int, assistant_tokens int, response_tokens int, infrastructure_retry_count int, termination_reason string, tool_call_count int, tool_response_tokens int, extra string"


def test_metrics_and_tables_of_a_step(spark):
    rows = [(1, "a", 1.0, 2, 10, 20, 0, "user-stop", 0, 0, "x"), (1, "a", 0.0, 4, 10, 10, 2, "user-stop", 5, 20, "x"), (1, "b", 0.0, 0, 0, 0, None, None, 2, 3, "x"), (1, None, 1.0, 1, 5, 5, 0, "max steps", 1, 1, "x"), (1, "c", None, 9, 9, 9, 9, "late", 1, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.metric: r.value for r in rollout.step_metrics(df, ["step"], "g", local=F.col("infrastructure_retry_count") > 1).collect()}
    assert got["reward/success_count"] == 2 and got["reward/failure_count"] == 2 and got["reward/success_rate"] == 0.5 and got["rollout/valid_trajectories"] == 4
    assert got["grpo/group_count"] == 2 and got["grpo/mixed_group_ratio"] == 0.5 and got["grpo/local_signal_group_count"] == 1 and got["grpo/group_reward_mean"] == 0.25 and got["grpo/group_reward_mean_min"] == 0
    assert got["rollout/assistant_turns/p90"] == pytest.approx(3.4) and got["rollout/assistant_turns/max"] == 4 and got["infra/retry_attempt_count"] == 2 and got["rollout/assistant_token_fraction"] == pytest.approx(25 / 35)
    assert got["termination/user_stop_count"] == 2 and got["termination/max_steps_count"] == 1 and got["termination/none_count"] == 1 and "termination/late_count" not in got
    assert rollout.step_metrics(df.limit(0), ["step"], "g").count() == 0
    made = {(r.g, r.reward): r for r in rollout.summarize(df).collect()}
    assert made["b", 0.0].assistant_tokens_per_turn == 0 and made["a", 0.0].tool_response_tokens_per_call == 4 and made["a", 1.0].observation_tokens == 10
    table = rollout.trajectory_table(df, 7)
    assert table.columns == ["step", "reward", *rollout.TABLE] and table.first().slot_id is None and table.first().step == 7


def test_arrays_of_a_batch(spark):
    df = spark.createDataFrame([([1, 2], [0, 0], [True, False])], "s array<int>, r array<int>, v array<boolean>")
    assert [tuple(r) for r in rollout.zipped_info(df, 3, "s", "r", "v").collect()] == [(3, 1, 0, True), (3, 2, 0, False)]
    with pytest.raises(PySparkException):
        rollout.zipped_info(spark.createDataFrame([([1], [0, 0], [True])], df.schema), 3, "s", "r", "v").collect()
    m = spark.createDataFrame([([False, True, None, True], [0.5, None]), ([], None), ([True], [])], "m array<boolean>, x array<double>")
    got = m.select(rollout.predicting_positions(F.col("m")).alias("p"), rollout.sequence_score(F.col("x")).alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [([0, 2], 0.5), ([], 0.0), ([], 0.0)]
    back = spark.range(1).select(rollout.restored(F.array(F.lit(7), F.lit(8)), F.array(F.lit(2), F.lit(0)), F.lit(4), F.lit(-1)).alias("d")).first().d
    assert back == [8, -1, 7, -1]
    specs = rollout.policy_specs(spark.createDataFrame([("x", 96), ("x", 96), ("x", None), ("y", 8)], "l string, s int"), "l", "s")
    assert {(r.l, r.policy) for r in specs.collect()} == {("x", "step_096"), ("y", "step_008")}


@pytest.mark.parametrize("text", ["Hello wörld", "a\n\n  b", "日本語の文。🙂 end", "<|im_start|>user\nhi<|im_end|>\n", "", "́x"])
def test_tokens_cover_their_characters(text):
    ids, at = public_tokenizer(text)
    own = offset_tokenizer(tokenizer_path())
    assert own.decode(ids) == text and len(ids) == len(at) and all(0 <= a < b <= len(text) for a, b in at)
    assert all(b >= c for (_, b), (c, _) in zip(at, at[1:], strict=False)) and (not text or (at[0][0] == 0 and at[-1][1] == len(text)))


def test_round_trips_and_span_audits(spark):
    m = [message("system", "s"), message("user", "u"), message("assistant", None, [("c", "find", '{"a": 1}')]), message("tool", "ok", None, "c"), message("assistant", "fertig 🙂")]
    df = preprocess.render(spark.createDataFrame([("k", m), ("none", None)], f"k string, messages {MESSAGES}"))
    trips = {r.k: (r.tokens > 0, r.difference, r.reencodes) for r in preprocess.round_trip(df, "k", "rendered").collect()}
    assert trips == {"k": (True, None, True), "none": (False, None, True)}
    labels = preprocess.label(df, "k")
    audit = preprocess.span_audit(preprocess.token_rows(labels, "k"), df, "k").orderBy("ordinal").collect()
    assert [(r.kind, r.masked_leading) for r in audit] == [("tool_call", 0), ("text", 0)] and audit[1].target == "fertig 🙂<|im_end|>" and audit[1].header.startswith("--- assistant 01 | text | tokens [")
    starts = labels.filter("k = 'k'").select(preprocess.first_token_at(F.col("starts"), F.lit(0)).alias("a"), preprocess.first_token_at(F.col("starts"), F.lit(10_000)).alias("b")).first()
    assert (starts.a, starts.b) == (0, None)
    with pytest.raises(ValueError):
        preprocess.template_sha256(" ")


def test_a_broken_store_is_told(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", [10, 11, 12], [-100, 11, 12]), (1, "b", [20, 21], [-100, 21])], "i int, name string, input_ids array<int>, labels array<int>")
    out = str(tmp_path / "store")
    writers.write_flat_arrays(df, out, "i", keep=["name"])
    told = lambda **k: sorted(r.error for r in readers.store_errors(spark, out, **k).collect())
    assert told() == [] and files.read_json(f"{out}/stats.json")["supervised_tokens"] == 3
    manifest = files.read_json(f"{out}/manifest.json")
    writers.write_json(f"{out}/manifest.json", manifest | {"format_version": 9, "counts": {"trajectories": 3, "tokens": 5}})
    assert told() == ["trajectory count differs from the manifest", "unknown format"]
    writers.write_json(f"{out}/manifest.json", manifest | {"files": {k: "0" for k in manifest["files"]} | {"arrays/gone": "0"}})
    assert any(e.startswith("SHA-256 differs") for e in told()) and "file missing: arrays/gone" in told() and told(verify=False) == []
    spark.createDataFrame([(0, [10], [-100], 0, 1), (1, [20], [21], 5, 6)], "idx int, input_ids array<int>, labels array<int>, offset_start long, offset_end long").write.mode("overwrite").parquet(f"{out}/arrays")
    assert {"offset gap at row 1", "metadata differ at row 0", "metadata differ at row 1", "row 1: label is neither -100 nor input_id"} <= set(told(verify=False))
    files.remove(f"{out}/metadata")
    assert told() == ["missing: metadata"]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a.jsonl", 500), ("b.jsonl", 3)):
        (tmp_path / name).write_text("".join(json.dumps({"n": i}) + "\n" * (1 + (i % 7 == 0)) for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in readers.json_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(p.name, n, t) for p in tmp_path.glob("*.jsonl") for n, t in enumerate(p.read_text().split("\n"), 1) if t}
    assert got == want


def test_loose_rules_and_turns(spark):
    call = [("c", "f", "{}")]
    cases = [([message("user", "u"), message("assistant", "a")], None), ([message("bot", "u")], "unsupported role"), ([message("assistant", "a", call)], "neither or both of text and calls"), ([message("assistant", None, call)], "calls and results don't pair"), ([message("user", "u")], "no assistant"), ([message("assistant", None, call), message("tool", "", None, "c")], None), ([message(None, "x")], "unsupported role")]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], f"i int, messages {MESSAGES}")
    got = {r.i: r.e for r in df.select("i", curation.loose_error(F.col("messages")).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}
    turns = [(message("assistant", "a", call), "text and calls"), (message("user", None, call), "users call nothing"), (message("user", " "), "empty"), (message("tool", None), None), (message("assistant", None, call), None)]
    df = spark.createDataFrame([(i, [m]) for i, (m, _) in enumerate(turns)], f"i int, messages {MESSAGES}").select("i", F.get("messages", F.lit(0)).alias("m"))
    assert {r.i: r.e for r in df.select("i", curation.turn_error(F.col("m")).alias("e")).collect()} == {i: e for i, (_, e) in enumerate(turns)}
    assert {r.e for r in df.filter("i = 4").select(curation.turn_error(F.col("m"), F.lit("user")).alias("e")).collect()} == {"calls for another"}


def test_values_told_and_targets(spark):
    df = spark.createDataFrame([("k", '{"Total": "12.50", "ok": true, "note": " Two Words ", "l": [null, 12.5]}'), ("k", "plain Text"), ("n", None)], "key string, doc string")
    got = {(r.key, r.vtype, r.value) for r in facts.communicated_values(df, "key", "doc").collect()}
    assert got == {("k", "number", "12.5"), ("k", "bool", "true"), *[("k", "string", s) for s in ("total", "ok", "note", "two words", "two", "words", "l", "plain text", "plain", "text")]}
    fact = "key string, kind string, subject array<string>, value string"
    gold = spark.createDataFrame([("k", "order_status", ["o"], "open"), ("k", "product_item", ["p", "i"], None), ("k", "product_item", ["p", "j"], None), ("k", "calculation_result", ["1+1"], "2"), ("m", "calculation_result", ["1+1"], "2")], fact)
    refs = spark.createDataFrame([("k", "order", "o"), ("k", "product", "p"), ("k", "item", "i"), ("k", "communicate", "open"), ("k", "communicate", "seen"), ("k", "communicate", "unseen"), ("z", "communicate", "all")], "key string, ref_kind string, id string")
    told = spark.createDataFrame([("k", "seen"), ("k", "open")], "key string, value string")
    out = {(r.key, r.kind, tuple(r.subject), r.value) for r in facts.target_facts(gold, gold, refs, told, "key").collect()}
    assert out == {("k", "order_status", ("o",), "open"), ("k", "product_item", ("p", "i"), None), ("k", "calculation_result", ("1+1",), "2"), ("k", "communicate_value", (), "seen"), ("z", "communicate_value", (), "all")}
    actions = spark.createDataFrame([("k", "get_item_details", '{"item_id": "i"}'), ("k", "other", '{"item_id": "j"}')], "key string, name string, arguments string")
    assert [(r.ref_kind, r.id) for r in facts.references(actions, "key", "arguments", "name").collect()] == [("item", "i")]
    shown = facts.observed_facts(spark.createDataFrame([("k", "calculate", "12.0", '{"expression": "3*4"}'), ("k", "list_all_product_types", '{"Lamp": "77"}', None)], "key string, tool string, result string, args string"), "key", "tool", "result", "args")
    assert {(r.kind, tuple(r.subject), r.value) for r in shown.collect()} == {("calculation_result", ("3*4",), "12"), ("product_name", ("77",), "Lamp"), ("product_known", ("77",), None)}
    grown = facts.expand_references(refs, "key", spark.createDataFrame([("o", "u")], "order_id string, user_id string"), spark.createDataFrame([], "user_id string, payment_id string"))
    assert ("k", "user", "u") in {tuple(r) for r in grown.collect()}


def test_a_large_pool_is_chosen_from_pick_by_pick(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows = [(f"t{i:03d}", str(rng.choice([3, 10, 2, 7, 7, 7])) if i % 9 else f"x{i % 4}", rng.choice(["low", "medium", "high", ""]), rng.choice([0.5, 0.7, rng.random()]), rng.randrange(5), [rng.randrange(12) for _ in range(6)], [rng.randrange(3) for _ in range(4)]) for i in range(70)]
    df = spark.createDataFrame(rows, "trajectory_id string, task_id string, tier string, quality double, task_rank int, grams array<bigint>, trace array<bigint>")
    for target, least in ((16, 2), (3, 1)):
        want = sorted(map(tuple, curation.select_greedily(df, target, least).collect()), key=lambda r: r[4])
        monkeypatch.setattr(curation, "MOST_ELIGIBLE", 0)
        got = sorted(map(tuple, curation.select_greedily(df, target, least).collect()), key=lambda r: r[4])
        monkeypatch.undo()
        assert got == want and len(got) == target and len({r[0] for r in got}) == target
    assert curation.select_greedily(df.limit(0), 4, 1).count() == 0


def test_replays_signals_and_lines(spark):
    events = [("a", i, i in (2, 4, 5)) for i in range(8)] + [("b", i, None) for i in range(4)] + [("c", 0, True)]
    df = spark.createDataFrame(events, "k string, at int, bad boolean")
    got = {r.k: (r.ended_at, r.reason) for r in rollout.replayed_ends(df, "k", "at", "bad", 3, 4).collect()}
    assert got == {"a": (3, "max_steps"), "b": (3, "max_steps"), "c": (None, "running")}
    assert rollout.replayed_ends(df, "k", "at", "bad", 2, 5).filter("k = 'a'").first().reason == "too_many_errors"
    spans = spark.createDataFrame([([(0.0, 0.0, False)],), ([(0.0, 0.5, None)],), ([(None, None, True)],), ([],)], "s array<struct<progress:double,fact:double,error:boolean>>")
    assert [r.x for r in spans.select(rollout.has_local_signal(F.col("s")).alias("x")).collect()] == [False, True, True, False]
    metrics = spark.createDataFrame([("m", "reward/success_count", 3.0), ("m", "rollout/valid_trajectories", 8.0), ("m", "timing_s/gen", 173.04), ("m", "perf/mfu/actor", 0.42)], "k string, metric string, value double")
    line = rollout.step_lines(metrics, ["k"], 9).first()
    assert line.first_line == "[step 9] reward 3/8 | mixed 0/0 | rollout 173.0s | retries 0" and "MFU 42.0%" in line.second_line


def test_runtime_rows_and_missing_trials(spark):
    from logloom.operators import evaluation

    call = "struct<id:string,name:string,arguments:string>"
    kind = f"task_id string, duration double, reward double, agent_cost double, messages array<struct<role:string,error:boolean,tool_calls:array<{call}>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>"
    df = spark.createDataFrame([("1", 1.23456, 1.0, 0.5, [("assistant", None, [("i", "f", "{}")], (100, 7)), ("tool", True, None, None), ("user", None, None, (5, None)), ("assistant", None, None, (200, None))]), ("2", None, None, None, None)], kind)
    first, second = sorted(evaluation.runtime_rows(df).collect(), key=lambda r: r.task_id)
    assert (first.duration_seconds, first.env_reward, first.agent_cost, first.assistant_messages, first.tool_calls, first.tool_errors) == (1.235, 1.0, 0.5, 2, 1, 1)
    assert (first.agent_input_tokens, first.agent_output_tokens, first.user_input_tokens, first.user_output_tokens) == (300, 7, 5, 0) and second.tool_messages == 0 and second.duration_seconds is None
    turns = df.select(*[c.alias(n) for n, c in curation.assistant_tokens(F.col("messages")).items()]).collect()
    assert [tuple(r) for r in turns] == [(2, 7, 200), (0, 0, 0)]
    trials = spark.createDataFrame([("x", "1", 0), ("x", "1", 2), ("y", "1", 0), ("y", "1", 1), ("y", "1", 2), ("z", "9", 0), ("x", None, 0)], "m string, task_id string, trial int")
    assert {tuple(r) for r in evaluation.missing_trials(trials, "m", ["x", "y"], 3).collect()} == {("x", "1", "1")}
    ratios = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], [])], "a array<bigint>, b array<bigint>").select(curation.match_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in ratios] == [0.8, 1.0]
    lengths = spark.createDataFrame([(600,), (5000,), (None,)], "n int").select(datasets.training_length(F.col("n"), 512, 4096).alias("l")).collect()
    assert [r.l for r in lengths] == [1024, None, None]
