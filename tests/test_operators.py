import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.operators import credit as cr
from logloom.operators import curation as cu
from logloom.operators import datasets as ds
from logloom.operators import evaluation as ev
from logloom.operators import ordering
from logloom.operators import preprocess as pp
from tests.conftest import MESSAGES, message


def rewards(spark, rows):
    return spark.createDataFrame(rows, "task string, reward double")


def test_task_rewards(spark):
    got = {r.task: r for r in ev.task_rewards(rewards(spark, [("a", 1.0)] * 2 + [("a", 0.0)] * 2 + [("b", 1.0)] * 4 + [("c", None), ("d", 0.0)]), ["task"]).collect()}
    assert (got["a"].pass_1, got["a"].pass_2, got["a"].pass_3, got["a"].reward_variance, got["a"].group_type) == (0.5, 0.166667, 0.0, 0.25, "mixed")
    assert (got["b"].pass_4, got["b"].zero_variance, got["b"].group_type) == (1.0, True, "all_success")
    assert "c" not in got and got["d"].pass_2 is None
    assert ev.task_rewards(rewards(spark, []), ["task"]).count() == 0


def test_advantages_of_one_run_are_zero(spark):
    got = {r.reward: r.advantage for r in ev.relative_advantages(rewards(spark, [("a", 1.0), ("a", 0.0)]), ["task"]).collect()}
    assert got[1.0] == pytest.approx(0.7071, abs=1e-4) and got[0.0] == -got[1.0]
    assert ev.relative_advantages(rewards(spark, [("x", 0.3)]), ["task"]).first().advantage == 0.0


def test_transitions_and_priority(spark):
    runs = [(m, "1", t, f"{m}{t}", r) for m, rs in (("a", (1, 1, 0, 1)), ("b", (0, 0, 1, 1))) for t, r in enumerate(rs)]
    df = spark.createDataFrame([(m, k, t, i, float(r)) for m, k, t, i, r in runs], "model_label string, task_id string, trial int, trajectory_id string, reward double")
    row = ev.task_transitions(ev.comparisons(ev.paired_trials(df, ["a", "b"]), ["a", "b"])).first()
    assert (row.delta, row.change, row.priority, row.improved_trials, row.regressed_trials) == (-1, "regressed", "P1", "2", "0,1")


def test_call_features_count_deliveries_once(spark):
    call = "trajectory_id string, call_id string, message_index int, call_pos int, name string, family string, arguments string, error boolean, ingested_at int"
    rows = [("t", "1", 0, 0, "f", "read", '{"a":1,"b":2}', True, 1), ("t", "1", 0, 0, "f", "read", '{"a":1,"b":2}', True, 9), ("t", "2", 2, 0, "f", "read", '{"b":2, "a":1}', None, 1), ("t", "3", 4, 0, "g", "write", None, True, 1), ("t", "4", 6, 0, "f", "read", '{"a":1,"b":2}', False, 1)]
    r = ev.call_features(spark.createDataFrame(rows, call)).first()
    assert (r.total_calls, r.tool_errors, r.read_errors, r.write_errors, r.exact_repeated_calls, r.consecutive_exact_retries) == (4, 2, 1, 1, 2, 1)


def candidates(spark, rows):
    return spark.createDataFrame(rows, f"trajectory_id string, tier string, trial int, outcome struct<reward:double,db_match:boolean,termination_reason:string>, stats struct<assistant_turns:int,tool_call_count:int,tool_error_count:int>, messages {MESSAGES}")


def test_screening_rules(spark):
    good = [message("user", "hi"), message("assistant", "ok")]
    bad_call = [message("assistant", "text", [("1", "", "{}"), ("2", "f", "[]")])]
    rows = [("a", "low", 0, (1.0, None, "user_stop"), (1, 0, 0), good), ("b", "low", 0, (0.0, False, "max_steps"), (21, 16, 1), None), ("c", None, None, (None, True, None), (None, None, None), bad_call)]
    got = {r.trajectory_id: r for r in cu.screen(candidates(spark, rows)).collect()}
    assert got["a"].hard_pass and got["a"].review_flags == []
    assert got["b"].hard_reasons == ["abnormal_termination", "db_mismatch", "missing_messages", "reward_zero"]
    assert got["b"].review_flags == ["long_trajectory", "many_tool_calls", "tool_error_needs_review"]
    assert got["c"].hard_reasons == ["abnormal_termination", "malformed_tool_call", "missing_assistant_turn", "reward_zero"] and got["c"].review_flags == ["parallel_tool_calls", "text_with_tool_call"]


def test_judge_decisions(spark):
    cases = [(0.7, True, True, False, False, "needs_human_review"), (0.9, True, True, None, False, "accepted"), (0.9, True, True, None, True, "rejected"), (0.9, False, True, True, True, "rejected"), (None, True, True, True, True, None), (float("nan"), True, True, True, True, None)]
    df = spark.createDataFrame([c[:5] for c in cases], "c double, a boolean, b boolean, r boolean, h boolean")
    got = [r[0] for r in df.select(cu.judge_decision(F.col("c"), [F.col("a"), F.col("b")], F.col("r"), F.col("h"))).collect()]
    assert got == [c[5] for c in cases]


def test_training_messages_and_their_errors(spark):
    talk = [message("assistant", "Hi!"), message("user", "q"), message("assistant", None, [("1", "f", "{}")]), message("tool", "r", answers="1"), message("assistant", "done"), message("user", "bye"), message("user", "bye")]
    made = cu.training_messages(spark.createDataFrame([("a", talk), ("b", []), ("c", None), ("d", [message("user", "only")])], f"k string, messages {MESSAGES}"), ["Hi!"], "S")
    got = {r.k: [m.role for m in r.messages] for r in made.collect()}
    assert got == {"a": ["system", "user", "assistant", "tool", "assistant"], "d": ["system"]}
    errors = {r.k: r.e for r in made.select("k", cu.conversation_errors(F.col("messages")).alias("e")).collect()}
    assert errors["a"] == [] and errors["d"] == ["bad_end", "too_short"]


def test_recoveries(spark):
    def talk(*rest):
        return [message("assistant", None, [("1", "f", '{"a":1}')]), message("tool", "x", answers="1", error=True), *rest]

    rows = [("retry", talk(message("assistant", None, [("2", "f", '{ "a": 1 }')]))), ("other", talk(message("assistant", None, [("2", "g", "{}")]))), ("fixed", talk(message("assistant", None, [("2", "f", "{}")]))), ("ask", talk(message("user", "?"), message("assistant", None, [("2", "f", "{}")]))), ("none", talk()), ("lost", [message("assistant", None, [("9", "f", "{}")])])]
    got = {r.k: r.recovery for r in cu.recoveries(spark.createDataFrame(rows, f"k string, messages {MESSAGES}"), "k").filter("ord = 0").collect()}
    assert got == {"retry": "exact_retry", "other": "alternate_tool", "fixed": "corrected_retry", "ask": "ask_user", "none": "abandon", "lost": "missing_response"}


def test_greedy_selection_prefers_what_is_new_and_breaks_ties_by_the_larger_id(spark):
    rows = [("a", "1", "low", 0.9, 1, ["x y z"], [1]), ("b", "1", "low", 0.9, 1, ["x y z"], [1]), ("c", "1", "low", 0.85, 2, ["p q r"], [2]), ("d", "2", "high", 0.5, 1, ["m"], [])]
    got = cu.select_greedily(spark.createDataFrame(rows, "trajectory_id string, task_id string, tier string, quality double, task_rank int, grams array<string>, trace array<int>"), 3, 1).orderBy("selected_index").collect()
    assert [(r.trajectory_id, r.phase) for r in got] == [("b", "task_coverage"), ("d", "task_coverage"), ("c", "global_diversity")]


def test_numeric_summary(spark):
    r = ds.numeric_summary(spark.createDataFrame([("k", i) for i in (1, 2, 3, 4, 5)] + [("k", None)], "k string, v int"), ["k"], "v").first()
    assert (r.least, r.most, r["mean"], r.median, r.p90) == (1, 5, 3.0, 3.0, 4.6)


def test_running_sums_and_places_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaab"), rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r.id: (r.s, r.position) for r in ordering.group_positions(ordering.group_running_sum(df, F.col("g"), [F.col("id").asc()], F.col("v"), "s", piece=7), F.col("g"), [F.col("id").asc()]).collect()}
    total, place = Counter(), Counter()
    for i, g, v in rows:
        total[g] += v or 0
        place[g] += 1
        assert got[i] == (total[g], place[g])
    assert ordering.group_positions(df.limit(0), None, [F.col("id").asc()]).count() == 0


def test_batches(spark):
    def batches(lengths, batch, bucket, **how):
        df = spark.createDataFrame(list(enumerate(lengths)), "idx int, n int")
        out = {}
        for r in ds.length_batches(df, "idx", "n", batch, bucket, **how).collect():
            out.setdefault(r.batch_id, []).append(r.idx)
        return [sorted(out[k]) for k in sorted(out)]

    assert batches([30, 10, 20, 40], 2, 4) == [[1, 2], [0, 3]]
    assert batches([1, 2, 3, 4, 5], 2, 3, drop_last=True) == [[0, 1], [2, 3]]
    lengths = [103, 10, 101, 12, 100, 11, 102, 13]
    got = batches(lengths, 2, 4, seed=3)
    assert sorted(sum(got, [])) == list(range(8)) and all(max(lengths[i] for i in b) - min(lengths[i] for i in b) <= 3 for b in got)


@pytest.mark.parametrize("ids,labels,ends,error", [([[10, 11, 12], [20, 21]], [[-100, 11, 12], [-100, 21]], [3, 5], None), ([[10, 11]], [[-100, 99]], [2], "label is neither -100 nor input_id"), ([[10], [11]], [[10], [11]], [0, 2], "offsets must be strictly increasing"), ([[5]], [[-100]], [1], "nothing is supervised")])
def test_flat_arrays(spark, ids, labels, ends, error):
    starts = [0, *ends[:-1]]
    df = spark.createDataFrame(list(zip(range(len(ids)), ids, labels, starts, ends, strict=True)), "i int, ids array<int>, labels array<int>, s int, e int")
    found = [e for r in ds.flat_array_errors(df, "i", "ids", "labels", "s", "e").collect() for e in r.errors]
    assert found == [] if error is None else error in found


def test_padding(spark):
    a, b, m = ds.pad(F.array(F.lit(1), F.lit(2)), F.array(F.lit(-100), F.lit(2)), F.lit(4), 0)
    assert tuple(spark.range(1).select(a, b, m).first()) == ([1, 2, 0, 0], [-100, 2, -100, -100], [1, 1, 0, 0])
    with pytest.raises(Exception, match="longer than"):
        spark.range(1).select(ds.pad(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)), F.col("id") + 1, 0)[0]).collect()


def test_schedule():
    assert ds.schedule(256, 2, 8, 3, 0.03) == {"steps_per_epoch": 16, "total_steps": 48, "warmup_steps": 2}


def test_progress_is_never_given_twice(spark):
    df = spark.createDataFrame([("t", i, p) for i, p in enumerate((0.5, 0.2, 0.5, 0.75))], "k string, i int, p double")
    got = [r.new_progress for r in cr.new_progress(df, "k", ["i"], "p", 0.25).orderBy("i").collect()]
    assert got == [0.25, 0.0, 0.0, 0.25]
    facts = spark.createDataFrame([("t", "1", 0, "a"), ("t", "1", 2, "a"), ("t", "1", 2, "b"), ("t", "1", 3, "x")], "k string, task_id string, turn int, fact string")
    targets = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "c"), ("1", "d")], "task_id string, fact string")
    assert sorted((r.turn, r.new_fact_progress) for r in cr.fact_progress(facts, targets, "k", "turn").collect()) == [(0, 0.25), (2, 0.25)]


def test_potential_advantage(spark):
    rows = [(0.0, 0.5, 0.5, False), (0.0, 0.0, 0.0, True), (-0.5, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "o double, p double, f double, e boolean")
    got = [r[0] for r in df.select(cr.potential_advantage(F.col("o"), F.col("p"), F.col("f"), F.col("e"), 0.4, 0.1, 0.3)).collect()]
    assert got == pytest.approx([0.25, -0.3, -0.5])
    assert [r[0] for r in df.select(cr.potential_advantage(F.col("o"), F.col("p"), F.col("f"), F.col("e"), 0.0, 0.0, 0.0)).collect()] == [0.0, 0.0, -0.5]


def test_anchored_advantage_keeps_the_token_mean_and_caps_short_turns(spark):
    spans = "k string, i int, tokens int, progress double, fact double, error boolean, outcome double, reward double"
    got = cr.anchored_advantages(spark.createDataFrame([("t", 0, 1, 0.1, 0.0, False, 0.5, 1.0), ("t", 1, 19, 0.0, 0.0, False, 0.5, 1.0), ("f", 0, 3, 0.5, 0.0, False, -0.5, 0.0)], spans), "k").orderBy("k", "i").collect()
    q = 0.8 * 0.1 * 4
    assert got[0].advantage == -0.5 and got[1].q == pytest.approx(q) and got[1].advantage == pytest.approx(0.5 * (1 + 0.4 * (q - q / 20)))
    assert (got[1].advantage + 19 * got[2].advantage) / 20 == pytest.approx(0.5)
    bad = spark.createDataFrame([("a", 0, 2, 5), ("a", 3, 5, 5), ("b", 0, 5, 5)], "k string, s int, e int, n int")
    assert [r.k for r in cr.span_errors(bad, "k", "s", "e", "n").collect()] == ["a"]


def test_labels_cover_assistant_targets_only(spark):
    talk = [message("system", "S"), message("user", "q"), message("assistant", None, [("1", "f", "{}")]), message("tool", "r", answers="1"), message("assistant", "all done")]
    rendered = pp.render(spark.createDataFrame([("a", talk), ("b", None)], f"k string, messages {MESSAGES}")).cache()
    row = rendered.filter("k = 'a'").first()
    assert [row.rendered[s.content_start : s.target_end] for s in row.spans] == ['<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call><|im_end|>', "all done<|im_end|>"]
    assert rendered.filter("k = 'a'").select(pp.rendering_errors(F.col("rendered"), F.col("spans"))).first()[0] == []
    labelled = pp.label(rendered, "k").cache()
    tokens = pp.regions(pp.token_rows(labelled, "k"), rendered, "k")
    assert {(r.region, r.loss) for r in tokens.select("region", "loss").distinct().collect()} == {("external_context", "no"), ("assistant_header", "no"), ("assistant_tool_call", "yes"), ("assistant_text", "yes"), ("assistant_end", "yes")}
    assert labelled.filter("k = 'b'").first().input_ids == []


def test_completion_kinds(spark):
    texts = {"hello": "text", "": "empty", None: "empty", '<tool_call>{"name": "f", "arguments": {}}</tool_call>': "tool_call", '<tool_call>{"name": "f", "arguments": 3}</tool_call>': "bad arguments", "x <tool_call>{}</tool_call>": "mixed", "<tool_call>{": "left-over tag"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in df.select("t", pp.completion_kind(F.col("t")).alias("k")).collect()} == texts
