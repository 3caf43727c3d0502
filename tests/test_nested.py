import json

from logloom.operators import nested

BODY = {
    "id": "t1", "task_id": 7, "tier": "low",
    "reward_info": {"reward": "1", "reward_breakdown": json.dumps({"DB": {"match": True, "x": None}, "L": [1, {"a": "b"}], "E": []})},
    "messages": [
        {"role": "user", "content": "hi", "extra": 1},
        {"role": "assistant", "tool_calls": {"id": "c1", "function": {"name": "f", "arguments": '{"b": 1}'}}},
        {"role": "assistant", "tool_calls": [{"id": "c2", "name": "g", "arguments": {}}, None]},
        {"role": "tool", "id": "c2", "content": "ok"}, {"role": "tool", "tool_call_id": "c2", "content": "again"}, {"role": "user", "tool_calls": None}, "odd",
    ],
}


def flat(spark, bodies):
    return nested.flatten_records(spark.createDataFrame([(i, b, "clash") for i, b in enumerate(bodies)], "record_id bigint, body string, path string"))


def test_tables_and_links(spark):
    tables = nested.tables(flat(spark, [json.dumps(BODY), json.dumps(BODY | {"messages": json.dumps(BODY["messages"])})]).cache())
    calls = {(r.record_key, r.message_pos, r.id, r.name, r.arguments, r.answer_pos, r.parent, r.subtype) for r in tables["call"].collect()}
    for k in "01":
        assert (k, 1, "c1", "f", '{"b": 1}', -1, "$.messages[1]", "function") in calls and (k, 2, "c2", "g", "{}", 3, "$.messages[2]", "plain") in calls
    assert len(calls) == 4
    assert {(r.item, r.value) for r in tables["reward"].collect()} == {("DB.match", "true"), ("L.0", "1"), ("L.1.a", "b")}
    assert tables["message"].count() == 12
    row = tables["candidate"].first()
    assert (row.trajectory_id, row.task_id, row.reward, row.subtype) == ("t1", "7", 1.0, "reward_info")
    parents = {(r.record_key, r.path) for r in tables["message"].collect()}
    assert all((c.record_key, c.parent) in parents for c in tables["call"].collect())


def test_incomplete_bodies_give_only_rejects(spark):
    rows = flat(spark, [None, "", '{"a": [', "[1]", "3", "{" * 5000]).collect()
    assert {r.entity for r in rows} == {"reject"} and len(rows) == 6


def test_missing_null_and_empty_parts(spark):
    bodies = ["{}", '{"messages": null, "outcome": null}', '{"messages": [], "outcome": {"reward_breakdown": {}}}', '{"trajectory_id": "x", "messages": [{"role": "user", "tool_calls": []}]}']
    rows = flat(spark, bodies).collect()
    assert [r.entity for r in rows].count("candidate") == 4 and [r.entity for r in rows].count("message") == 1 and len(rows) == 5


def test_empty_table_and_long_text(spark):
    assert flat(spark, [json.dumps({"messages": [{"role": "user", "content": "x" * 1_000_000}]})]).filter("length(content) = 1000000").count() == 1
    assert nested.flatten_records(spark.createDataFrame([], "record_id bigint, body string")).count() == 0


def test_shapes_tell_variants_apart(spark):
    assert nested.shape({"role": "user", "content": "x"}) == "message(content: text, role: text)"
    assert nested.shape('{"a": 1}') == "boxed map(a: number)" and nested.shape([1, None]) == "list of nil|number"
    assert nested.shapes(flat(spark, [json.dumps(BODY)])).filter("entity = 'call'").count() == 2


def test_states_route_objects_wherever_they_stand(spark):
    call = {"id": "c1", "name": "f", "arguments": {"order": {"role": "user", "content": "no message", "tool_calls": []}, "reward_breakdown": {"no": 1}}}
    body = {
        "trajectory_id": "t", "outcome": {"details": {"reward_breakdown": {"D": 1}}}, "pending": [{"id": "c9", "function": {"name": "h", "arguments": "{}"}}],
        "episode": json.dumps({"talk": [{"role": "assistant", "content": None, "parts": {"deep": [call]}, "reward_breakdown": {"turn": True}}, {"role": "tool", "tool_call_id": "c1", "content": json.dumps([call])}]}),
        "audit": {"expected_actions": [{"action_id": "a", "name": "f", "arguments": {}}], "tools": [{"type": "function", "function": {"name": "f", "parameters": {}}}], "messages": 12},
    }
    tables = nested.tables(flat(spark, [json.dumps(body), json.dumps({"batch": [{"trajectory_id": "u", "messages": [{"role": "user", "content": "x"}]}]})]).cache())
    assert {(r.id, r.path, r.parent, r.message_pos, r.answer_pos) for r in tables["call"].collect()} == {("c9", "$.pending[0]", "$", -1, -1), ("c1", "$.episode.talk[0].parts.deep[0]", "$.episode.talk[0]", 0, 1)}
    assert {(r.trajectory_id, r.path, r.parent) for r in tables["message"].collect()} == {("t", "$.episode.talk[0]", "$"), ("t", "$.episode.talk[1]", "$"), ("u", "$.batch[0].messages[0]", "$.batch[0]")}
    assert {(r.item, r.parent) for r in tables["reward"].collect()} == {("D", "$"), ("turn", "$.episode.talk[0]")}
    assert {(r.trajectory_id, r.path) for r in tables["candidate"].collect()} == {("t", "$"), ("u", "$.batch[0]")}


def test_shapes_differ_at_any_depth():
    deep = lambda x: nested.parse_record("k", json.dumps({"messages": [{"role": "user", "content": "x", "a": {"b": {"c": {"d": x}}}}]}))[1]["shape"]
    assert deep(1) != deep("1") and deep(1) == deep(2)
    assert nested.parse_record("k", json.dumps({"id": "x", "a": json.loads("[" * 900 + "]" * 900)}))[0]["trajectory_id"] == "x"
