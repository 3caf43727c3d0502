import copy
import json

import pytest

from logloom.operators.rows import training_json, with_row_errors
from tests.conftest import MESSAGES, message

CALL = {"id": "c1", "type": "function", "function": {"name": "find", "arguments": {"a": 1}}}
GOOD = {
    "trajectory_id": "t1", "task_id": "1", "metadata": {}, "tools": [{"type": "function", "function": {"name": "find", "description": None, "parameters": {}}}],
    "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": None, "tool_calls": [CALL]}, {"role": "tool", "content": "", "tool_call_id": "c1"}, {"role": "assistant", "content": "done"}],
}


def changed(*path_and_value):
    *path, last, value = path_and_value
    row = copy.deepcopy(GOOD)
    at = row
    for k in path:
        at = at[k]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return json.dumps(row)


M, T = "messages", "tools"
CASES = [
    (json.dumps(GOOD), None), (None, ("", "not an object")), ("", ("", "not an object")), ("[1]", ("", "not an object")), ('{"a": NaN}', ("", "not an object")), (json.dumps(GOOD)[:-1], ("", "not an object")),
    (changed("tools", ...), ("", "missing keys: tools")), (changed("extra", 1), ("", "unexpected keys: extra")), (changed("trajectory_id", " "), ("trajectory_id", "empty")), (changed("task_id", 7), ("task_id", "empty")), (changed(M, {}), (M, "not a list")), (changed(T, []), (T, "empty")), (changed("metadata", []), ("metadata", "not an object")),
    (changed(M, 1, "x"), ("messages[1]", "not an object")), (changed(M, 1, "role", "bot"), ("messages[1].role", "unsupported")), (changed(M, 1, "role", ...), ("messages[1].role", "empty")), (changed(M, 1, "content", " "), ("messages[1].content", "empty")), (changed(M, 1, "x", 1), ("messages[1]", "unexpected keys: x")), (changed(M, 4, "content", ...), ("messages[4]", "missing keys: content")),
    (changed(M, 4, "content", 3), ("messages[4].content", "neither text nor null")), (changed(M, 2, "tool_calls", {}), ("messages[2].tool_calls", "not a list")), (changed(M, 2, "content", "x"), ("messages[2]", "neither or both of text and calls")), (changed(M, 2, "tool_calls", None), ("messages[2]", "neither or both of text and calls")), (changed(M, 2, "tool_calls", [CALL, CALL]), ("messages[2]", "more than one call")),
    (changed(M, 2, "tool_calls", 0, "id", ""), ("messages[2].tool_calls[0].id", "empty")), (changed(M, 2, "tool_calls", 0, "type", "x"), ("messages[2].tool_calls[0].type", "not a function")), (changed(M, 2, "tool_calls", 0, "function", "x"), ("messages[2].tool_calls[0].function", "not an object")), (changed(M, 2, "tool_calls", 0, "function", "more", 1), ("messages[2].tool_calls[0].function", "unexpected keys: more")),
    (changed(M, 2, "tool_calls", 0, "function", "arguments", "{}"), ("messages[2].tool_calls[0].function.arguments", "not an object")), (changed(M, 2, "tool_calls", 0, "function", "name", None), ("messages[2].tool_calls[0].function.name", "empty")), (changed(M, 3, "content", None), ("messages[3].content", "no text")), (changed(M, 3, "tool_call_id", ""), ("messages[3].tool_call_id", "empty")),
    (changed(T, 0, "type", "x"), ("tools[0].type", "not a function")), (changed(T, 0, "function", "strict", True), None), (changed(T, 0, "function", "x", 1), ("tools[0].function", "unexpected keys: x")), (changed(T, 0, "function", "parameters", []), ("tools[0].function.parameters", "not an object")), (changed(T, 0, "function", "description", 3), ("tools[0].function.description", "neither text nor null")),
    (changed(T, GOOD[T] * 2), (T, "repeated names: find")), (changed(T, 0, "function", "name", "other"), ("messages[2].tool_calls[0].function.name", "unknown tool")), (changed(M, GOOD[M][:2]), (M, "fewer than three")), (changed(M, GOOD[M][1:]), ("messages[0]", "no system message")), (changed(M, [GOOD[M][0], *GOOD[M][2:]]), ("messages[1]", "no user message")), (changed(M, GOOD[M][:4]), ("messages[3]", "no text at the end")),
    (changed(M, [*GOOD[M][:4], GOOD[M][0], GOOD[M][4]]), (M, "system message inside")), (changed(M, 3, "tool_call_id", "c2"), ("messages[3].tool_call_id", "answers another call")), (changed(M, [*GOOD[M][:3], GOOD[M][4]]), ("messages[2]", "call without a result")), (changed(M, [*GOOD[M][:2], *GOOD[M][3:]]), ("messages[2]", "result without a call")),
    (changed(M, [*GOOD[M][:4], *GOOD[M][2:]]), (M, "repeated call ids: c1")), (changed(M, [*GOOD[M][:2], GOOD[M][1], *GOOD[M][2:]]), ("messages[2]", "after user: user")),
]


def test_first_errors(spark):
    df = spark.createDataFrame([(i, body, "clash") for i, (body, _) in enumerate(CASES)], "i int, row string, e string")
    got = {r.i: tuple(r.errors[0]) if r.errors else None for r in with_row_errors(df, "row").collect()}
    for i, (body, want) in enumerate(CASES):
        assert got[i] == want, body
    assert with_row_errors(df.limit(0), "row").count() == 0


def test_training_rows_read_back(spark):
    m = [message("system", "s\"\n"), message("user", "ü"), message("assistant", None, [("c1", "find", '{"a": 1}')]), message("tool", "", None, "c1"), message("assistant", "done")]
    df = spark.createDataFrame([("t1", "1", m, "low"), ("t2", None, None, None)], f"trajectory_id string, task_id string, messages {MESSAGES}, tier string")
    made = training_json(df, json.dumps(GOOD["tools"]), ["tier"])
    got = {r.trajectory_id: (json.loads(r.row), [tuple(e) for e in r.errors]) for r in with_row_errors(made, "row").collect()}
    row, errors = got["t1"]
    assert errors == [] and row["messages"][2] == {"role": "assistant", "content": None, "tool_calls": [CALL]} and row["messages"][0]["content"] == "s\"\n" and row["metadata"] == {"tier": "low"}
    assert got["t2"][1] == [("task_id", "empty")]


@pytest.mark.parametrize("body", ['{"trajectory_id": 1}', "{" * 2000, '"x"', "nul"])
def test_no_text_crashes(spark, body):
    assert with_row_errors(spark.createDataFrame([(body,)], "row string"), "row").first().errors
