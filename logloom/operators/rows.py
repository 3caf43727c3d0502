"""Training rows as JSON, and their strict validation: every error with its place, in reading order.

Documents are read as VARIANT and taken apart by built-in expressions, a fixed
number of levels deep, so nothing leaves the JVM.  ``errors[0]`` is what a
reader that stops at the first error would report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import bound

# The keys that a row and its parts must have and may have.
ROW, TOOL, FUNCTION, CALL, CALLED = ["trajectory_id", "task_id", "messages", "tools", "metadata"], ["type", "function"], ["name", "parameters"], ["id", "type", "function"], ["name", "arguments"]
ROLES = ["system", "user", "assistant", "tool"]
ERROR = "array<struct<location:string,error:string>>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _at(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _one(at: Column, error: Column | str) -> Column:
    return F.array(F.struct(at.alias("location"), (error if isinstance(error, Column) else F.lit(error)).alias("error")))


def _none() -> Column:
    return F.array().cast(ERROR)


def _first(*cases: tuple[Column, Column]) -> Column:
    """The errors of the first case that holds."""
    out = None
    for test, errors in cases:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, errors) if out is None else out.when(test, errors)
    assert out is not None
    return out.otherwise(_none())


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _keys(keys: Column, required: Sequence[str], optional: Sequence[str], at: Column) -> list[tuple[Column, Column]]:
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), keys))
    more = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in [*required, *optional]])))
    return [(F.size(missing) > 0, _one(at, F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))), (F.size(more) > 0, _one(at, F.concat(F.lit("unexpected keys: "), F.array_join(more, ", "))))]


def _read_call(o: Column) -> Column:
    f = _object(_at(o, "function"))
    return F.struct(
        o.isNotNull().alias("ok"), F.map_keys(o).alias("keys"), _text(_at(o, "id")).alias("id"), _text(_at(o, "type")).alias("type"), F.map_keys(f).alias("fkeys"), _text(_at(f, "name")).alias("name"), (_kind(_at(f, "arguments")) == "OBJECT").alias("args")
    )


def _read_message(o: Column) -> Column:
    calls = _at(o, "tool_calls")
    return F.struct(
        o.isNotNull().alias("ok"), F.map_keys(o).alias("keys"), _text(_at(o, "role")).alias("role"), _kind(_at(o, "content")).alias("ckind"), _text(_at(o, "content")).alias("content"), _text(_at(o, "tool_call_id")).alias("answers"),
        (calls.isNull() | (_kind(calls) == "VOID") | (_kind(calls) == "ARRAY")).alias("listed"), F.transform(F.transform(F.coalesce(_array(calls), F.array().cast("array<variant>")), _object), _read_call).alias("calls"),
    )


def _read_tool(o: Column) -> Column:
    f = _object(_at(o, "function"))
    return F.struct(o.isNotNull().alias("ok"), F.map_keys(o).alias("keys"), _text(_at(o, "type")).alias("type"), F.map_keys(f).alias("fkeys"), _text(_at(f, "name")).alias("name"), _kind(_at(f, "description")).alias("dkind"), (_kind(_at(f, "parameters")) == "OBJECT").alias("parameters"))


def _call_errors(c: Column, at: Column) -> Column:
    inside = lambda name: F.concat(at, F.lit(name))
    return _first(
        (~c["ok"], _one(at, "not an object")), *_keys(c["keys"], CALL, [], at), (_blank(c["id"]), _one(inside(".id"), "empty")), (_blank(c["type"]), _one(inside(".type"), "empty")), (c["type"] != "function", _one(inside(".type"), "not a function")),
        (c["fkeys"].isNull(), _one(inside(".function"), "not an object")), *_keys(c["fkeys"], CALLED, [], inside(".function")), (_blank(c["name"]), _one(inside(".function.name"), "empty")), (~F.coalesce(c["args"], F.lit(False)), _one(inside(".function.arguments"), "not an object")),
    )


def _message_errors(m: Column, i: Column) -> Column:
    at = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
    inside = lambda name: F.concat(at, F.lit(name))
    plain = _first(*_keys(m["keys"], ["role", "content"], [], at), (_blank(m["content"]), _one(inside(".content"), "empty")))
    calls = F.flatten(F.transform(m["calls"], lambda c, j: _call_errors(c, F.concat(at, F.lit(".tool_calls["), j.cast("string"), F.lit("]")))))
    assistant = _first(
        *_keys(m["keys"], ["role", "content"], ["tool_calls"], at), (~m["ckind"].isin("STRING", "VOID"), _one(inside(".content"), "neither text nor null")), (~m["listed"], _one(inside(".tool_calls"), "not a list")),
        (F.size(calls) > 0, calls), (_blank(m["content"]) == (F.size(m["calls"]) == 0), _one(at, "neither or both of text and calls")), (F.size(m["calls"]) > 1, _one(at, "more than one call")),
    )
    tool = _first(*_keys(m["keys"], ["role", "content", "tool_call_id"], [], at), (m["content"].isNull(), _one(inside(".content"), "no text")), (_blank(m["answers"]), _one(inside(".tool_call_id"), "empty")))
    return _first((~m["ok"], _one(at, "not an object")), (_blank(m["role"]), _one(inside(".role"), "empty")), (~m["role"].isin(ROLES), _one(inside(".role"), "unsupported")), (m["role"].isin("system", "user"), plain), (m["role"] == "assistant", assistant), (F.lit(True), tool))


def _tool_errors(t: Column, i: Column) -> Column:
    at = F.concat(F.lit("tools["), i.cast("string"), F.lit("]"))
    inside = lambda name: F.concat(at, F.lit(name))
    return _first(
        (~t["ok"], _one(at, "not an object")), *_keys(t["keys"], TOOL, [], at), (_blank(t["type"]), _one(inside(".type"), "empty")), (t["type"] != "function", _one(inside(".type"), "not a function")), (t["fkeys"].isNull(), _one(inside(".function"), "not an object")),
        *_keys(t["fkeys"], FUNCTION, ["description", "strict"], inside(".function")), (_blank(t["name"]), _one(inside(".function.name"), "empty")), (~F.coalesce(t["dkind"], F.lit("VOID")).isin("STRING", "VOID"), _one(inside(".function.description"), "neither text nor null")),
        (~F.coalesce(t["parameters"], F.lit(False)), _one(inside(".function.parameters"), "not an object")),
    )


def _repeated(names: Column) -> Column:
    return F.array_sort(F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda x: x == n)) > 1))


def _conversation_errors(m: Column, tools: Column) -> Column:
    """Of well-formed messages: ends, calls and their results, repeated names and ids, the order of roles."""
    every = F.lit("messages")
    at = lambda i, more="": F.concat(F.lit("messages["), i.cast("string"), F.lit("]" + more))
    called = lambda x: F.size(x["calls"]) > 0
    last = F.element_at(m, -1)

    def place(x: Column, i: Column) -> Column:
        call, after, before = F.get(x["calls"], F.lit(0)), F.get(m, i + 1), F.get(m, i - 1)
        own = _first((~F.array_contains(tools, call["name"]), _one(at(i, ".tool_calls[0].function.name"), "unknown tool")), (~F.coalesce(after["role"] == "tool", F.lit(False)), _one(at(i), "call without a result")), (after["answers"] != call["id"], _one(at(i + 1, ".tool_call_id"), "answers another call")))
        return F.when(called(x), own).when((x["role"] == "tool") & ((i == 0) | ~F.coalesce(called(before), F.lit(False))), _one(at(i), "result without a call")).otherwise(_none())

    def turn(x: Column, i: Column) -> Column:
        after = F.get(m, i + 1)["role"]
        want = F.when(x["role"] == "system", "user").when(x["role"].isin("user", "tool"), "assistant").when(called(x), "tool").otherwise("user")
        return F.when(after.isNotNull() & (after != want), _one(at(i + 1), F.concat(F.lit("after "), x["role"], F.lit(": "), after))).otherwise(_none())

    ids = F.transform(F.filter(m, called), lambda x: F.get(x["calls"], F.lit(0))["id"])
    answers = F.transform(F.filter(m, lambda x: x["role"] == "tool"), lambda x: x["answers"])
    twice = lambda names, where, what: F.when(F.size(_repeated(names)) > 0, _one(F.lit(where), F.concat(F.lit(what), F.array_join(_repeated(names), ", ")))).otherwise(_none())
    when = lambda test, where, error: F.when(F.coalesce(test, F.lit(True)), _one(where, error)).otherwise(_none())
    ends = _first(
        (F.size(m) < 3, _one(every, "fewer than three")), (F.get(m, F.lit(0))["role"] != "system", _one(at(F.lit(0)), "no system message")), (F.get(m, F.lit(1))["role"] != "user", _one(at(F.lit(1)), "no user message")),
        ((last["role"] != "assistant") | (F.coalesce(last["content"], F.lit("")) == ""), _one(at(F.size(m) - 1), "no text at the end")), (F.exists(F.slice(m, 2, F.greatest(F.size(m), F.lit(1))), lambda x: x["role"] == "system"), _one(every, "system message inside")),
    )
    rest = F.concat(twice(tools, "tools", "repeated names: "), F.flatten(F.transform(m, place)), twice(ids, "messages", "repeated call ids: "), when(F.array_sort(ids) != F.array_sort(answers), every, "calls and results don't pair"), F.flatten(F.transform(m, turn)))
    return F.when(F.size(ends) > 0, ends).otherwise(rest)


def with_row_errors(df: DataFrame, body: str, out: str = "errors") -> DataFrame:
    """Adds ``out``: what the JSON row in ``body`` breaks, as ``location, error`` in reading order; empty for a good row.

    A null, blank or malformed text, one that isn't an object or repeats a key
    gives one error without a location.  How a conversation hangs together is
    looked at only where its parts are well formed.
    """
    row = F.col("__row")
    read = df.withColumn("__row", _object(F.try_parse_json(body)))
    listed = lambda key: F.transform(F.coalesce(_array(_at(row, key)), F.array().cast("array<variant>")), _object)
    typed = read.withColumns({"__m": F.transform(listed("messages"), _read_message), "__t": F.transform(listed("tools"), _read_tool)})
    parts = F.concat(F.flatten(F.transform("__m", _message_errors)), F.flatten(F.transform("__t", _tool_errors)))
    top = _first(
        (row.isNull(), _one(F.lit(""), "not an object")), *_keys(F.map_keys(row), ROW, [], F.lit("")), (_blank(_text(_at(row, "trajectory_id"))), _one(F.lit("trajectory_id"), "empty")), (_blank(_text(_at(row, "task_id"))), _one(F.lit("task_id"), "empty")),
        (_kind(_at(row, "messages")) != "ARRAY", _one(F.lit("messages"), "not a list")), (_kind(_at(row, "tools")) != "ARRAY", _one(F.lit("tools"), "not a list")), (F.size("__t") == 0, _one(F.lit("tools"), "empty")), (_kind(_at(row, "metadata")) != "OBJECT", _one(F.lit("metadata"), "not an object")),
    )
    found = typed.withColumn("__e", F.when(F.size(top) > 0, top).otherwise(parts))
    together = bound(F.transform("__t", lambda t: t["name"]), lambda names: _conversation_errors(F.col("__m"), names))
    return found.withColumn(out, F.when(F.size("__e") > 0, F.col("__e")).otherwise(together)).drop("__row", "__m", "__t", "__e")


def training_json(df: DataFrame, tools: str, metadata: Sequence[str], out: str = "row") -> DataFrame:
    """Adds ``out``: the training row of ``trajectory_id, task_id, messages`` as JSON text, in chat format.

    System and user messages hold role and content, assistant messages calls
    where they make any (arguments that are no JSON are null), tool messages
    the id they answer.  ``tools`` is the JSON text of the tool definitions.
    """
    keep = {"ignoreNullFields": "false"}

    def call(c: Column) -> Column:
        return F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), F.try_parse_json(c["arguments"]).alias("arguments")).alias("function"))

    def message(m: Column) -> Column:
        calls = F.transform(m["tool_calls"], call)
        role, content = m["role"].alias("role"), m["content"].alias("content")
        return F.when((m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0), F.to_json(F.struct(role, content, calls.alias("tool_calls")), keep)).when(m["role"] == "tool", F.to_json(F.struct(role, content, m["tool_call_id"].alias("tool_call_id")), keep)).otherwise(F.to_json(F.struct(role, content), keep))

    head = F.to_json(F.struct("trajectory_id", "task_id", F.struct(*metadata).alias("metadata")), keep)
    body = F.array_join(F.transform("messages", message), ",")
    return df.withColumn(out, F.concat(F.substring(head, 1, 1 << 30).substr(F.lit(1), F.length(head) - 1), F.lit(',"messages":['), F.coalesce(body, F.lit("")), F.lit('],"tools":'), F.lit(tools), F.lit("}")))
