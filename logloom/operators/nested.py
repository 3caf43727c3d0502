"""Nested JSON records to flat tables with parent links, by structural variants.

A bottom-up tree automaton gives every node of a record a state: what a leaf
is, what the members of a list are, and for an object the kind that its keys
and its children's states make it (record, outcome, message, call, function,
plain map).  The states route the objects to their tables; kind and keys of all that is in
a node are its shape.  A document kept as a JSON
string is read as the document.  Each variant goes to the table of its kind,
typed, with the keys all kinds share (record, trajectory, path) and the path of
its parent.

Where an object stands doesn't matter: a message, a call or a breakdown at any
depth gets its row, tied to the nearest message or record above it.

A null, empty or incomplete body, or one that is no object, gives one row in
``rejects`` and none elsewhere.  Missing, null and empty parts mean the same:
no rows.  Repeated records give repeated rows, told apart by ``record_key``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All kinds in one layout: what every row has, then each kind's own columns.
_LAYOUT = (
    "record_key string, entity string, subtype string, shape string, trajectory_id string, path string, parent string, pos int, message_pos int, "
    "id string, role string, content string, turn_idx int, error boolean, name string, arguments string, answer_pos int, "
    "item string, value string, number double, task_id string, tier string, trial int, reward double, termination_reason string, duration_seconds double"
)
_NAMES = [c.split()[0] for c in _LAYOUT.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _LAYOUT.split(", ")])

# The automaton: an object whose keys hold one of these sets is of that kind; the first that fits counts.
_RULES: list[tuple[str, list[set[str]]]] = [
    ("message", [{"role"}]),
    ("call", [{"function"}, {"name", "arguments"}, {"name", "id"}]),
    ("record", [{"messages"}, {"outcome"}, {"reward_info"}]),
    ("outcome", [{"reward_breakdown"}, {"reward"}, {"termination_reason"}]),
]
ROLES = ("system", "user", "assistant", "tool")


def unbox(value: Any) -> Any:
    """The document in a string that holds one, else the value itself."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _leaf(value: Any) -> str:
    """The state of a leaf; of a document kept in a string the kind alone."""
    if value is None:
        return "nil"
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, (int, float)):
        return "number"
    inner = unbox(value)
    return "text" if isinstance(inner, str) else f"boxed {kind_of(inner) if isinstance(inner, dict) else 'list'}"


def kind_of(value: dict) -> str:
    keys = {k for k, v in value.items() if v is not None}
    return next((kind for kind, sets in _RULES if any(s <= keys for s in sets)), "map")


class _Node:
    """An object or list with its place; ``states`` is what the automaton makes of it from its members' states."""

    __slots__ = ("boxed", "closed", "key", "kids", "look", "message", "path", "pos", "record", "single", "states", "table", "up", "value", "whole")

    def __init__(self, value: Any, up: _Node | None, key: str | None, pos: int, path: str, boxed: bool, single: bool) -> None:
        self.value, self.up, self.key, self.pos, self.path, self.boxed, self.single = value, up, key, pos, path, boxed, single
        self.kids: dict[Any, _Node] = {}
        self.states: set[str] = set()
        self.table: str | None = None
        self.record: _Node | None = None
        self.message: _Node | None = None
        self.closed, self.look, self.whole = False, "", None


def _tree(value: Any, boxed: bool, skip: frozenset[str]) -> list[_Node]:
    """Every object and list from the top down; strings under the keys ``skip`` aren't read as documents."""
    nodes: list[_Node] = []
    stack = [_Node(value, None, None, 0, "$", boxed, False)]
    while stack:
        node = stack.pop()
        nodes.append(node)
        inside = node.value.items() if isinstance(node.value, dict) else enumerate(node.value)
        for k, v in inside:
            if isinstance(v, str) and not (k in skip and isinstance(node.value, dict)):
                was, v = v, unbox(v)
                boxed = v is not was
            else:
                boxed = False
            if isinstance(v, (dict, list)):
                single = k in ("messages", "tool_calls") and isinstance(v, dict)
                path = f"{node.path}.{k}" if isinstance(node.value, dict) else f"{node.path}[{k}]"
                node.kids[k] = _Node([v] if single else v, node, k if isinstance(node.value, dict) else node.key, k if isinstance(node.value, list) else 0, path, boxed, single)
        stack.extend(reversed(node.kids.values()))
    return nodes


def _set_states(nodes: list[_Node]) -> None:
    """From the bottom up: a list has its members' states, an object those that its keys and its children's states make."""
    for node in reversed(nodes):
        v = node.value
        if isinstance(v, list):
            node.states = set().union(*(kid.states for kid in node.kids.values()))
            continue
        has = lambda k, *states: k in node.kids and not node.kids[k].states.isdisjoint(states)  # noqa: E731, B023
        if v.get("role") in ROLES and not v.keys().isdisjoint(("content", "tool_calls", "tool_call_id")):
            node.states = {"message"}
        elif has("function", "function", "call") or (isinstance(v.get("name"), str) and "arguments" in v):
            node.states = {"call" if "function" in node.kids or v.get("id") is not None else "function"}
        elif has("messages", "message") or has("outcome", "outcome") or has("reward_info", "outcome"):
            node.states = {"record"}
        elif "reward_breakdown" in v or isinstance(v.get("reward"), (int, float)):
            node.states = {"outcome"}
        else:
            node.states = {"map"}


def _route(nodes: list[_Node]) -> None:
    """Each object's table by its state, with its nearest record and message.  What a call, a breakdown,
    a tool's answer or a text holds is that column's value and gives no rows of its own."""
    top = nodes[0]
    for node in nodes:
        up = node.up
        if up is None:
            wrapper = isinstance(top.value, dict) and top.states == {"map"} and _own_id(top.value) is None and any("record" in x.states for x in nodes[1:])
            node.table, node.record = None if wrapper else "candidate", node
            continue
        node.record, node.message = up.record, up.message
        if up.table == "message":
            node.message = up
        elif up.table == "candidate":
            node.record, node.message = up, None
        value = up.table == "message" and node.key == "content" and (node.boxed or up.value.get("role") == "tool")
        node.closed = up.closed or up.table == "call" or value or (isinstance(up.value, dict) and node.key == "reward_breakdown")
        if node.closed or not isinstance(node.value, dict):
            continue
        holder = up.up if isinstance(up.value, list) else None
        if holder is not None and node.key == "messages" and isinstance(holder.value, dict) and (holder.table == "candidate" or "message" in up.states):
            node.table = "message"
        elif holder is not None and node.key == "tool_calls" and holder.table == "message":
            node.table = "call"
        elif "message" in node.states:
            node.table = "message"
        elif "call" in node.states or ("function" in node.states and node.message is not None):
            node.table = "call"
        elif "record" in node.states:
            node.table = "candidate"


def _set_looks(nodes: list[_Node]) -> None:
    """From the bottom up the whole shape of every node; an object with a row of its own shows its kind alone."""
    for node in reversed(nodes):
        seen = lambda k, v: node.kids[k].look if k in node.kids else _leaf(v)  # noqa: E731, B023
        if isinstance(node.value, list):
            look = "|".join(sorted({seen(i, x) for i, x in enumerate(node.value)}))
            node.look = look if node.single else f"list of {look}"
        else:
            node.look = f"{kind_of(node.value)}(" + ", ".join(f"{k}: {seen(k, v)}" for k, v in sorted(node.value.items())) + ")"
        if node.boxed:
            node.look = f"boxed {node.look}"
        node.whole = node.look
        if node.table and node.up is not None:  # its own row has the rest
            node.look = ("boxed " if node.boxed else "") + kind_of(node.value)


def shape(value: Any) -> str:
    """The automaton's state of a value with its keys and those of all that is in it."""
    inner = unbox(value)
    if not isinstance(inner, (dict, list)):
        return _leaf(value)
    nodes = _tree(inner, inner is not value, frozenset())
    _set_looks(nodes)
    return nodes[0].look


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """Every non-null leaf with its path of keys and list places; empty containers hold none."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{at}.{k}" if at else str(k), x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((f"{at}.{i}" if at else str(i), v[i]) for i in range(len(v) - 1, -1, -1))
        elif v is not None:
            yield at, v


def _text(v: Any) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False, sort_keys=True)


def _number(v: Any) -> float | None:
    try:
        return None if v is None or isinstance(v, (dict, list)) else float(v)
    except (ValueError, OverflowError):
        return None


def _whole(v: Any) -> int | None:
    n = _number(v)
    return int(n) if n is not None and abs(n) < 2**31 and n == int(n) else None


def _own_id(value: dict) -> Any:
    return value.get("trajectory_id") if value.get("trajectory_id") is not None else value.get("id")


def _answered(m: dict) -> Any:
    return m.get("tool_call_id") if m.get("tool_call_id") is not None else m.get("id")


def parse_record(key: str | None, body: str | None, shapes: bool = True) -> list[dict]:
    """All rows of one record."""
    try:
        record = json.loads(body) if body else None
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return [{"record_key": key, "entity": "reject", "subtype": "null" if body is None else "empty" if not body.strip() else "incomplete"}]
    nodes = _tree(record, False, frozenset() if shapes else frozenset(("content", "arguments")))
    _set_states(nodes)
    _route(nodes)
    if shapes:
        _set_looks(nodes)
    answers: dict[int, dict[str, int]] = {}  # of each list of messages, and of each record for calls outside any message
    for node in nodes:
        if node.table == "message" and node.value.get("role") == "tool" and _answered(node.value) is not None:
            for scope in (node.up, node.record):
                answers.setdefault(id(scope), {}).setdefault(_text(_answered(node.value)) or "", node.pos)
    rows: list[dict] = []
    trajectories: dict[int, str | None] = {}
    shadowed: set[int] = set()
    for node in nodes:
        v, up = node.value, node.up
        own = up is None or node.table == "candidate"
        if own:
            found = _text(_own_id(v))
            trajectories[id(node)] = found if found is not None or up is None else trajectories[id(node.record)]
        if node.closed or not isinstance(v, dict):
            continue
        common = {"record_key": key, "trajectory_id": trajectories[id(node if own else node.record)], "shape": node.whole, "path": node.path}
        above = None if up is None else (node.message or node.record).path
        if own:  # outcome, reward_info and the record itself are the same thing; the first there is counts
            holder = next((h for h in ("outcome", "reward_info") if h in node.kids and isinstance(node.kids[h].value, dict)), None)
            outcome = node.kids[holder].value if holder else v
            shadowed |= {id(x) for x in (v, *(node.kids[h].value for h in ("outcome", "reward_info") if h in node.kids)) if x is not outcome}
        if node.table == "candidate":
            rows.append(
                common | {"entity": "candidate", "subtype": holder or "bare", "parent": above, "id": common["trajectory_id"], "task_id": _text(v.get("task_id")), "tier": _text(v.get("tier")), "trial": _whole(v.get("trial")),
                          "reward": _number(outcome.get("reward")), "termination_reason": _text(outcome.get("termination_reason")), "duration_seconds": _number(outcome.get("duration_seconds"))}
            )
        elif node.table == "message":
            subtype = "call" if any(x.table == "call" for k in node.kids.values() for x in (k, *k.kids.values())) else "result" if v.get("role") == "tool" else "text" if v.get("content") else "blank"
            error = v.get("error")
            rows.append(
                common | {"entity": "message", "subtype": subtype, "parent": above, "pos": node.pos, "message_pos": node.pos, "role": _text(v.get("role")), "content": _text(v.get("content")),
                          "turn_idx": _whole(v.get("turn_idx")), "error": error if isinstance(error, bool) else None, "id": _text(_answered(v))}
            )
        elif node.table == "call":
            f = node.kids["function"].value if "function" in node.kids and isinstance(node.kids["function"].value, dict) else v
            call, said = _text(v.get("id")), node.message
            known = answers.get(id(said.up if said else node.record), {})
            rows.append(
                common | {"entity": "call", "subtype": "plain" if f is v else "function", "parent": above, "pos": node.pos, "message_pos": said.pos if said else -1,
                          "id": call, "item": call, "name": _text(f.get("name")), "arguments": _text(unbox(f.get("arguments"))), "answer_pos": known.get(call, -1) if call is not None else -1}
            )
            continue
        if v.get("reward_breakdown") is not None and id(v) not in shadowed:
            parent = node.path if node.table else above or "$"
            for item, x in leaves(unbox(v["reward_breakdown"])):
                rows.append(common | {"entity": "reward", "subtype": _leaf(x), "shape": _leaf(x) if shapes else None, "path": f"{node.path}.reward_breakdown.{item}", "parent": parent, "item": item, "value": _text(x), "number": _number(x), "message_pos": -1, "answer_pos": -1})
    return rows


def flatten_records(records: DataFrame, key: str = "record_id", body: str = "body", shapes: bool = True) -> DataFrame:
    """All rows of all records in one layout; ``tables`` tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for k, b in zip(batch.column(0), batch.column(1), strict=True):
                rows += parse_record(k.as_py(), b.as_py(), shapes)
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return records.select(F.col(key).cast("string"), F.col(body)).mapInArrow(run, _LAYOUT)


_SHARED = ["record_key", "trajectory_id", "shape", "subtype", "path", "parent"]
_OWN = {
    "candidate": ["task_id", "tier", "trial", "reward", "termination_reason", "duration_seconds"],
    "message": ["message_pos", "role", "content", "turn_idx", "error", "id"],
    "call": ["message_pos", "pos", "id", "name", "arguments", "answer_pos"],
    "reward": ["item", "value", "number"],
    "reject": [],
}


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The typed table of each kind: candidate, message, call, reward, reject."""
    return {kind: flat.filter(F.col("entity") == kind).select(*_SHARED, *own) for kind, own in _OWN.items()}


def shapes(flat: DataFrame) -> DataFrame:
    """How often each structural variant occurs: ``entity, subtype, shape, rows``."""
    return flat.groupBy("entity", "subtype", "shape").agg(F.count("*").alias("rows"))
