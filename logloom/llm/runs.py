"""Runs of the same event: each run becomes one row with count and duration.

Only boundary rows are kept: an event that differs from the one before it, and
the last of its block.  The next boundary's position gives the count, the event
just before it the run's end.  A sequence is cut into blocks of ``block``
consecutive places, so that one sequence holding a third of all rows is sorted
by many tasks; only the first and the last run of a block (two rows of it) meet
again to be joined over the cut.

Nulls: a null group is a group of its own; a null place sorts first; a null
identity is never a repeated delivery; null signatures equal each other.  Ties
in place are settled by identity.  An empty table gives an empty result, and
other columns of the input, whatever their names, have no effect.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import materialize

#: A number as JSON writes it, maybe with a plus: sign, whole digits, decimals and exponent (an exponent beyond 18 digits makes it a text).
_NUMBER = r"^\s*([+-]?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]{1,18}))?\s*$"
#: What holds an object in an object or a list in a list, or may do so.
_DEEP = r"(?s)^.[^{]*\{|\[[^\]]*\["


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def _number(text: Column) -> Column:
    """A number's exact value as text, whatever its length: 1.50, 1.5 and 15e-1 agree."""
    part = lambda i: F.regexp_extract(text, _NUMBER, i)
    digits = F.ltrim(F.concat(part(2), part(3)), F.lit("0"))
    core = F.rtrim(digits, F.lit("0"))
    power = F.coalesce(F.nullif(part(4), F.lit("")).cast("long"), F.lit(0)) - F.length(part(3)) + F.length(digits) - F.length(core)
    return F.when(core == "", "#0").otherwise(F.concat(F.lit("#"), F.when(part(1) == "-", "-").otherwise(""), core, F.lit("e"), power.cast("string")))


def _scalar(text: Column) -> Column:
    """Numbers by value; all else by letters and digits, ignoring case."""
    return F.when(text.rlike(_NUMBER), _number(text)).otherwise(_plain(text))


def _value(text: Column) -> Column:
    """One flat value in normal form; null or empty where it has none."""
    items = F.from_json(F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), text), "array<string>")
    return F.coalesce(F.array_join(F.transform(items, lambda x: F.coalesce(_scalar(x), F.lit(""))), ","), _scalar(text))


class _Raw(str):
    """A number as it was written."""

    __slots__ = ()


def _load(text: str) -> object:
    return json.loads(text, parse_float=_Raw, parse_int=_Raw, parse_constant=str)


def normal_text(value: object) -> str:
    """Any value in normal form, to any depth; of flat ones the same text as ``_value`` makes."""
    if value is None:
        return ""
    if isinstance(value, str):
        if value.lstrip()[:1] in ("[", "{") and value.rstrip()[-1:] in ("]", "}"):
            try:
                return normal_text(_load(value))
            except (ValueError, RecursionError):
                pass
        m = _NUMBER_RE.match(value)
        if not m:
            return "".join(c for c in value if c.isalnum()).lower()
        sign, whole, part, power = (x or "" for x in m.groups())
        digits = (whole + part).lstrip("0")
        core = digits.rstrip("0")
        return f"#{'-' * (sign == '-')}{core}e{int(power or 0) - len(part) + len(digits) - len(core)}" if core else "#0"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return ",".join(f"[{normal_text(x)}]" if isinstance(x, list) else normal_text(x) for x in value)
    assert isinstance(value, dict)
    held = ((k, normal_text(v)) for k, v in value.items())
    pairs = sorted((f"{k}\x01{v}" for k, v in held if v), key=lambda p: p.encode("utf-8", "replace"))
    return "{" + "\x02".join(pairs) + "}" if pairs else ""


_NUMBER_RE = re.compile(_NUMBER.replace("$", r"\Z"), re.ASCII)


@F.pandas_udf(T.StringType())
def _deep(docs: pd.Series) -> pd.Series:
    """The normal form of nested documents; null for null and for what is no object."""

    def one(doc: str | None) -> str | None:
        try:
            value = None if doc is None else _load(doc)
        except (ValueError, RecursionError):
            return None
        return normal_text(value).strip("{}").encode("utf-8", "replace").decode() if isinstance(value, dict) else None

    return docs.map(one, na_action="ignore").astype(object)


def with_same_arguments(df: DataFrame, arguments: str, out: str) -> DataFrame:
    """Add ``out``: arguments read as data, as one text that is equal for equal arguments.

    Field order, layout, a document stored as a JSON string, fields without a
    value (null, empty, blank), the way a number is written, case and
    punctuation don't matter, at any depth.  Lists keep their order.  What is
    no JSON object counts by value or by letters and digits; null and empty
    text count as no arguments.  Parsing goes in steps of one projection each,
    so nothing is parsed twice; only nested documents go through Python.
    """
    raw = F.trim(F.col(arguments))
    unboxed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
    doc = F.col("__doc")
    fields = F.map_entries(F.from_json(doc, "map<string,string>"))
    pairs = F.transform("__fields", lambda e: F.concat(e["key"], F.lit("\x01"), _value(e["value"])))
    stepped = (
        df.withColumn("__doc", F.when(raw.startswith('"'), F.trim(unboxed)).otherwise(raw))
        .withColumn("__deep", _deep(F.when(doc.startswith("{") & doc.rlike(_DEEP), doc)))
        .withColumn("__fields", F.when(F.col("__deep").isNull() & doc.startswith("{"), fields))
        .withColumn("__pairs", F.sort_array(F.filter(pairs, lambda x: x.isNotNull() & ~x.endswith("\x01"))))
    )
    text = F.when(F.col("__deep").isNotNull(), F.col("__deep")).when(F.col("__fields").isNotNull(), F.array_join("__pairs", "\x02"))
    return stepped.withColumn(out, F.coalesce(text, F.when(doc == "null", ""), _value(doc), F.lit(""))).drop("__doc", "__deep", "__fields", "__pairs")


def collapse_runs(
    df: DataFrame,
    group: Column,
    place: Column,
    sub_place: Column,
    identity: Column,
    signature: Column,
    begins: Column,
    ends: Column,
    block: int = 512,
) -> DataFrame:
    """One row for each maximal run of consecutive events with equal ``signature``.

    ``place`` (an integer) and ``sub_place`` order a group's events; rows with
    the same identity at the same place are one event delivered again.  Returns
    ``group, first_id, last_id, run_length, run_begin, run_end,
    duration_seconds`` (of the first event's beginning to the last one's end,
    never below 0; where an end is missing the event's beginning stands in).
    """
    begin = begins
    base = df.select(
        group.alias("g"), F.coalesce(F.floor(place / block), F.lit(-1)).cast("long").alias("blk"), place.cast("long").alias("m"), sub_place.alias("p"),
        identity.alias("id"), F.md5(F.coalesce(signature, F.lit("\x00"))).alias("sig"), begin.alias("b"), F.coalesce(ends, begin).alias("e"),
    ).withColumn("sig", F.unhex("sig"))
    w = Window.partitionBy("g", "blk").orderBy("m", "p", "id")
    once = base.withColumn("dup", F.coalesce(F.lag("id").over(w) == F.col("id"), F.lit(False))).filter(~F.col("dup")).drop("dup")
    before = F.lag(F.struct("sig", "id", "e")).over(w)
    marked = once.select("*", F.row_number().over(w).alias("pos"), before.alias("prev"), F.lead(F.lit(1)).over(w).isNull().alias("is_last"))
    marked = marked.withColumn("new", F.col("prev").isNull() | ~F.col("prev.sig").eqNullSafe(F.col("sig")))
    bounds = marked.filter(F.col("new") | F.col("is_last"))
    following = F.lead(F.struct("pos", "new", "id", "e", F.col("prev.id").alias("pid"), F.col("prev.e").alias("pe"))).over(w)
    nx = F.col("nx")
    runs = (
        bounds.withColumn("nx", following)
        .filter("new")
        .select(
            "g", "blk", "pos", "sig", F.col("id").alias("first_id"), F.col("b").alias("run_begin"),
            F.when(nx.isNull(), F.col("id")).when(nx["new"], nx["pid"]).otherwise(nx["id"]).alias("last_id"),
            F.when(nx.isNull(), F.col("e")).when(nx["new"], nx["pe"]).otherwise(nx["e"]).alias("run_end"),
            F.when(nx.isNull(), 1).when(nx["new"], nx["pos"] - F.col("pos")).otherwise(nx["pos"] - F.col("pos") + 1).cast("long").alias("n"),
            (F.col("pos") == 1).alias("head"), (nx.isNull() | ~nx["new"]).alias("tail"),
        )
    )
    runs = materialize(runs, "runs")  # read twice below; far fewer rows than events
    names = ["g", "first_id", "last_id", "n", "run_begin", "run_end"]
    inner = runs.filter(~F.col("head") & ~F.col("tail")).select(*names)
    over = Window.partitionBy("g").orderBy("blk", "pos")
    last = F.lag(F.struct("sig", "tail", "blk")).over(over)
    edges = runs.filter("head OR tail").withColumn("before", last)
    starts = ~F.coalesce(F.col("head") & F.col("before.tail") & (F.col("before.blk") < F.col("blk")) & F.col("before.sig").eqNullSafe(F.col("sig")), F.lit(False))
    chained = edges.withColumn("chain", F.sum(starts.cast("long")).over(over))
    at = F.struct("blk", "pos")
    joined = chained.groupBy("g", "chain").agg(
        F.min_by(F.struct("first_id", "run_begin"), at).alias("first"), F.max_by(F.struct("last_id", "run_end"), at).alias("end"), F.sum("n").alias("n")
    ).select("g", F.col("first.first_id").alias("first_id"), F.col("end.last_id").alias("last_id"), "n", F.col("first.run_begin").alias("run_begin"), F.col("end.run_end").alias("run_end"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("run_begin"), F.col("run_end")) / 1e6
    return inner.unionByName(joined).select(
        F.col("g").alias("group"), "first_id", "last_id", F.col("n").alias("run_length"), "run_begin", "run_end", F.greatest(seconds, F.lit(0.0)).alias("duration_seconds")
    )


def call_runs(calls: DataFrame) -> DataFrame:
    """``collapse_runs`` over the calls of each trajectory: same name, same arguments as data."""
    used = calls.select("trajectory_id", "message_index", "call_pos", "call_id", "name", "arguments", "called_at", "finished_at")
    keyed = with_same_arguments(used, "arguments", "__same")
    return collapse_runs(
        keyed, F.col("trajectory_id"), F.col("message_index"), F.col("call_pos"), F.col("call_id"),
        F.concat(F.coalesce("name", F.lit("")), F.lit("\x03"), F.col("__same")), F.col("called_at"), F.col("finished_at"),
    )
