"""Rendering conversations, tokens with offsets, assistant-only labels and their audit.

Rendering is an expression over the message array; the places of assistant
text follow from the lengths of what stands before, so nothing is searched for
in the rendered text.  Tokenizers plug in as a function that gives ids and
character offsets; ``functions.tokens`` has a public one, and a pattern of words
and white space stands in for unit tests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.tokens import offset_tokenizer, public_tokenizer, tokenizer_path
from logloom.operators.datasets import IGNORED

# Fixed values of the chat format.
START, END = "<|im_start|>", "<|im_end|>"
SPAN = "struct<ordinal:int,kind:string,header_start:int,content_start:int,target_end:int>"

Tokenizer = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


def pattern_tokenizer(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Words, marks and runs of white space, with an id from the text itself."""
    found = list(re.finditer(r"<\|\w+\|>|\w+|\s+|[^\w\s]", text))
    return [sum(m.group().encode()) % 50_000 for m in found], [m.span() for m in found]


def message_parts(m: Column) -> tuple[Column, Column]:
    """Header and body of one rendered message."""
    calls = F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    shown = F.array_join(F.transform(calls, lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), F.coalesce(c["name"], F.lit("")), F.lit('", "arguments": '), F.coalesce(c["arguments"], F.lit("null")), F.lit("}\n</tool_call>"))), "\n")
    body = F.when(m["role"] == "tool", F.concat(F.lit("<tool_response>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n</tool_response>"))).when(F.size(calls) > 0, shown).otherwise(F.coalesce(m["content"], F.lit("")))
    role = F.when(m["role"] == "tool", "user").otherwise(F.coalesce(m["role"], F.lit("user")))
    return F.concat(F.lit(START), role, F.lit("\n")), body


def render(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds ``rendered`` and ``spans``: the text and where each assistant message stands in it.

    A span begins at its header; its target is what follows the header, with
    the end mark.  Null or empty messages give an empty text without spans.
    """
    tail = F.lit(END + "\n")

    def part(m: Column) -> Column:
        head, body = message_parts(m)
        calls = F.size(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>")))
        return F.struct(head.alias("head"), body.alias("body"), (m["role"] == "assistant").alias("own"), F.when(calls > 0, "tool_call").otherwise("text").alias("kind"))

    parts = df.withColumn("__parts", F.transform(F.coalesce(F.col(messages), F.array().cast(df.schema[messages].dataType)), part))
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], tail)), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        content = acc["at"] + F.length(p["head"])
        end = content + F.length(p["body"]) + len(END)
        span = F.struct(F.size(acc["spans"]).cast("int").alias("ordinal"), p["kind"].alias("kind"), acc["at"].cast("int").alias("header_start"), content.cast("int").alias("content_start"), end.cast("int").alias("target_end"))
        return F.struct((end + 1).cast("int").alias("at"), F.when(F.coalesce(p["own"], F.lit(False)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return parts.withColumn("rendered", text).withColumn("spans", F.aggregate("__parts", start, step, lambda acc: acc["spans"])).drop("__parts")


def rendering_errors(rendered: Column, spans: Column) -> Column:
    """What a rendered text breaks: its beginning, its end, balanced marks."""
    count = lambda mark: F.size(F.split(rendered, re.escape(mark))) - 1
    tests = [(~rendered.startswith(START + "system"), "no system at the start"), (~rendered.endswith(END + "\n"), "no end mark at the end"), (count(START) != count(END), "unbalanced messages"), (count("<tool_call>") != count("</tool_call>"), "unbalanced tool calls"), (F.size(spans) == 0, "no assistant")]
    return F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())


_LABELLED = "input_ids array<int>, labels array<int>, starts array<int>, ends array<int>, merged_spans int"


def label(df: DataFrame, key: str, tokenize: Tokenizer = public_tokenizer) -> DataFrame:
    """``key, input_ids, labels, starts, ends, merged_spans`` of rows with ``rendered`` and ``spans``.

    A token is supervised if it lies wholly in an assistant's target and isn't
    empty; one that begins before a target and reaches into it stays masked and
    its span counts as merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("input_ids", "labels", "starts", "ends", "merged_spans")}
            for text, spans in zip(batch.column("rendered").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ids, at = tokenize(text or "")
                labels, merged, k = [], 0, 0
                spans = spans or []
                for i, (a, b) in zip(ids, at, strict=True):
                    while k < len(spans) and spans[k]["target_end"] <= a:
                        k += 1
                    inside = k < len(spans) and a >= spans[k]["content_start"] and b <= spans[k]["target_end"] and b > a
                    merged += k < len(spans) and a < spans[k]["content_start"] < b
                    labels.append(i if inside else IGNORED)
                out["input_ids"].append(ids)
                out["labels"].append(labels)
                out["starts"].append([a for a, _ in at])
                out["ends"].append([b for _, b in at])
                out["merged_spans"].append(int(merged))
            arrays = [pa.array(v, pa.int32() if n == "merged_spans" else pa.list_(pa.int32())) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], names=[key, *out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "rendered", "spans").mapInArrow(run, f"{key} {kind}, {_LABELLED}")


def round_trip(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, tokens, difference, reencodes``: whether a text comes back from its tokens.

    ``difference`` is the first character in which the decoded text differs
    (null if none), ``reencodes`` whether the decoded text gives the same ids.
    Null counts as an empty text; it has no tokens.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = offset_tokenizer(path)
        for batch in batches:
            out: dict[str, list] = {"tokens": [], "difference": [], "reencodes": []}
            for text in batch.column(1).to_pylist():
                ids = own.own.encode_ordinary(text or "")
                back = own.decode(ids)
                same = back == (text or "")
                out["tokens"].append(len(ids))
                out["difference"].append(None if same else next((i for i, (a, b) in enumerate(zip(text or "", back, strict=False)) if a != b), min(len(text or ""), len(back))))
                out["reencodes"].append(own.own.encode_ordinary(back) == ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["tokens"], pa.int64()), pa.array(out["difference"], pa.int64()), pa.array(out["reencodes"], pa.bool_())], names=["key", *out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, tokens long, difference long, reencodes boolean").withColumnRenamed("key", key)


def token_rows(labelled: DataFrame, key: str) -> DataFrame:
    """One row a token: place, id, label and whether it counts."""
    zipped = F.posexplode(F.arrays_zip("input_ids", "labels", "starts", "ends")).alias("place", "t")
    rows = labelled.select(key, zipped)
    return rows.select(key, "place", F.col("t.input_ids").alias("input_id"), F.col("t.labels").alias("label"), F.when(F.col("t.labels") == IGNORED, "no").otherwise("yes").alias("loss"), F.col("t.starts").alias("start"), F.col("t.ends").alias("end"))


def first_token_at(starts: Column, character: Column) -> Column:
    """The place of the first token that begins at a character; null where none does."""
    at = F.array_position(starts, character)
    return F.when(at > 0, (at - 1).cast("long"))


def span_audit(tokens: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """One row an assistant span: its supervised tokens ``[from:to)``, their characters' text and a header that says so.

    ``masked_leading`` are characters of the target before its first supervised
    token.  A span without supervised tokens has none of these.
    """
    own = tokens.filter(F.col("loss") == "yes").join(rendered.select(key, "spans"), key)
    hit = F.get(F.filter("spans", lambda s: (F.col("start") >= s["content_start"]) & (F.col("start") < s["target_end"])), F.lit(0))
    per = own.select(key, hit["ordinal"].alias("ordinal"), "place", "start", "end").groupBy(key, "ordinal").agg(F.min("place").alias("first"), (F.max("place") + 1).alias("last"), F.count("*").alias("supervised"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = rendered.select(key, "rendered", F.explode("spans").alias("s")).select(key, "rendered", "s.ordinal", "s.kind", "s.content_start")
    joined = spans.join(per, [key, "ordinal"], "left").withColumn("masked_leading", F.col("start") - F.col("content_start"))
    header = F.format_string("--- assistant %02d | %s | tokens [%d:%d) | count=%d | masked_leading_chars=%d ---", "ordinal", "kind", "first", "last", "supervised", "masked_leading")
    return joined.select(key, "ordinal", "kind", "supervised", "masked_leading", header.alias("header"), F.substr("rendered", F.col("start") + 1, F.col("end") - F.col("start")).alias("target"))


def template_sha256(template: str) -> str:
    """The hash of a chat format; a blank one is an error."""
    if not template.strip():
        raise ValueError("the chat format is blank")
    return hashlib.sha256(template.encode("utf-8")).hexdigest()


def regions(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Adds ``region``: external_context, assistant_header, assistant_<kind> or assistant_end.

    Spans are the array of the same row, so each token looks its own row's
    spans up; no range join runs.
    """
    joined = tokens.join(spans.select(key, "spans"), key)
    hit = F.get(F.filter("spans", lambda s: (F.col("start") >= s["header_start"]) & (F.col("start") < s["target_end"])), F.lit(0))
    kind = F.when(hit.isNull(), "external_context").when(F.col("start") < hit["content_start"], "assistant_header").when(F.col("start") >= hit["target_end"] - len(END), "assistant_end").otherwise(F.concat(F.lit("assistant_"), hit["kind"]))
    return joined.withColumn("region", kind).drop("spans")


def completion_kind(text: Column) -> Column:
    """Generated text as tool calls, text, or a protocol error (left-over tags, mixed, empty, arguments that are no object)."""
    calls = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), 1)
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)<tool_call>\s*.*?\s*</tool_call>", ""), r"(?U)^\s+|\s+$", "")
    good = F.forall(calls, lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), "$.arguments", "variant")).startswith("OBJECT"), F.lit(False)))
    stray = rest.contains("<tool_call>") | rest.contains("</tool_call>")
    return F.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), "empty").when(stray, "left-over tag").when((F.size(calls) > 0) & (rest != ""), "mixed").when((F.size(calls) > 0) & ~good, "bad arguments").when(F.size(calls) > 0, "tool_call").otherwise("text")
