"""Facts that tool results show, what a task refers to, and differences of documents.

Documents of a known kind are read with a typed schema and turned into rows of
``kind, subject, value`` by array expressions; free documents are flattened to
leaves.  Values are compared in a normal form: numbers by value, texts as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEM = "item_id:string,available:string,price:string,options:map<string,string>"
USER = "struct<user_id:string,email:string,name:map<string,string>,address:map<string,string>,orders:array<string>,payment_methods:map<string,struct<source:string,balance:string>>>"
ORDER = "struct<order_id:string,user_id:string,status:string,items:array<struct<item_id:string,product_id:string,price:string,options:map<string,string>>>,payment_history:array<struct<payment_method_id:string>>,fulfillments:array<struct<tracking_id:array<string>>>>"
PRODUCT = f"struct<product_id:string,name:string,variants:map<string,struct<{_ITEM}>>>"
ITEM = f"struct<{_ITEM}>"
_FACT = "array<struct<kind:string,subject:array<string>,value:string>>"

# Which kind of reference, at which place of the subject, makes a fact matter.
RELEVANT = [
    ("authenticated_user", "user", 0), ("user_known", "user", 0), ("order_known", "order", 0), ("order_status", "order", 0), ("order_user", "order", 0), ("user_order", "order", 1),
    ("user_payment_method", "payment", 1), ("payment_source", "payment", 0), ("payment_balance", "payment", 0), ("order_payment_method", "payment", 1),
    ("order_item", "order_item", 1), ("order_item_product", "order_item", 1), ("order_item_price", "order_item", 1), ("order_item_option", "order_item", 1),
    ("product_known", "product", 0), ("product_name", "product", 0), ("product_variant_count", "product", 0), ("item_known", "item", 0), ("item_available", "item", 0), ("item_price", "item", 0), ("item_option", "item", 0),
]
BEFORE_WRITES = {"authenticated_user", "order_known", "order_status", "order_user", "order_item", "order_item_product", "order_item_price", "order_item_option", "order_payment_method", "item_known", "item_available", "item_price", "item_option"}
#: Which argument names what.
REFERENCES = {"user_id": "user", "order_id": "order", "product_id": "product", "item_ids": "order_item", "new_item_ids": "item", "payment_method_id": "payment"}


def plain_value(v: Column) -> Column:
    """A value's normal form as text: 1.50, 1.5 and 15e-1 agree."""
    number = F.when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.coalesce(F.when(v.rlike("[eE]"), v.try_cast("double").try_cast("decimal(38,12)")).otherwise(v.try_cast("decimal(38,12)"))))
    shown = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(shown, v)


def _fact(kind: str, subject: list[Column], value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*subject).alias("subject"), (plain_value(value) if value is not None else F.lit(None).cast("string")).alias("value"))


def _if(test: Column, *facts: Column) -> Column:
    return F.when(test, F.array(*facts)).otherwise(F.array().cast(_FACT))


def _each(items: Column, make) -> Column:  # noqa: ANN001
    empty = F.array().cast(_FACT)
    return F.coalesce(F.flatten(F.transform(items, make)), empty)


def _item_facts(item: Column, key: Column) -> Column:
    options = _each(F.map_entries(item["options"]), lambda o: F.array(_fact("item_option", [key, o["key"]], o["value"])))
    return F.concat(F.array(_fact("item_known", [key])), _if(item["available"].isNotNull(), _fact("item_available", [key], item["available"])), _if(item["price"].isNotNull(), _fact("item_price", [key], item["price"])), options)


def user_facts(doc: Column) -> Column:
    u = doc["user_id"]
    pays = _each(F.map_entries(doc["payment_methods"]), lambda p: F.concat(F.array(_fact("user_payment_method", [u, p["key"]])), _if(p["value"]["source"].isNotNull(), _fact("payment_source", [p["key"]], p["value"]["source"])), _if(p["value"]["balance"].isNotNull(), _fact("payment_balance", [p["key"]], p["value"]["balance"]))))
    part = lambda c: _each(F.map_entries(doc[c]), lambda e: F.array(_fact(f"user_{c}", [u, e["key"]], e["value"])))
    named = [part("name"), part("address")]
    return F.concat(F.array(_fact("user_known", [u])), _each(doc["orders"], lambda o: F.array(_fact("user_order", [u, o]))), pays, _if(doc["email"].isNotNull(), _fact("user_email", [u], doc["email"])), *named)


def order_facts(doc: Column) -> Column:
    o = doc["order_id"]

    def item(i: Column) -> Column:
        k = i["item_id"]
        options = _each(F.map_entries(i["options"]), lambda p: F.array(_fact("order_item_option", [o, k, p["key"]], p["value"])))
        return F.concat(F.array(_fact("order_item", [o, k])), _if(i["product_id"].isNotNull(), _fact("order_item_product", [o, k], i["product_id"])), _if(i["price"].isNotNull(), _fact("order_item_price", [o, k], i["price"])), options)

    return F.concat(
        F.array(_fact("order_known", [o])), _if(doc["status"].isNotNull(), _fact("order_status", [o], doc["status"])), _if(doc["user_id"].isNotNull(), _fact("order_user", [o], doc["user_id"])),
        _each(F.filter(doc["items"], lambda i: i["item_id"].isNotNull()), item), _each(F.filter(doc["payment_history"], lambda p: p["payment_method_id"].isNotNull()), lambda p: F.array(_fact("order_payment_method", [o, p["payment_method_id"]]))),
        _each(F.filter(doc["fulfillments"], lambda f: f["tracking_id"].isNotNull()), lambda f: F.transform(f["tracking_id"], lambda t: _fact("order_tracking", [o, t]))),
    )


def product_facts(doc: Column) -> Column:
    p = doc["product_id"]
    size = F.coalesce(F.size(F.map_keys(doc["variants"])), F.lit(0))
    each = _each(F.map_entries(doc["variants"]), lambda v: F.concat(F.array(_fact("product_item", [p, F.coalesce(v["value"]["item_id"], v["key"])])), _item_facts(v["value"], F.coalesce(v["value"]["item_id"], v["key"]))))
    return F.concat(F.array(_fact("product_known", [p])), _if(doc["name"].isNotNull(), _fact("product_name", [p], doc["name"])), F.array(_fact("product_variant_count", [p], F.greatest(size, F.lit(0)).cast("string"))), each)


def observed_facts(df: DataFrame, key: str, tool: str, result: str, arguments: str | None = None) -> DataFrame:
    """``key, kind, subject, value`` of what each tool result shows, each fact once a row.

    The tool's name tells the kind of document; a result that isn't of that
    kind, or null, shows nothing.  What a lookup of a user returns is the user,
    what a calculation returns belongs to its expression (in ``arguments``),
    and a list of product types names the products.
    """
    t, r = F.col(tool), F.col(result)
    said = F.coalesce(F.get_json_object(arguments, "$.expression"), F.lit("")) if arguments else F.lit("")
    types = _each(F.map_entries(F.from_json(r, "map<string,string>")), lambda e: F.array(_fact("product_name", [e["value"]], e["key"]), _fact("product_known", [e["value"]])))
    found = (
        F.when(t.isin("find_user_id_by_email", "find_user_id_by_name_zip") & r.isNotNull(), F.array(_fact("authenticated_user", [r]))).when((t == "calculate") & r.isNotNull(), F.array(_fact("calculation_result", [said], r)))
        .when((t == "get_user_details") & r.startswith("{"), user_facts(F.from_json(r, USER))).when((t == "get_order_details") & r.startswith("{"), order_facts(F.from_json(r, ORDER)))
        .when((t == "get_product_details") & r.startswith("{"), product_facts(F.from_json(r, PRODUCT))).when((t == "get_item_details") & r.startswith("{"), _item_facts(F.from_json(r, ITEM), F.from_json(r, ITEM)["item_id"]))
        .when((t == "list_all_product_types") & r.startswith("{"), types)
    )
    return df.select(key, F.explode(F.array_distinct(found)).alias("f")).select(key, "f.kind", "f.subject", "f.value")


def communicated_values(df: DataFrame, key: str, doc: str) -> DataFrame:
    """``key, vtype, value``: all that a result tells, each once a key: keys and values of any depth, normalised, and the words of texts.

    A text that spells a number or a truth value is one; others count without
    case and outer white space.  Null tells nothing.
    """

    def normal(v: Any) -> tuple[str, str] | None:
        if isinstance(v, str):
            try:
                decoded = json.loads(v)
            except (ValueError, RecursionError):
                decoded = v
            v = decoded if isinstance(decoded, (int, float, bool)) else v.strip().casefold()
        return None if v is None else _normal(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    stack = [json.loads(text)]
                except (ValueError, RecursionError):
                    stack = [text]
                told: set[tuple[str, str]] = set()
                while stack:
                    v = stack.pop()
                    if isinstance(v, dict):
                        stack += [*v.keys(), *v.values()]
                    elif isinstance(v, list):
                        stack += v
                    elif (found := normal(v)) is not None:
                        told.add(found)
                        if found[0] == "string":
                            told.update(("string", w) for w in re.findall(r"[a-z0-9]+", found[1]))
                at += [n] * len(told)
                kinds += [k for k, _ in told]
                values += [v for _, v in told]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["key", "vtype", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(doc)).mapInArrow(run, f"key {kind}, vtype string, value string").withColumnRenamed("key", key).distinct()


def expand_references(refs: DataFrame, key: str, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """``refs(key, ref_kind, id)`` with the users that named orders belong to and that hold named payment methods.

    ``orders(order_id, user_id)`` and ``payments(user_id, payment_id)`` are the
    database's; one hop, by equality joins.  Unknown ids add nothing.
    """
    owners = refs.filter("ref_kind = 'order'").join(orders.withColumnRenamed("order_id", "id"), "id").select(key, F.lit("user").alias("ref_kind"), F.col("user_id").alias("id"))
    holders = refs.filter("ref_kind = 'payment'").join(payments.withColumnRenamed("payment_id", "id"), "id").select(key, F.lit("user").alias("ref_kind"), F.col("user_id").alias("id"))
    return refs.select(key, "ref_kind", "id").unionByName(owners).unionByName(holders).filter("id IS NOT NULL").distinct()


def variants(products: DataFrame, doc: str = "product") -> DataFrame:
    """``item_id, product_id, variant``: the first product (by id) that has each item among its variants."""
    rows = products.select(F.col(f"{doc}.product_id").alias("product_id"), F.explode(f"{doc}.variants").alias("item_id", "variant"))
    return rows.groupBy("item_id").agg(F.min_by(F.struct("product_id", "variant"), "product_id").alias("p")).select("item_id", "p.product_id", "p.variant")


def references(actions: DataFrame, key: str, arguments: str, name: str | None = None) -> DataFrame:
    """``key, ref_kind, id`` of everything that reference actions name; an argument is one id or a list of them.

    With the column ``name``, the ``item_id`` that a lookup of an item asks for counts too.
    """
    pairs = F.map_entries(F.from_json(arguments, "map<string,string>"))
    kinds = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])
    looked_up = F.when((F.col("action") == "get_item_details") & (F.col("a.key") == "item_id"), "item")
    rows = actions.select(key, (F.col(name) if name else F.lit(None).cast("string")).alias("action"), F.explode(pairs).alias("a")).select(key, F.coalesce(looked_up, kinds[F.col("a.key")]).alias("ref_kind"), F.col("a.value").alias("v")).filter("ref_kind IS NOT NULL AND v IS NOT NULL")
    ids = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    return rows.select(key, "ref_kind", F.explode(ids).alias("id")).distinct()


def relevant_facts(facts: DataFrame, refs: DataFrame, key: str, before_writes: bool = False) -> DataFrame:
    """Facts about something that the same key's task refers to; with ``before_writes`` only what justifies a write.

    An item of a product counts if both are referred to, a calculation if the
    task has anything to communicate (a reference of the kind ``communicate``).
    """
    rules = [r for r in RELEVANT if not before_writes or r[0] in BEFORE_WRITES]
    where = F.create_map(*[F.lit(x) for kind, ref, at in rules for x in (kind, f"{ref}:{at}")])[F.col("kind")]
    marked = facts.withColumn("rule", where).filter("rule IS NOT NULL").withColumn("ref_kind", F.split_part("rule", F.lit(":"), F.lit(1))).withColumn("id", F.get("subject", F.split_part("rule", F.lit(":"), F.lit(2)).cast("int")))
    found = marked.join(refs, [key, "ref_kind", "id"], "left_semi").select(*facts.columns)
    if before_writes:
        return found
    of = lambda kind: refs.filter(F.col("ref_kind") == kind).select(key, F.col("id").alias(kind))
    paired = facts.filter("kind = 'product_item'").withColumns({"product": F.get("subject", F.lit(0)), "item": F.get("subject", F.lit(1))})
    paired = paired.join(of("product"), [key, "product"], "left_semi").join(of("item"), [key, "item"], "left_semi").select(*facts.columns)
    computed = facts.filter("kind = 'calculation_result'").join(of("communicate"), key, "left_semi").select(*facts.columns)
    return found.unionByName(paired).unionByName(computed)


def target_facts(gold: DataFrame, stored: DataFrame, refs: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """``key, kind, subject, value``: what a task wants found out.

    Relevant facts of the gold reads (``gold``), what the database (``stored``)
    holds that justifies a write, and the values to communicate (references of
    the kind ``communicate``) that no such fact has, if they can be observed
    (``told(key, value)``) or are all that the task wants.
    """
    kept = relevant_facts(gold, refs, key).unionByName(relevant_facts(stored, refs, key, before_writes=True)).select(key, "kind", "subject", "value").distinct()
    wanted = refs.filter("ref_kind = 'communicate'").select(key, F.col("id").alias("value")).distinct()
    missing = wanted.join(kept.select(key, "value"), [key, "value"], "left_anti")
    seen = missing.join(told.select(key, "value"), [key, "value"], "left_semi")
    only = missing.join(kept.select(key), key, "left_anti")
    values = seen.unionByName(only).distinct().select(key, F.lit("communicate_value").alias("kind"), F.array().cast("array<string>").alias("subject"), "value")
    return kept.unionByName(values)


def _normal(v: Any) -> tuple[str, str]:
    if v is None:
        return "none", ""
    if isinstance(v, bool):
        return "bool", str(v).lower()
    if isinstance(v, (int, float)):
        return "number", str(Decimal(str(v)).normalize()) if v == v and abs(v) != float("inf") else repr(v)
    return ("string", v) if isinstance(v, str) else ("mapping" if isinstance(v, dict) else "sequence", "")


def leaf_rows(df: DataFrame, key: str, doc: str) -> DataFrame:
    """``key, path, vtype, value`` of every leaf of a JSON document, empty objects and lists too.

    Values are tagged with their type, so true, 1 and "1" differ and 1.50 and
    1.5 don't.  A text that is no JSON is one leaf of its own; null has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for n, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    root = json.loads(text)
                except (ValueError, RecursionError):
                    root = text
                stack: list[tuple[list[str], Any]] = [([], root)]
                while stack:
                    path, v = stack.pop()
                    if v and isinstance(v, dict):
                        stack.extend(([*path, str(k)], x) for k, x in v.items())
                    elif v and isinstance(v, list):
                        stack.extend(([*path, str(k)], x) for k, x in enumerate(v))
                    else:
                        rows.append((n, path, *_normal(v)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=["key", "path", "vtype", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(doc)).mapInArrow(run, f"key {kind}, path array<string>, vtype string, value string").withColumnRenamed("key", key)


def changed_leaves(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, path, vtype, value`` of what a change must reach; a deletion has a null type.

    ``before`` and ``after`` are leaves of the same keys.  A leaf that is gone
    counts only if no leaf of the new document lies on its way or below it: a
    container that changed its shape is described by the new leaves.  For that,
    each new leaf's prefixes are listed, and the old leaf and its prefixes are
    looked up among them by equality; no range join runs.
    """
    old = before.select(key, "path", F.col("vtype").alias("t0"), F.col("value").alias("v0"))
    both = after.join(old, [key, "path"], "left")
    changed = both.filter(~(F.col("vtype").eqNullSafe(F.col("t0")) & F.col("value").eqNullSafe(F.col("v0")))).select(key, "path", "vtype", "value")
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.size(c)), lambda n: F.slice(c, F.lit(1), n))
    gone = before.join(after, [key, "path"], "left_anti").select(key, "path")
    below = after.select(key, F.explode(prefixes("path")).alias("path")).distinct()
    above = after.select(key, F.col("path").alias("prefix"))
    covered = gone.select(key, "path", F.explode(prefixes("path")).alias("prefix")).join(above, [key, "prefix"], "left_semi").select(key, "path").distinct()
    real = gone.join(below, [key, "path"], "left_anti").join(covered, [key, "path"], "left_anti")
    return changed.unionByName(real.select(key, "path", F.lit(None).cast("string").alias("vtype"), F.lit(None).cast("string").alias("value")))


def measured(targets: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """``key, matched, total, potential``: the share of target leaves that a document's leaves reach."""
    have = state.select(key, "path", F.col("vtype").alias("t"), F.col("value").alias("v"), F.lit(True).alias("there"))
    joined = targets.join(have, [key, "path"], "left")
    same = F.when(F.col("vtype").isNull(), F.col("there").isNull()).otherwise(F.col("vtype").eqNullSafe(F.col("t")) & F.col("value").eqNullSafe(F.col("v")))
    out = joined.groupBy(key).agg(F.count_if(same).alias("matched"), F.count("*").alias("total"))
    return out.withColumn("potential", F.col("matched") / F.col("total"))
