import json

import pytest

from logloom.operators import facts


def rows(df):
    return {(r.kind, tuple(r.subject), r.value) for r in df.collect()}


def test_facts_of_documents(spark):
    user = {"user_id": "u", "email": "e@x", "orders": ["o1"], "payment_methods": {"p1": {"source": "card"}, "p2": {"balance": 1.50}}, "name": {"first": "A"}}
    order = {"order_id": "o1", "status": "open", "user_id": "u", "items": [{"item_id": "i1", "product_id": "q", "price": 10.0, "options": {"size": "M"}}, {}], "payment_history": [{"payment_method_id": "p1"}], "fulfillments": [{"tracking_id": ["t1"]}, {}]}
    product = {"product_id": "q", "name": "N", "variants": {"i1": {"item_id": "i1", "available": True, "price": 2}}}
    data = [("k", "get_user_details", json.dumps(user)), ("k", "get_order_details", json.dumps(order)), ("k", "get_product_details", json.dumps(product)), ("k", "find_user_id_by_email", "u"), ("k", "get_user_details", "Error"), ("k", "get_item_details", None), ("k", "other", "{}")]
    got = facts.observed_facts(spark.createDataFrame(data, "key string, tool string, result string"), "key", "tool", "result")
    assert rows(got) == {
        ("user_known", ("u",), None), ("user_email", ("u",), "e@x"), ("user_order", ("u", "o1"), None), ("user_payment_method", ("u", "p1"), None), ("user_payment_method", ("u", "p2"), None), ("payment_source", ("p1",), "card"), ("payment_balance", ("p2",), "1.5"), ("user_name", ("u", "first"), "A"),
        ("order_known", ("o1",), None), ("order_status", ("o1",), "open"), ("order_user", ("o1",), "u"), ("order_item", ("o1", "i1"), None), ("order_item_product", ("o1", "i1"), "q"), ("order_item_price", ("o1", "i1"), "10"), ("order_item_option", ("o1", "i1", "size"), "M"), ("order_payment_method", ("o1", "p1"), None), ("order_tracking", ("o1", "t1"), None),
        ("product_known", ("q",), None), ("product_name", ("q",), "N"), ("product_variant_count", ("q",), "1"), ("product_item", ("q", "i1"), None), ("item_known", ("i1",), None), ("item_available", ("i1",), "true"), ("item_price", ("i1",), "2"), ("authenticated_user", ("u",), None),
    }
    actions = spark.createDataFrame([("k", json.dumps({"order_id": "o1", "item_ids": ["i1"], "other": 1})), ("k", None)], "key string, arguments string")
    refs = facts.references(actions, "key", "arguments")
    assert {(r.ref_kind, r.id) for r in refs.collect()} == {("order", "o1"), ("order_item", "i1")}
    kept = {k for k, _, _ in rows(facts.relevant_facts(got, refs, "key"))}
    assert kept == {"order_known", "order_status", "order_user", "user_order", "order_item", "order_item_product", "order_item_price", "order_item_option"}
    assert {k for k, _, _ in rows(facts.relevant_facts(got, refs, "key", before_writes=True))} == kept - {"user_order"}


@pytest.mark.parametrize(
    "old,new,want",
    [
        ({"a": 1, "b": 2}, {"a": 1.0, "b": 3}, {(("b",), "number", "3")}), ({"a": 1, "b": 2}, {"a": 1}, {(("b",), None, None)}), ({"a": {"x": 1}}, {"a": {}}, {(("a",), "mapping", "")}), ({"a": 1}, {"a": {"x": 1}}, {(("a", "x"), "number", "1")}),
        ({"a": [1, 2]}, {"a": [1]}, {(("a", "1"), None, None)}), ({"a": True}, {"a": 1}, {(("a",), "number", "1")}), ({"a": None}, {"a": None, "c": None}, {(("c",), "none", "")}),
    ],
)
def test_differences_of_documents(spark, old, new, want):
    leaves = lambda d: facts.leaf_rows(spark.createDataFrame([(1, json.dumps(d))], "k int, d string"), "k", "d")
    found = facts.changed_leaves(leaves(old), leaves(new), "k")
    assert {(tuple(r.path), r.vtype, r.value) for r in found.collect()} == want
    assert facts.measured(found, leaves(new), "k").first().potential == 1.0 and facts.measured(found, leaves(old), "k").first().matched == 0


def test_leaves_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"a": [], "b": 1e2, "c": "1e2"}')], "k int, d string")
    assert {(r.k, tuple(r.path), r.vtype, r.value) for r in facts.leaf_rows(df, "k", "d").collect()} == {(2, (), "string", "no json"), (3, ("a",), "sequence", ""), (3, ("b",), "number", "1E+2"), (3, ("c",), "string", "1e2")}
