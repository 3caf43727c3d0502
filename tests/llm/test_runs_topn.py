import json
import random
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import runs, topn

CALLS = "trajectory_id string, call_id string, message_index int, call_pos int, name string, arguments string, called_at timestamp_ntz, finished_at timestamp_ntz, extra int, sig string, g string"


def calls(spark, rows):
    from datetime import datetime, timedelta

    zero = datetime(2025, 1, 1)
    full = [(t, c, m, p, n, a, zero + timedelta(seconds=m or 0), None if m is None else zero + timedelta(seconds=m + 0.5), 1, "clash", "clash") for t, c, m, p, n, a in rows]
    return spark.createDataFrame(full, CALLS)


@pytest.mark.parametrize(
    "a,b,same",
    [
        ('{"a": 1, "b": "X-1"}', '{ "b":"x 1", "a":1.0 }', True), ('{"a": "36.480"}', '{"a": 36.48}', True), ('{"a": 1e2}', '{"a": 100}', True), ('{"a": "#W1."}', '{"a": "w1"}', True),
        ('{"a": "x", "n": null, "m": "", "l": []}', '{"a": "x"}', True), (json.dumps('{"a": "x"}'), '{"a": "x"}', True), (None, "", True), ("null", "{}", True), ('{"a": ["1", "2"]}', '{"a": [1, 2.0]}', True),
        ('{"a": ["1", "2"]}', '{"a": ["2", "1"]}', False), ('{"a": ["12"]}', '{"a": ["1", "2"]}', False), ('{"a": "07755"}', '{"a": "07155"}', False), ('{"a": 1}', '{"b": 1}', False), ('{"a": "Röm"}', '{"a": "rom"}', False), ("not json", "NOT-JSON!", True),
        ('{"a": 1e-13}', '{"a": 2e-13}', False), ('{"a": 1e-13}', '{"a": 0}', False), ('{"a": -0.0}', '{"a": 0}', True), ('{"a": 123456789012345678901234567890.10}', '{"a": 1.234567890123456789012345678901e29}', True), ('{"a": 123456789012345678901234567890}', '{"a": 123456789012345678901234567891}', False),
        ('{"a": {"x": 1, "y": 1.5}}', '{"a": {"y": "1.50", "x": 1, "z": null}}', True), ('{"a": [{"x": 1.0}]}', '{"a": [{"x": 10}]}', False), ('{"a": [{"x": 1.0}]}', '{"a": [{"x": 1, "y": []}]}', True), ('{"a": [[1], 2]}', '{"a": [1, [2]]}', False),
        ('{"a": {"b": {"c": ""}}, "d": 1}', '{"d": 1.0}', True), ('{"a": "{\\"b\\": 1}"}', '{"a": {"b": 1.0}}', True), ('{"a": "{ b"}', '{"a": "B"}', True), ('{"a": "[see it] x"}', '{"a": "see it x"}', True), ('{"a": "1 e 2"}', '{"a": 100}', False), ("1.0", "1", True), ('{"a": 1, "b": {', '{"a": 1}', False),
        ('{"\\ud800": {"a": 1}}', '{"\\ud801": {"a": 2}}', False),
    ],
)
def test_arguments_as_data(spark, a, b, same):
    df = spark.createDataFrame([(0, a), (1, b)], "i int, arguments string")
    x, y = [r.s for r in runs.with_same_arguments(df, "arguments", "s").orderBy("i").collect()]
    assert x is not None and y is not None and (x == y) is same


SCALARS = st.sampled_from([None, True, "", " ", "a-B", "É1", "007", "1e2", "x,y", 0, 5, -3.50, 1e-7, "+4", "[a] b", "-"])


@settings(max_examples=1, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abc"), SCALARS | st.lists(SCALARS, max_size=3), max_size=3), min_size=300, max_size=300))
def test_flat_arguments_have_one_normal_form_either_way(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, arguments string")
    got = {r.i: r.s for r in runs.with_same_arguments(df, "arguments", "s").collect()}
    assert {i: runs.normal_text(d).strip("{}") for i, d in enumerate(json.loads(json.dumps(docs), parse_float=runs._Raw, parse_int=runs._Raw))} == got


def test_runs_match_brute_force_over_block_cuts(spark):
    rng = random.Random(2)
    rows = []
    for t in ("hot", "b", None):
        place = 0
        for i in range(400 if t == "hot" else 40):
            place += rng.choice([0, 1, 2])
            rows.append((t, f"{t}{i:04d}", place, i, "f", json.dumps({"k": rng.choice("aab")})))
    again = rows + rng.sample(rows, 60)
    df = runs.with_same_arguments(calls(spark, again), "arguments", "s")
    got = runs.collapse_runs(df, F.col("trajectory_id"), F.col("message_index"), F.col("call_pos"), F.col("call_id"), F.col("s"), F.col("called_at"), F.col("finished_at"), block=5)
    found = {(r.group, r.first_id, r.last_id, r.run_length, r.duration_seconds) for r in got.collect()}
    want = set()
    for (t, _), part in groupby(sorted(rows, key=lambda r: (str(r[0]), r[2], r[3])), key=lambda r: (r[0], r[5])):
        part = list(part)
        want.add((t, part[0][1], part[-1][1], len(part), part[-1][2] - part[0][2] + 0.5))
    assert found == want


def test_nulls_and_empty_tables(spark):
    rows = [("t", None, 0, 0, None, None), ("t", None, 1, 0, None, None), ("t", "c", None, 0, "f", "{}")]
    got = [(r.first_id, r.run_length) for r in runs.call_runs(calls(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([("c", 1), (None, 2)], key=str)
    assert runs.call_runs(calls(spark, [])).count() == 0


def test_top_n_matches_brute_force_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + list("abcd") + [None]), rng.choice([None, 1, 2, 3]), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, score int, local int").repartition(7)
    got = {(r.g, r.id, r.position) for r in topn.top_n(df, F.col("g"), [F.col("score").desc_nulls_last(), F.col("id").asc()], 5).collect()}
    want = set()
    for g in ("hot", *"abcd"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want |= {(g, r[0], n) for n, r in enumerate(mine[:5], 1)}
    assert got == want


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "g string, v int")
    assert topn.top_n(df, F.col("g"), [F.col("v").asc()], 9).count() == 3
    assert topn.top_n(df, F.col("g"), [F.col("v").asc()], 0).count() == 0
    assert topn.top_n(df, F.col("g"), [F.col("v").asc()], F.when(F.col("g") == "a", 1)).count() == 1
    assert topn.top_n(df.limit(0), F.col("g"), [F.col("v").asc()], 3).count() == 0
    odd = df.withColumn("position", F.lit(-1)).withColumn("__group", F.lit("x")).withColumn("__n", F.lit("y")).withColumn("a.b", F.lit("z")).withColumn("__row", F.lit("r"))
    got = topn.top_n(odd, F.col("g"), [F.col("v").asc()], 1).collect()
    assert {(r.g, r.position, r["__group"], r["__n"], r["a.b"], r["__row"]) for r in got} == {("a", 1, "x", "y", "z", "r"), ("b", 1, "x", "y", "z", "r")}
