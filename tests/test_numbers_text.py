from math import comb

import pytest
from pyspark.sql import functions as F

from logloom.functions import numbers as nu
from logloom.functions import registry
from logloom.functions import text as tx


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("n,c", [(4, 2), (4, 4), (4, 0), (1, 1), (30, 17)])
def test_pass_hat_k(spark, n, c):
    for k in (1, 2, 3, 4):
        got = one(spark, nu.pass_hat_k(F.lit(n), F.lit(c), k))[0]
        assert got is None if n < k else got == pytest.approx(comb(c, k) / comb(n, k))


def test_length_bins_have_closed_edges(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (4096, 4097, 8193, 16384, 16385)], "n int").select(nu.length_bin(F.col("n"))).collect()]
    assert got == ["00000-04096", "04097-08192", "08193-12288", "12289-16384", ">16384"]


def test_round_up_and_ratio(spark):
    assert tuple(one(spark, nu.round_up(F.lit(16904), 512), nu.round_up(F.lit(17000), 512, 17100), nu.ratio(F.lit(1), F.lit(0)), nu.ratio(F.lit(None).cast("int"), F.lit(2)))) == (17408, 17100, 0.0, 0.0)


def test_success_tolerance(spark):
    assert tuple(one(spark, nu.is_successful(F.lit(1.0000005)), nu.is_successful(F.lit(0.99)), nu.is_successful(F.lit(None).cast("double")))) == (True, False, None)


def test_normalized_errors(spark):
    rows = [("Error: Order #W123 with 1234567  not FOUND",), ("",), (None,), ("x" * 500,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.normalize_error(F.col("t"))).collect()]
    assert got == ["order <order_id> with <id> not found", "unspecified tool error", "unspecified tool error", "x" * 240]


def test_tool_families(spark):
    names = ["find_x", "modify_y", "calculate", "transfer_to_human_agents", "think"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.tool_family(F.col("n"))).collect()]
    assert got == ["read", "write", "utility", "transfer", "other"]


def test_ngrams_and_jaccard(spark):
    a, b = tx.word_ngrams(tx.words(F.lit("The cat, the CAT the cat"))), tx.word_ngrams(tx.words(F.lit("hi there")))
    r = one(spark, a, b, tx.jaccard(a, b), tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert r[0] == ["the cat the", "cat the cat"] and sorted(r[1]) == ["hi", "there"] and r[2] == 0.0 and r[3] == 1.0


@pytest.mark.parametrize("a,b,at", [("abc", "abd", 2), ("abc", "abc", None), ("", "x", 0), ("abc", "abcd", 3), (None, "a", None), ("x" * 40_000 + "a", "x" * 40_000 + "b", 40_000)])
def test_first_difference(spark, a, b, at):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(tx.first_difference(F.col("a"), F.col("b"))).first()[0]
    assert got == at


def test_canonical_json(spark):
    assert tuple(one(spark, tx.canonical_json(F.lit('{"b": 1, "a": [1.50, null]}')), tx.canonical_json(F.lit("no")), tx.json_object_in(F.lit('x {"a":1} y')), tx.json_object_in(F.lit("none")))) == ('{"a":[1.5,null],"b":1}', None, '{"a":1}', None)


def test_task_order(spark):
    rows = [("10",), ("9",), ("x",), (None,), ("a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").orderBy(*tx.task_order(F.col("t"))).collect()]
    assert got == ["9", "10", "a", "x", None]


def test_registry_passes_what_is_declared(spark):
    @registry.register("test_scaled")
    def scaled(df, factor=1):
        return df.select((F.col("id") * factor).alias("v"))

    assert registry.call("test_scaled", spark.range(2), factor=3, other=1).agg(F.sum("v")).first()[0] == 3
    with pytest.raises(KeyError):
        registry.call("nobody", spark.range(1))
    with pytest.raises(ValueError):
        registry.register("test_scaled")(lambda df: df)
