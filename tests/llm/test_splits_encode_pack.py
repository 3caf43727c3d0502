import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import components, encode, packing, splits


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {frozenset(y for y in parent if find(y) == find(x)) for x in list(parent)}


@pytest.mark.parametrize("small", [0, 1000])
def test_components_match_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(components, "LEAST_HUB", 20)
    monkeypatch.setattr(components, "HUB_SHARE", 4)
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(80)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(50)] + [("self", "self"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame([*edges, (None, "a"), ("b", None)], "src string, dst string")
    groups = {}
    for r in components.components(df).collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == union_find(edges) and all(k in g for k, g in groups.items())
    assert components.components(df.limit(0)).count() == 0


TASK = "task_id string, user_id string, order_ids array<string>, derived_from string, instructions struct<known_info:string>, component string, node string"


def tasks(spark, rows):
    return spark.createDataFrame([(*r[:4], (r[4],), "x", "y") for r in rows], TASK)


def test_task_groups_over_spellings(spark):
    said = ["You are {}.", "(member: {})", "Your member name is  {} .", "Your user id is {}.", "Your member id: {}", "Member {} writes. You have placed 4 orders."]
    told = [(str(50 + i), "guest", [], None, "You do not recall it. " + text.format(name)) for i, (text, name) in enumerate(zip(said, ["mo_ka_221", "Mo Ka 221", "MO-KA-221", "mo_ka_221", "mo ka 221", "mo_ka_221"], strict=True))]
    got = {r.task_id: r.group_task_id for r in splits.task_groups(tasks(spark, told)).collect()}
    assert got == {str(50 + i): "50" for i in range(len(said))}
    rows = [
        ("10", "Ann_Bee-Cee_100", None, None, None), ("2", "guest", [], None, "x. You are ann beecee 100 ."), ("3", None, ["#W-00000012", None], None, None), ("004", "N/A", None, None, "It concerns w00000012."), ("5", "", None, "task 3", None),
        ("6", "guest", ["#W00000000"], "", "You have 3 orders."), ("7", "unknown", ["#W00000000"], None, None), ("8", "kim_po_1", None, "0009", None), ("8", "lee_ra_2", None, None, None), ("9", "lee ra 2", None, None, None), (None, "lee_ra_2", None, None, None),
    ]
    got = {r.task_id: r.group_task_id for r in splits.task_groups(tasks(spark, rows)).collect()}
    assert got == {"10": "2", "2": "2", "3": "3", "4": "3", "5": "3", "6": "6", "7": "7", "8": "8", "9": "8"}
    assert splits.task_groups(tasks(spark, [])).count() == 0


def test_splits_keep_groups_and_shares(spark):
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = [(f"m{i}", "big" if i < 300 else f"g{i // 2}") for i in range(1500)]
    got = {r.m: r["split"] for r in splits.assign_splits(spark.createDataFrame([*rows, *rows[:5], ("n", None)], "m string, g string"), "m", "g", shares).collect()}
    assert set(got) == {m for m, _ in rows}
    by = {}
    for m, g in rows:
        assert by.setdefault(g, got[m]) == got[m]
    for name, share in shares.items():
        assert abs(sum(v == name for v in got.values()) / 1500 - share) < 0.03
    empty = spark.createDataFrame([], "m string, g string")
    assert splits.assign_splits(empty, "m", "g", shares).count() == 0
    assert {r["split"] for r in splits.assign_splits(spark.createDataFrame(rows, "m string, g string"), "m", "g", {"a": 1.0, "b": 0.0}).collect()} == {"a"}


TEXTS = st.text(alphabet=st.sampled_from(list("aäbZ 'sdrevlmt019.,;-_#  \n\r\t 　 é️中文。ไทย🙂\x1c\x85<|endoftext|>")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS | st.text(max_size=40))
def test_fragments_encode_like_the_whole(text):
    own = encode.encoder(encode.tokenizer_path())
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert own.one(text) == own.whole.encode_ordinary(text)
    assert b"".join(own.fragments(text.encode())) == text.encode() if text else True


def test_encoding_rows(spark, monkeypatch):
    monkeypatch.setattr(encode, "SLICE_BYTES", 50)
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello <|endoftext|> world", None), (4, "word " * 50_000, "d"), (None, "x", "e"), (3, "Hello <|endoftext|> world", "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    own = encode.encoder(encode.tokenizer_path())
    got = encode.encode(df, "text").collect()
    assert sorted((str(r.doc_id), str(r.extra), list(r.ids)) for r in got) == sorted((str(i), str(x), own.whole.encode_ordinary(t) if t else []) for i, t, x in rows)
    assert {(r.doc_id, r.n_tokens) for r in encode.token_counts(df, "doc_id", "text").collect()} == {(r.doc_id, len(r.ids)) for r in got}
    assert encode.encode(df.limit(0), "text").count() == 0
    assert encode.encode(df, "text", "extra").columns == ["doc_id", "extra"]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken"])
def test_another_vocabulary(name):
    own = encode.encoder(encode.tokenizer_path(name))
    for text in ("Grüße, 日本語の文。 it's   fine\n\n ok", "ไทย ครับ 12,345", " \n"):
        assert own.one(text) == own.whole.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_a_block_never_overfills(sizes):
    sizes = sorted(sizes, reverse=True)
    to = packing.pack_block(sizes, 64, 0)
    best = packing.best_block(sizes, 64)
    assert len(set(best)) <= len(set(to)) and all(sum(n for n, c in zip(sizes, best, strict=True) if c == k) <= 64 for k in set(best))
    fill = {}
    for n, c in zip(sizes, to, strict=True):
        fill[c] = fill.get(c, 0) + n
    assert all(v <= 64 for v in fill.values()) and sum(v <= 32 for v in fill.values()) <= 1


def test_packing_covers_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 4000)
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 5, 30, 99, 100, 200, 250])) for i in range(800)] + [(900, None), (901, -3), (902, 1_000_037), (None, 7), (5, 12)]
    df = spark.createDataFrame(rows, "k bigint, n int").withColumn("row", F.lit("clash")).withColumn("part", F.lit("clash"))
    got = packing.pack(df, "k", "n", 100).collect()
    fill, per = {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        per.setdefault(r.k, []).append((r.part, r.start, r.n_tokens))
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(max(n or 0, 0) for _, n in rows)
    assert set(per) == {k for k, _ in rows} and [p[2] for p in sorted(per[902])] == [100] * 10_000 + [37]
    assert all(len(per[k]) == 1 for k, n in rows if k not in (5, 902) and (n or 0) <= 100)
    assert sum(fill.values()) / (100 * len(fill)) > 0.97
    assert packing.pack(df.limit(0), "k", "n", 100).count() == 0
    again = packing.pack(df.orderBy(F.rand(1)).repartition(5), "k", "n", 100).collect()
    assert sorted(again, key=str) == sorted(got, key=str)
