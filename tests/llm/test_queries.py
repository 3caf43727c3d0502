import os

import duckdb
import pytest

from logloom.llm import neardup, queries, varied
from logloom.session import gather, materialize


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    df = queries.queries()[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name,columns", [("p2_found", ["trajectory_a", "trajectory_b"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "start_char", "end_char"]), ("p1_retries", None), ("p8_large", None), ("p6_splits", ["task_id", "split"])])
def test_queries_run_over_whole_tables(spark, sf, name, columns):
    df = queries.queries()[name](spark, sf)
    assert df.count() > 0 and (columns is None or df.columns == columns)


def test_the_subset_has_the_asked_size(spark, sf):
    got = queries.p4_subset(spark, sf).collect()
    con = duckdb.connect()
    accepted = con.execute(f"select count(*) from (select semantic_screening.decision as d, row_number() over (partition by trajectory_id order by ingested_at desc) rn from '{sf}/candidates.parquet') where rn = 1 and d = 'accepted'").fetchone()[0]
    assert len(got) == len({r.trajectory_id for r in got}) == int(accepted * 0.25 + 0.5)


def test_word_runs_and_traces_are_never_broadcast(spark, sf, monkeypatch):
    sent = []

    def look(node):
        if node.nodeName() == "BroadcastHashJoin":
            sent.append((node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).schema().simpleString())
        for i in range(node.children().size()):
            look(node.children().apply(i))

    def noted(df, *args, **kw):
        look(df._jdf.queryExecution().sparkPlan())
        return materialize(df, *args, **kw)

    def gathered(frames, *args):
        return gather((look(df._jdf.queryExecution().sparkPlan()) or df for df in frames), *args)

    for module in (neardup, varied):
        monkeypatch.setattr(module, "materialize", noted)
    monkeypatch.setattr(neardup, "gather", gathered, raising=False)
    queries.p4_subset(spark, sf)
    assert sent and not [x for x in sent if "array" in x]
