import ast
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert all(re.fullmatch(r"[a-z]+\d*_\w+", n) for n in names)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pass_1" in df.columns


def test_only_the_entry_imports_the_training_data_operators():
    for folder, _, files in os.walk(os.path.join(HERE, "logloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not any(n.startswith("logloom.llm") for n in names), f


@pytest.mark.parametrize("name", ["agg_05_task_rewards", "flt_01_screening", "win_02_offsets", "jon_03_paired_trials", "agg_15_tool_errors"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    a, b = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    shown = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert shown(a) == shown(b)
