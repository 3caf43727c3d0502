import json

import pytest
from pyspark.sql import functions as F

from logloom.operators import judging
from logloom.sinks import writers
from logloom.sources import readers
from logloom.streaming import progress, windows


def document(task="1", trials=(0, 1), reward=1.0):
    sims = [{"id": f"s{task}{t}", "task_id": task, "trial": t, "termination_reason": "user_stop", "duration": 1.5, "reward_info": {"reward": reward, "db_check": {"db_match": True}}, "messages": [{"role": "user", "content": "x"}]} for t in trials]
    return {"info": {"num_trials": 2}, "tasks": [{"id": task, "user_scenario": {"instructions": {"reason_for_call": f"why {reward}"}}}], "simulations": sims}


def test_tiers_candidates_and_audit(spark, tmp_path):
    for name, doc in (("a.json", document(reward=0.0)), ("b.json", document(trials=(0,)))):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    sims, tasks = readers.load_tiers(spark, {"low": {"temperature": 0.2, "file": "a.json"}, "high": {"temperature": 1, "file": "b.json"}}, str(tmp_path))
    assert sims.count() == 3 and tasks.first().user_scenario.instructions.reason_for_call == "why 1.0"
    assert readers.extract_candidates(sims, tasks).filter("tier = 'high'").first().outcome.reward == 1.0
    problems = {r.problem for r in readers.audit_runs(sims.filter("tier = 'high'"), tasks, 2).collect()}
    assert problems == {"missing trials"}
    with pytest.raises(readers.InputError, match="missing trials: task 1"):
        readers.require_clean(readers.audit_runs(sims.filter("tier = 'high'"), tasks, 2))
    readers.require_clean(readers.audit_runs(sims.filter("tier = 'low'"), tasks, 2))
    with pytest.raises(readers.InputError, match="unknown task"):
        readers.extract_candidates(sims, tasks.filter("false"))


def test_json_lines_name_the_bad_line(spark, tmp_path):
    (tmp_path / "data.jsonl").write_text('{"a": 1}\n\nnot-json\n')
    lines = readers.json_lines(spark, str(tmp_path / "data.jsonl"))
    assert [(r.line, r.ok) for r in lines.orderBy("line").collect()] == [(1, True), (3, False)]
    with pytest.raises(readers.InputError, match="data.jsonl:3"):
        readers.require_json(lines)
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(readers.InputError, match="no examples"):
        readers.require_json(readers.json_lines(spark, str(tmp_path / "none.jsonl")))


def test_config_paths_and_manifest(spark, tmp_path):
    from dataclasses import dataclass

    @dataclass
    class Conf:
        a: int
        b: int = 2

    assert readers.strict_config(Conf, {"a": 1}) == Conf(1)
    with pytest.raises(readers.InputError, match="unexpected keys \\['c'\\]"):
        readers.strict_config(Conf, {"a": 1, "c": 2})
    assert readers.expand_environment({"k": ["${X}/y"]}, {"X": "z"}) == {"k": ["z/y"]}
    with pytest.raises(readers.InputError):
        readers.expand_environment("${X}", {})
    with pytest.raises(FileNotFoundError):
        readers.existing([str(tmp_path / "no.json")])
    path = str(tmp_path / "m.json")
    writers.ensure_manifest(path, {"a": 1, "b": "é"})
    writers.ensure_manifest(path, {"b": "é", "a": 1})
    with pytest.raises(readers.InputError):
        writers.ensure_manifest(path, {"a": 2})


def test_flat_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, [10, 11, 12], [-100, 11, 12]), (1, [20, 21], [-100, 21])], "i int, input_ids array<int>, labels array<int>")
    out = str(tmp_path / "store")
    with pytest.raises(readers.InputError, match="scan said"):
        writers.write_flat_arrays(df, out, "i", {"rows": 2, "tokens": 9})
    assert writers.write_flat_arrays(df, out, "i", {"rows": 2, "tokens": 5}) == {"rows": 2, "tokens": 5}
    store = readers.TokenDataset(spark, out)
    assert len(store) == 2 and store[-1].input_ids == [20, 21] and store[-1].offset_start == 3 and store.token_range() == (10, 21)
    with pytest.raises(IndexError):
        store[2]
    with pytest.raises(TypeError):
        store[True]
    with pytest.raises(FileExistsError):
        writers.write_flat_arrays(df, out, "i")


def test_publish_leaves_nothing_behind(spark, tmp_path):
    def fail(p):
        spark.range(1).write.parquet(p)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writers.publish(str(tmp_path / "o"), fail)
    assert list(tmp_path.iterdir()) == []


def test_tables_as_text(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([], "a int, b string"), str(tmp_path / "e"))
    assert next((tmp_path / "e").glob("*.csv")).read_text() == "a,b\n"
    writers.write_union_csv([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")], str(tmp_path / "u"))
    assert spark.read.csv(str(tmp_path / "u"), header=True).columns == ["a", "b"]
    with pytest.raises(readers.InputError):
        writers.write_union_csv([spark.createDataFrame([], "a int")], str(tmp_path / "v"))
    assert writers.markdown_table(["x"], [["a|b"], [None]]) == "| x |\n|---|\n| a\\|b |\n|  |\n"
    assert "Only the first 50" in writers.markdown_report("T", {"P": spark.range(60)})
    writers.log_table(spark.range(2), str(tmp_path / "m"), 3)
    writers.log_table(spark.range(5), str(tmp_path / "m"), 3)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 5


def test_resuming_skips_what_is_done(spark, tmp_path):
    out = str(tmp_path / "j")
    df = judging.judge_messages(spark.createDataFrame([("a", ["m"], False), ("b", [], False)], "trajectory_id string, messages array<string>, bad boolean"))
    assert readers.completed_ids(spark, out + "/*.json").count() == 0
    answers = judging.judge(df, judging.strict_stub).withColumn("bad", F.lit(False))
    got = {r.trajectory_id: r.decision for r in judging.decide(answers, "bad").collect()}
    assert got == {"a": "accepted", "b": "rejected"}
    writers.append_finished(answers.filter("trajectory_id = 'a'"), out)
    pending = df.join(readers.completed_ids(spark, out + "/*.json"), "trajectory_id", "left_anti")
    assert [r.trajectory_id for r in pending.collect()] == ["b"]

    def broken(_):
        raise judging.JudgeError("busy")

    assert {r.error for r in judging.judge(df, broken).collect()} == {"busy"}


def test_streams_of_logs(spark, tmp_path):
    logs = tmp_path / "logs" / "step"
    logs.mkdir(parents=True)
    (logs / "1.json").write_text(json.dumps({"request_id": "r1", "task_id": "1", "reward": 1.0}))
    (logs / "2.json").write_text(json.dumps({"request_id": "r2", "task_id": "1", "termination_reason": "infrastructure_error"}))
    assert [r.request_id for r in readers.trajectory_logs(spark, str(tmp_path / "logs")).collect()] == ["r1"]
    out, point = str(tmp_path / "out"), str(tmp_path / "cp")
    for extra in (None, "3"):
        if extra:
            (logs / "3.json").write_text(json.dumps({"request_id": "r3", "task_id": "1", "reward": 0.0}))
        writers.append_stream(readers.trajectory_logs(spark, str(tmp_path / "logs"), streaming=True).select("request_id"), out, point).awaitTermination()
    assert sorted(r.request_id for r in spark.read.json(out).collect()) == ["r1", "r3"]


def test_stream_progress_counts_a_replay_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "rollout string, turn int, potential double, facts array<string>"
    turns = [{"rollout": "a", "turn": 0, "potential": 0.5, "facts": ["x"]}, {"rollout": "a", "turn": 1, "potential": 0.25, "facts": ["x", "y"]}]
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for n, rows in enumerate((turns, [*turns, {"rollout": "a", "turn": 2, "potential": 0.75, "facts": []}])):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = progress.rollout_progress(spark.readStream.schema(schema).json(str(src)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.turn, r.new_progress, r.new_facts) for r in spark.read.parquet(out).collect())
    assert got == [(0, 0.5, 1), (1, 0.0, 1), (2, 0.25, 0)]


def test_windows_drop_rows_that_are_too_late(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [("2025-01-01 00:05:00", 1.0), ("2025-01-01 03:00:00", 2.0), ("2025-01-01 00:10:00", 9.0), ("2025-01-01 09:00:00", 1.0)]
    out, point = str(tmp_path / "o"), str(tmp_path / "c")
    for n, (ts, v) in enumerate(lines):
        (src / f"{n}.json").write_text(json.dumps({"ts": ts, "k": "a", "v": v}))
        stream = windows.tumbling(spark.readStream.schema("ts timestamp, k string, v double").json(str(src)), "ts", "1 hour", "k", "v")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.window_start.hour, r.total) for r in spark.read.parquet(out).collect()} == {(0, 1.0), (3, 2.0)}
    batch = spark.createDataFrame(lines, "ts string, v double").selectExpr("cast(ts as timestamp) ts", "'a' k", "v")
    assert windows.sessions(batch, "ts", "4 hours", "k", "v").count() == 2


def test_configs_have_types(spark, tmp_path):
    from dataclasses import dataclass, field

    @dataclass
    class Part:
        rate: float
        names: list[str] = field(default_factory=list)

    @dataclass
    class Whole:
        n: int
        part: Part
        mode: str | None = None

    Whole.__annotations__["part"] = Part
    (tmp_path / "c.toml").write_text('n = 3\n[part]\nrate = 1\nnames = ["a"]\n')
    assert readers.strict_config(Whole, readers.read_config(str(tmp_path / "c.toml"))) == Whole(3, Part(1, ["a"]))
    for bad, said in (({"n": True, "part": {"rate": 1}}, "config.n"), ({"n": 1, "part": {"rate": "x"}}, "config.part.rate"), ({"n": 1, "part": {}}, "config.part: missing"), ({"n": 1, "part": {"rate": 1, "names": [1]}}, "config.part.names"), ({"n": 1, "part": {"rate": 1}, "mode": 3}, "config.mode")):
        with pytest.raises(readers.InputError, match=said):
            readers.strict_config(Whole, bad)
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(readers.InputError, match="not a mapping"):
        readers.read_config(str(tmp_path / "c.json"))


def test_lineage_and_analysis(spark, tmp_path):
    from logloom.sinks import lineage

    for name, doc in (("a.json", document(reward=0.0)), ("b.json", document(trials=(0, 1)))):
        (tmp_path / name).write_text(json.dumps(doc))
    out = str(tmp_path / "out")
    summary = {r.model_label: r.pass_1 for r in lineage.analyse(spark, {"old": [str(tmp_path / "a.json")], "new": [str(tmp_path / "b.json")]}, out).collect()}
    assert summary == {"old": 0.0, "new": 1.0} and spark.read.csv(f"{out}/task_rewards", header=True).count() == 2
    made = lineage.manifest(spark, "run", {"k": 1}, {"runs": str(tmp_path / "a.json")}, {"summary": f"{out}/summary"}, {"tasks": 1}, root=str(tmp_path))
    assert made["inputs"]["runs"]["path"] == "a.json" and len(made["inputs"]["runs"]["files"][0]["sha256"]) == 64 and made["versions"]["pyspark"]
    lineage.write_manifest(str(tmp_path / "m.json"), made)
    with pytest.raises(readers.InputError):
        lineage.write_manifest(str(tmp_path / "m.json"), made | {"settings_sha256": "other"})
    with pytest.raises(FileNotFoundError):
        lineage.manifest(spark, "run", {}, {"x": str(tmp_path / "none")}, {}, {})
    assert lineage.console_summary("T", {"tasks": 1200, "share": 0.5}) == "T\n  tasks  1,200\n  share  50.00%\n"
    with pytest.raises(readers.InputError):
        lineage.require_list({}, "x")
    assert lineage.require_mapping({"a": 1}, "x") == {"a": 1}


def test_reports_have_all_sections(spark, sf):
    from logloom.session import table
    from logloom.sinks import reports

    runs, calls = table(spark, sf, "trajectory_features").distinct(), table(spark, sf, "tool_calls")
    text = reports.evaluation_report(runs, calls, ["sft", "vanilla", "potential"])
    assert [x for x in text.split("\n") if x.startswith("#")] == ["# Evaluation", "## Overview", "## Pass^k", "## Transitions", "## Tasks that changed", "## Tool errors", "## Error messages"] and "| sft |" in text
    text = reports.dataset_report(table(spark, sf, "documents"), "doc_id", "kind", "n_chars")
    assert [x for x in text.split("\n") if x.startswith("#")] == ["# Dataset", "## Rows", "## Lengths", "## Bins", "## Longest", "## Shortest"] and "00000-04096" in text
    assert "## Rows" in reports.dataset_report(table(spark, sf, "documents").limit(0), "doc_id", "kind", "n_chars")
