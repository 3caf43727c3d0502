"""The hook for an outside judge, with errors as a column and resuming by id."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.curation import judge_decision


class JudgeError(Exception):
    """The judge answered in a way that can't be used; anything else it raises is a fault and ends the job."""


_ANSWER = "trajectory_id string, answer string, error string"


def judge_messages(df: DataFrame) -> DataFrame:
    """Adds ``payload``: what the judge is shown, as one JSON document."""
    return df.withColumn("payload", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def judge(df: DataFrame, ask: Callable[[str], str], parallel: int | None = None) -> DataFrame:
    """``trajectory_id, answer, error`` of ``df(trajectory_id, payload)``; ``parallel`` bounds how many ask at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, payload in zip(pdf["trajectory_id"], pdf["payload"], strict=True):
                try:
                    out.append((key, ask(payload), None))
                except JudgeError as e:
                    out.append((key, None, str(e)))
            yield pd.DataFrame(out, columns=["trajectory_id", "answer", "error"])

    rows = df.select("trajectory_id", "payload")
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, _ANSWER)


def decide(answers: DataFrame, has_tool_errors: str, threshold: float = 0.8) -> DataFrame:
    """Adds the decision to judged rows; an answer without JSON or with a field that is no boolean has none."""
    checks = ["user_fidelity", "process_valid", "final_response_consistent"]
    found = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), ", ".join(f"{c} boolean" for c in [*checks, "tool_error_resolved"]) + ", confidence double, reasons array<string>")
    rows = answers.withColumn("j", found)
    whole = F.lit(True)
    for c in checks:
        whole = whole & F.col(f"j.{c}").isNotNull()
    decision = judge_decision(F.col("j.confidence"), [F.col(f"j.{c}") for c in checks], F.col("j.tool_error_resolved"), F.col(has_tool_errors), threshold)
    return rows.withColumn("decision", F.when(whole, decision)).drop("j")


def strict_stub(payload: str) -> str:
    """A judge for tests that accepts what has messages, always with the same confidence."""
    doc = json.loads(payload)
    good = bool(doc.get("messages"))
    return json.dumps({"user_fidelity": good, "process_valid": good, "final_response_consistent": good, "tool_error_resolved": good, "confidence": 0.9, "reasons": []})
