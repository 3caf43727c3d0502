"""What a run was made from: manifests with versions, settings, inputs and counts; and the pass^k analysis as one call."""

from __future__ import annotations

import datetime
import importlib.metadata
import platform
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import evaluation as ev
from logloom.sinks import writers
from logloom.sources import files, readers


def utc_now() -> str:
    """The time in ISO form, in UTC, to the second."""
    return datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat()


def versions(names: Sequence[str] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict[str, str | None]:
    """Installed versions, null where a package is missing."""
    out: dict[str, str | None] = {"python": platform.python_version()}
    for name in names:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = None
    return out


def portable(path: str, root: str) -> str:
    """A path below ``root`` as seen from there; any other as it is."""
    base = root.rstrip("/") + "/"
    return path[len(base) :] if path.startswith(base) else path


def manifest(spark: SparkSession, name: str, settings: Mapping[str, Any], inputs: Mapping[str, str], outputs: Mapping[str, str], counts: Mapping[str, int], root: str = "", code: str = ".") -> dict[str, Any]:
    """A run's document: settings with their fingerprint, files with size and SHA-256, counts, versions, commit."""

    def told(paths: Mapping[str, str]) -> dict[str, Any]:
        out = {}
        for key, path in sorted(paths.items()):
            if not files.exists(path):
                raise FileNotFoundError(f"{key}: {path}")
            held = readers.file_records(spark, path).collect()  # a row a file
            out[key] = {"path": portable(path, root), "files": [{"name": r.path.rsplit("/", 1)[1], "bytes": r.length, "sha256": r.sha256} for r in sorted(held, key=lambda r: r.path)]}
        return out

    return {
        "name": name, "created_at": utc_now(), "settings": dict(settings), "settings_sha256": writers.fingerprint(dict(settings)), "inputs": told(inputs), "outputs": told(outputs), "counts": dict(counts), "versions": versions(), "code": readers.git_state(code),
    }


def write_manifest(path: str, document: Mapping[str, Any]) -> None:
    """Writes a run's document; one that is there must have the same settings."""
    if files.exists(path) and files.read_json(path).get("settings_sha256") != document["settings_sha256"]:
        raise readers.InputError(f"{path} belongs to a run with other settings")
    writers.write_json(path, dict(document))


def evaluated(spark: SparkSession, paths: Mapping[str, Sequence[str]]) -> DataFrame:
    """``model_label, task_id, trial, trajectory_id, reward, termination_reason, duration_seconds`` of the run documents of each policy."""
    out: DataFrame | None = None
    for label, held in paths.items():
        sims = readers.run_documents(spark, readers.existing(list(held))).select(F.explode("simulations").alias("s"))
        one = sims.select(F.lit(label).alias("model_label"), "s.task_id", "s.trial", F.col("s.id").alias("trajectory_id"), F.col("s.reward_info.reward").alias("reward"), "s.termination_reason", F.col("s.duration").alias("duration_seconds"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise readers.InputError("no policies")
    return out


def analyse(spark: SparkSession, paths: Mapping[str, Sequence[str]], folder: str) -> DataFrame:
    """The pass^k analysis of all policies: task rewards and summary as CSV below ``folder``, the summary returned."""
    rewards = ev.task_rewards(evaluated(spark, paths), ["model_label", "task_id"])
    summary = ev.dataset_summary(rewards, ["model_label"])
    writers.write_csv(rewards, f"{folder}/task_rewards")
    writers.write_csv(summary, f"{folder}/summary")
    return summary


def console_summary(title: str, values: Mapping[str, Any]) -> str:
    """Aligned lines of names and values; shares in per cent."""
    width = max([len(k) for k in values], default=0)
    shown = lambda v: f"{v:.2%}" if isinstance(v, float) and 0 <= v <= 1 else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return "\n".join([title, *(f"  {k:<{width}}  {shown(v)}" for k, v in values.items())]) + "\n"


def require_mapping(value: Any, where: str) -> Mapping[str, Any]:
    if not isinstance(value, Mapping):
        raise readers.InputError(f"{where}: not a mapping")
    return value


def require_list(value: Any, where: str) -> list[Any]:
    if not isinstance(value, list):
        raise readers.InputError(f"{where}: not a list")
    return value
