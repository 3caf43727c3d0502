"""Readers: run documents, task rows, JSON lines with line numbers, logs, flat arrays."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import subprocess
import tomllib
import types
import typing
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.curation import TIERS
from logloom.operators.datasets import flat_array_errors, supervised
from logloom.sources import files

_CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,turn_idx:int,id:string,tool_call_id:string,error:boolean,tool_calls:array<{_CALL}>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
RUN_DOCUMENT = (
    "info struct<num_trials:int,max_steps:int,max_errors:int,seed:bigint,agent_info:struct<llm:string>,user_info:struct<llm:string>,environment_info:struct<domain_name:string>>, timestamp string, "
    "tasks array<struct<id:string,user_scenario:struct<instructions:struct<reason_for_call:string,known_info:string,unknown_info:string,task_instructions:string>>,"
    "evaluation_criteria:struct<actions:array<struct<action_id:string,name:string,requestor:string,arguments:string>>,reward_basis:array<string>,communicate_info:array<string>>>>, "
    "simulations array<struct<id:string,task_id:string,trial:int,seed:bigint,duration:double,termination_reason:string,agent_cost:double,user_cost:double,"
    f"reward_info:struct<reward:double,reward_breakdown:string,db_check:struct<db_match:boolean>>,messages:array<{MESSAGE}>>>"
)
TRAJECTORY_LOG = "request_id string, run_id string, global_step int, sample_index int, rollout_index int, task_id string, reward double, termination_reason string, response_tokens bigint, messages array<struct<role:string,content:string>>"


class InputError(ValueError):
    """Input that breaks its contract; the message names the place."""


def existing(paths: Sequence[str] | str, default_glob: str = "*.json") -> list[str]:
    """The files meant: given ones (all must exist) or, for a folder, those that match, sorted."""
    if isinstance(paths, str):
        found = files.matching(f"{paths.rstrip('/')}/{default_glob}" if files.is_folder(paths) else paths)
    else:
        missing = [p for p in paths if not files.exists(p)]
        if missing:
            raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
        found = list(paths)
    if not found:
        raise FileNotFoundError(f"no input matches {paths}")
    return found


def run_documents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Run documents with the file each came from."""
    return spark.read.schema(RUN_DOCUMENT).json(list(paths), multiLine=True).withColumn("source_file", F.input_file_name())


def load_tiers(spark: SparkSession, tiers: Mapping[str, Mapping[str, Any]], folder: str) -> tuple[DataFrame, DataFrame]:
    """Simulations of all tiers with tier, temperature and source run, and the tasks (a later tier's wins).

    ``tiers`` maps a tier to its ``temperature`` and ``file``.
    """
    sims: DataFrame | None = None
    tasks: DataFrame | None = None
    for place, (tier, conf) in enumerate(tiers.items()):
        docs = run_documents(spark, [f"{folder.rstrip('/')}/{conf['file']}"])
        one = docs.select(F.explode("simulations").alias("s"), F.lit(tier).alias("tier"), F.lit(float(conf["temperature"])).alias("temperature"), F.lit(conf["file"]).alias("source_run")).select("s.*", "tier", "temperature", "source_run", F.lit(TIERS.get(tier, len(TIERS))).alias("tier_order"))
        own = docs.select(F.posexplode("tasks").alias("n", "t")).select(F.struct(F.lit(place), "n").alias("at"), "t")
        sims = one if sims is None else sims.unionByName(one)
        tasks = own if tasks is None else tasks.unionByName(own)
    if sims is None or tasks is None:
        raise InputError("no tiers")
    last = tasks.groupBy(F.col("t.id").alias("task_id")).agg(F.max_by("t", "at").alias("task")).select("task_id", "task.user_scenario", "task.evaluation_criteria")
    return sims, last


def extract_candidates(sims: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidate rows: a simulation with its task, which must exist."""
    lost = sims.join(tasks, "task_id", "left_anti").select("task_id").limit(1).collect()
    if lost:
        raise InputError(f"simulation of an unknown task {lost[0].task_id}")
    return sims.join(tasks, "task_id").select(F.col("id").alias("trajectory_id"), "task_id", "tier", "temperature", "trial", "seed", "source_run", "tier_order", F.struct(F.col("reward_info.reward").alias("reward"), F.col("reward_info.reward_breakdown").alias("reward_breakdown"), F.col("reward_info.db_check.db_match").alias("db_match"), "termination_reason", F.col("duration").alias("duration_seconds")).alias("outcome"), "messages", F.col("user_scenario.instructions").alias("task_spec"))


def audit_runs(sims: DataFrame, tasks: DataFrame, expected_trials: int) -> DataFrame:
    """``problem, task_id, trial`` of everything an evaluation must not have."""
    trial = F.lit(None).cast("int").alias("trial")
    per = sims.groupBy("task_id", "trial").agg(F.count("*").alias("k"))
    parts = [
        tasks.groupBy("task_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.lit("repeated task").alias("problem"), "task_id", trial),
        per.filter("k > 1").select(F.lit("repeated trial").alias("problem"), "task_id", "trial"),
        tasks.select("task_id").join(sims, "task_id", "left_anti").select(F.lit("task without simulations").alias("problem"), "task_id", trial),
        per.groupBy("task_id").agg(F.count("*").alias("k")).filter(F.col("k") < expected_trials).select(F.lit("missing trials").alias("problem"), "task_id", trial),
        sims.filter("termination_reason = 'infrastructure_error'").select(F.lit("infrastructure error").alias("problem"), "task_id", "trial"),
        sims.filter("reward_info.reward IS NULL OR isnan(reward_info.reward)").select(F.lit("no reward").alias("problem"), "task_id", "trial"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_clean(audit: DataFrame) -> None:
    """Raise for the first problems of an audit."""
    found = audit.limit(5).collect()
    if found:
        raise InputError("; ".join(f"{r.problem}: task {r.task_id}, trial {r.trial}" for r in found))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text, ok``: every line that isn't blank with its number (from 1) in its file.

    Files are read in blocks side by side, however large: lines are counted in
    each block and a line's number is its place in the block behind the counts
    of the file's blocks before it.  ``ok`` tells whether the line is JSON.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    counted = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = counted.select("file", "block", "first", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    placed = lines.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")
    return placed.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("ok", F.try_parse_json("text").isNotNull())


def require_json(lines: DataFrame) -> DataFrame:
    """The lines, after making sure that there are some and all are JSON."""
    bad = lines.filter(~F.col("ok")).orderBy("file", "line").limit(1).collect()
    if bad:
        raise InputError(f"{bad[0].file}:{bad[0].line}: invalid JSON")
    if lines.isEmpty():
        raise InputError("no examples")
    return lines


def trajectory_logs(spark: SparkSession, folder: str, streaming: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Trajectory logs below ``folder``, those without a reward left out.

    As a stream, the checkpoint remembers which files were read; as a batch,
    ``known(source_file)`` does.
    """
    reader = (spark.readStream if streaming else spark.read).schema(TRAJECTORY_LOG).option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "*.json")
    rows = reader.json(folder).withColumn("source_file", F.col("_metadata.file_path")).filter("reward IS NOT NULL")
    return rows.join(known.select("source_file"), "source_file", "left_anti") if known is not None and not streaming else rows


def completed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids already present in a JSON lines sink; none if it doesn't exist yet."""
    schema = "trajectory_id string"
    if not files.matching(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).filter("trajectory_id IS NOT NULL").distinct()


def store_errors(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """``error``: what a finished flat store breaks; no row for a good one.

    All its parts must be there; offsets must follow one another, labels be
    ignored or equal their ids, metadata repeat the offsets, the manifest name
    the format and the counts, and (with ``verify``) every file's SHA-256.
    """
    missing = [n for n in ("arrays", "metadata", "stats.json", "manifest.json") if not files.exists(f"{path}/{n}")]
    if missing:
        return spark.createDataFrame([(f"missing: {', '.join(missing)}",)], "error string")
    arrays, meta, manifest = spark.read.parquet(f"{path}/arrays"), spark.read.parquet(f"{path}/metadata"), files.read_json(f"{path}/manifest.json")
    lack = {"idx", "input_ids", "labels", "offset_start", "offset_end"} - set(arrays.columns)
    if lack:
        return spark.createDataFrame([(f"columns missing: {', '.join(sorted(lack))}",)], "error string")
    told = [] if (manifest.get("format_name"), manifest.get("format_version")) == ("flat_sft_arrays", 1) else ["unknown format"]
    sums = arrays.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(supervised(F.col("labels"))), F.lit(0)).alias("own")).first()
    counts = manifest.get("counts", {})
    told += [e for bad, e in ((counts.get("trajectories") != sums.n, "trajectory count differs from the manifest"), (counts.get("tokens") != sums.tokens, "token count differs from the manifest"), (sums.own == 0, "no supervised tokens")) if bad]
    if verify:
        held = {r.path: r.sha256 for r in file_records(spark, [f"{path}/arrays", f"{path}/metadata"]).select("path", "sha256").collect()}  # a row a file
        for name, wanted in sorted(manifest.get("files", {}).items()):
            have = next((v for k, v in held.items() if k.endswith(f"/{name}")), None)
            told += ["file missing: " + name] if have is None else ["SHA-256 differs: " + name] if have != wanted else []
    chained = arrays.select("idx", "offset_start", "offset_end", F.size("input_ids").alias("size"), F.lit(1).alias("here"))
    before = chained.select((F.col("idx") + 1).alias("idx"), F.col("offset_end").alias("expected"))
    gaps = chained.join(before, "idx", "left").filter(F.col("offset_start") != F.coalesce("expected", F.lit(0))).select(F.concat(F.lit("offset gap at row "), F.col("idx").cast("string")).alias("error"))
    rows = flat_array_errors(arrays, "idx", "input_ids", "labels", "offset_start", "offset_end").select(F.concat(F.lit("row "), F.col("idx").cast("string"), F.lit(": "), F.element_at("errors", 1)).alias("error"))
    own = meta.select("idx", F.col("offset_start").alias("s"), F.col("offset_end").alias("e"), "token_count", F.lit(1).alias("there"))
    agree = (F.col("s") == F.col("offset_start")) & (F.col("e") == F.col("offset_end")) & (F.col("token_count") == F.col("size"))
    differ = chained.join(own, "idx", "full").filter(~F.coalesce(agree, F.lit(False))).select(F.concat(F.lit("metadata differ at row "), F.col("idx").cast("string")).alias("error"))
    return spark.createDataFrame([(e,) for e in told], "error string").unionByName(gaps).unionByName(rows).unionByName(differ)


class TokenDataset:
    """The flat token store: rows of ``idx, input_ids, labels``; lazy, pruned, with lookup by place.

    Only its manifest is read at first: it has the number of rows.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.manifest = files.read_json(f"{path}/manifest.json")
        self.rows = spark.read.parquet(f"{path}/arrays")
        need = {"idx", "input_ids", "labels"}
        if not need <= set(self.rows.columns):
            raise InputError(f"columns missing: {sorted(need - set(self.rows.columns))}")

    def __len__(self) -> int:
        return int(self.manifest["counts"]["trajectories"])

    def __getitem__(self, i: int) -> Any:
        if isinstance(i, bool) or not isinstance(i, int):
            raise TypeError("index must be an integer")
        at = i + len(self) if i < 0 else i
        if not 0 <= at < len(self):
            raise IndexError(i)
        return self.rows.filter(F.col("idx") == at).first()

    def token_range(self) -> tuple[int, int]:
        r = self.rows.agg(F.min(F.array_min("input_ids")), F.max(F.array_max("input_ids"))).first()
        return r[0], r[1]

    def summary(self) -> dict[str, int]:
        """Rows, tokens, supervised tokens and the range of ids, in one pass."""
        ids = self.rows.agg(F.count("*").alias("rows"), F.sum(F.size("input_ids")).alias("tokens"), F.sum(supervised(F.col("labels"))).alias("supervised_tokens"), F.min(F.array_min("input_ids")).alias("least_id"), F.max(F.array_max("input_ids")).alias("most_id"))
        return ids.first().asDict()


def _fits(value: Any, kind: Any) -> bool:
    """Whether a value is of a plain type, a choice of them, or a list or mapping; a truth value is no number."""
    origin = typing.get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        return any(_fits(value, k) for k in typing.get_args(kind))
    if origin is typing.Literal:
        return value in typing.get_args(kind)
    if origin in (list, tuple):
        inner = typing.get_args(kind)
        return isinstance(value, (list, tuple)) and (not inner or all(_fits(v, inner[0]) for v in value))
    if origin is dict:
        return isinstance(value, Mapping)
    if kind in (Any, None) or not isinstance(kind, type):
        return kind is not None or value is None
    if kind in (int, float):
        return isinstance(value, (int, float) if kind is float else int) and not isinstance(value, bool)
    return isinstance(value, kind)


def strict_config(kind: type, values: Mapping[str, Any], where: str = "config") -> Any:
    """A dataclass from a mapping with exactly its fields (those with a default may be missing), each of its type; nested dataclasses too."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    missing = sorted(n for n, f in fields.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    extra = sorted(set(values) - set(fields))
    if missing or extra:
        raise InputError(f"{where}: missing keys {missing}, unexpected keys {extra}")
    hints, made = typing.get_type_hints(kind, localns={kind.__name__: kind}), dict(values)
    for name, value in values.items():
        if dataclasses.is_dataclass(hints[name]) and isinstance(value, Mapping):
            made[name] = strict_config(hints[name], value, f"{where}.{name}")
        elif not _fits(value, hints[name]):
            raise InputError(f"{where}.{name}: {value!r} is not {getattr(hints[name], '__name__', hints[name])}")
    return kind(**made)


def read_config(path: str) -> dict[str, Any]:
    """A mapping from a JSON, TOML or (where a YAML reader is installed) YAML file."""
    text = files.read_text(path)
    if path.endswith(".toml"):
        found: Any = tomllib.loads(text)
    elif path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise InputError(f"{path}: no YAML reader is installed") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise InputError(f"{path}: not a mapping")
    return found


def expand_environment(value: Any, environ: Mapping[str, str]) -> Any:
    """``${NAME}`` in texts, also inside lists and mappings; an unset name is an error."""
    import re

    if isinstance(value, str):
        names = re.findall(r"\$\{(\w+)\}", value)
        unset = [n for n in names if n not in environ]
        if unset:
            raise InputError(f"not set: {', '.join(unset)}")
        return re.sub(r"\$\{(\w+)\}", lambda m: environ[m.group(1)], value)
    if isinstance(value, Mapping):
        return {k: expand_environment(v, environ) for k, v in value.items()}
    return [expand_environment(v, environ) for v in value] if isinstance(value, list) else value


def file_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length, sha256`` of files, hashed where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def git_state(folder: str) -> dict[str, Any]:
    """Commit and whether the tree is changed; empty outside a repository."""
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False).stdout.strip()
    commit = run("rev-parse", "HEAD")
    return {"commit": commit, "dirty": bool(run("status", "--porcelain"))} if commit else {}
