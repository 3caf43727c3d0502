"""Writers: JSON, CSV, Markdown, flat arrays, staged publishing, appending and side outputs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.datasets import flat_array_errors, offsets, supervised
from logloom.sources import files
from logloom.sources.readers import InputError, file_records


def write_json(path: str, value: Any) -> None:
    """One small document, readable, with a newline at its end."""
    files.write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] | None = None) -> None:
    """One object a line; with ``order``, parts follow one another in it."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header, also for no rows."""
    (df.coalesce(1) if df.isEmpty() else df).write.option("header", "true").option("sep", sep).csv(path)


def write_union_csv(frames: Sequence[DataFrame], path: str) -> None:
    """Rows of frames with different columns; columns in the order first seen; no rows at all is an error."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if df.isEmpty():
        raise InputError("no rows to write")
    df.write.option("header", "true").csv(path)


def publish(path: str, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> None:
    """Write beside ``path``, check, then rename; an existing output is never touched, a failed one leaves nothing."""
    if files.exists(path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:12]}"
    try:
        write(staging)
        if check:
            check(staging)
        files.rename(staging, path)
    except BaseException:
        files.remove(staging)
        raise


# Fixed values of the store's manifest.
STORE_NAME, STORE_VERSION = "flat_sft_arrays", 1


def write_flat_arrays(df: DataFrame, path: str, order: str, expected: Mapping[str, int] | None = None, keep: Sequence[str] = (), source: Mapping[str, Any] | None = None) -> dict[str, int]:
    """The flat store: ``arrays`` with ids and labels by place, ``metadata`` with offsets and the columns ``keep``, ``stats.json`` and ``manifest.json``.

    ``order`` is the place, from 0.  ``expected`` (rows, tokens) is the scan's
    contract; if the data differ, or a row breaks the store's rules, nothing is
    published.  The manifest has counts, ``source`` and the SHA-256 of every
    data file; it is written last.
    """
    sized = df.select(order, *keep, "input_ids", "labels", F.size("input_ids").cast("long").alias("token_count"), supervised(F.col("labels")).cast("long").alias("supervised_tokens"))
    placed = offsets(sized, order, "token_count").withColumnRenamed(order, "idx")
    totals = sized.agg(F.count("*").alias("rows"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("supervised_tokens"), F.lit(0)).alias("supervised_tokens"), F.min("token_count").alias("least"), F.max("token_count").alias("most")).first().asDict()
    counts = {k: totals[k] for k in ("rows", "tokens")}
    if expected and dict(expected) != counts:
        raise InputError(f"scan said {dict(expected)}, data have {counts}")
    bad = flat_array_errors(placed, "idx", "input_ids", "labels", "offset_start", "offset_end").limit(1).collect()
    if bad:
        raise InputError(f"row {bad[0][0]}: {bad[0].errors[0]}")

    def write(at: str) -> None:
        ranged = placed.repartitionByRange("idx").sortWithinPartitions("idx")
        ranged.select("idx", "input_ids", "labels", "offset_start", "offset_end").write.parquet(f"{at}/arrays")
        files.write_text(f"{at}/stats.json", json.dumps(totals, indent=2) + "\n")
        ranged.select("idx", *keep, "offset_start", "offset_end", "token_count", "supervised_tokens").write.parquet(f"{at}/metadata")
        sums = {r.path.rsplit(at.rsplit("/", 1)[1] + "/", 1)[1]: r.sha256 for r in file_records(df.sparkSession, [f"{at}/arrays", f"{at}/metadata"]).select("path", "sha256").collect()}  # a row a file
        write_json(f"{at}/manifest.json", {"format_name": STORE_NAME, "format_version": STORE_VERSION, "counts": {"trajectories": totals["rows"], "tokens": totals["tokens"]}, "files": sums, **(source or {})})

    publish(path, write)
    return counts


def append_finished(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; with ``completed_ids`` a broken run goes on where it stopped."""
    df.write.mode("append").json(path)


def append_stream(df: DataFrame, path: str, checkpoint: str) -> Any:
    """Append each micro-batch of a stream once, however often it is tried."""
    return df.writeStream.foreachBatch(lambda part, n: part.write.mode("overwrite").json(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_table(df: DataFrame, path: str, step: int) -> None:
    """Metric rows of one step; writing a step again replaces it."""
    df.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def split_errors(df: DataFrame, path: str, failed: str) -> None:
    """Good rows and failed attempts in folders of their own; failed ones carry no reward."""
    df.filter(F.col("termination_reason") != failed).write.json(f"{path}/trajectories")
    df.filter(F.col("termination_reason") == failed).drop("reward").write.json(f"{path}/infrastructure_errors")


def token_audit(tokens: DataFrame, path: str) -> None:
    """Tokens with id, label and loss as tab-separated text."""
    write_csv(tokens, path, "\t")


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """A table of few rows; bars are escaped, null is empty."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def markdown_report(title: str, parts: Mapping[str, DataFrame], most: int = 50) -> str:
    """A report of small result tables; at most ``most`` rows of each are shown, and how many there are is told."""
    out = [f"# {title}\n"]
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        more = f"\nOnly the first {most} rows are shown.\n" if len(rows) > most else ""
        out.append(f"## {name}\n\n{markdown_table(df.columns, [tuple(r) for r in rows[:most]])}{more}")
    return "\n".join(out)


def fingerprint(value: Any) -> str:
    """SHA-256 of a document's canonical form."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def ensure_manifest(path: str, manifest: Any) -> None:
    """Write the manifest, or refuse to mix runs if another one is there."""
    if files.exists(path) and fingerprint(files.read_json(path)) != fingerprint(manifest):
        raise InputError(f"{path} belongs to a run with other settings")
    write_json(path, manifest)
