"""Paths on any file system that Spark can reach: looking, reading and writing small documents, renaming."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _at(path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path as it knows it."""
    spark = SparkSession.active()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    fs, at = _at(path)
    return bool(fs.exists(at))


def is_folder(path: str) -> bool:
    fs, at = _at(path)
    return bool(fs.exists(at)) and bool(fs.getFileStatus(at).isDirectory())


def matching(pattern: str) -> list[str]:
    """All paths that a pattern matches, sorted."""
    fs, at = _at(pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def read_text(path: str) -> str:
    """A small document."""
    fs, at = _at(path)
    stream = fs.open(at)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A small document, put in its place whole."""
    fs, at = _at(path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_json(path: str) -> Any:
    return json.loads(read_text(path))


def rename(old: str, new: str) -> None:
    """Fails if ``new`` is there or the file system refuses."""
    fs, at = _at(old)
    if exists(new):
        raise FileExistsError(new)
    if not fs.rename(at, _at(new)[1]):
        raise OSError(f"{old} can't be renamed to {new}")


def remove(path: str) -> None:
    fs, at = _at(path)
    fs.delete(at, True)
