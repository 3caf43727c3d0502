"""Sessions, input tables and intermediate results that outlive an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: dict[str, SparkSession] = {}
_bucketed: dict[str, str] = {}


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what ``spark.checkpoint.dir`` names.

    Only where the session names none and runs on one machine (tests) a local
    folder is made and set; a cluster without one is an error, since each
    executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_by_hand.get() if set_by_hand.isDefined() else None
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="logloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as each ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "t", by: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what came
    before, and readers of the result still prune columns.  ``by`` are columns
    to bucket the rows by, as many buckets as a shuffle has partitions: joins
    and aggregations on them then read the table where it lies.  ``parts`` are
    columns whose values get folders of their own.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{scratch_dir(spark)}/logloom/{own}"
    if by:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        with _freeing(spark):
            df.repartition(n, *by).write.format("parquet").option("path", path).bucketBy(n, *by).saveAsTable(f"logloom_{own}")
        _bucketed[path] = f"logloom_{own}"
        out = spark.table(_bucketed[path])
    else:
        with _freeing(spark):
            df.write.parquet(path, partitionBy=list(parts) or None)
        out = spark.read.schema(df.schema).parquet(path)
        out = out.select(*df.columns) if parts else out
    _written[path] = spark
    out._logloom_path = path  # type: ignore[attr-defined]
    return out


def gather(frames: Iterable[DataFrame], name: str = "t") -> DataFrame:
    """All rows of ``frames`` (one at least, of one schema) as one written table, with ``part``, the number of the frame.

    They are written one after another, and each one's shuffle files are gone
    before the next is asked for, so that only one's are on disk at a time.
    """
    path = ""
    for i, df in enumerate(frames):
        path = path or shared_path(df.sparkSession, name)
        with _freeing(df.sparkSession):
            df.write.parquet(f"{path}/part={i}")
    out = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
    out._logloom_path = path  # type: ignore[attr-defined]
    return out


def stored(df: DataFrame) -> int:
    """Bytes of what ``materialize`` or ``gather`` wrote for ``df``."""
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(df._logloom_path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def drop_part(df: DataFrame, column: str, value: int) -> None:
    """Delete one folder of what ``materialize`` wrote with ``parts``; ``df`` must not read it again."""
    _delete(df.sparkSession, f"{df._logloom_path}/{column}={value}")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, not written yet; what is there goes with the session."""
    path = f"{scratch_dir(spark)}/logloom/{name}_{uuid.uuid4().hex[:12]}"
    _written[path] = spark
    return path


def drop(*frames: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these frames."""
    for df in frames:
        path = getattr(df, "_logloom_path", None)
        if path and path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _bucketed:
        spark.sql(f"DROP TABLE IF EXISTS `{_bucketed.pop(path)}`")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder is the cluster's
            pass
    _written.clear()


def task_number(col: Column) -> Column:
    """A task id as a plain number: padding, blanks and leading zeros go."""
    digits = F.regexp_extract(col, r"(\d+)", 1)
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(digits != "", plain)


def latest(df: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """The row with the greatest ``newest`` of each key, as one hash aggregation.

    Rows whose ``newest`` is null lose against any other; among equal ones the
    greatest by all their columns that can be ordered wins, so repeated rows
    give one.  Empty input gives an empty result.  No window: partial
    aggregation shrinks a hot key before the shuffle.
    """
    order = F.struct(F.col(newest).isNotNull(), F.col(newest), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
