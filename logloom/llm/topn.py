"""The first N items of every group, exact even where one group is most of the data.

One range-partitioned sort on group, score and identifier spreads a large group
over many tasks.  A pass over each sorted partition numbers the rows of each
group and drops those beyond N; what is left of a group in a partition is
counted, the counts are prefix-summed in partition order, and sum plus local
place is a row's exact position.  No task ever holds a whole large group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(keep: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__group")
            same = np.zeros(batch.num_rows, bool)
            if batch.num_rows > 1:
                same[1:] = np.asarray(pc.equal(key.slice(1), key.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False), bool)
            starts = np.flatnonzero(~same)
            local = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows))) + 1
            if key[0].as_py() == last:
                local[: starts[1] if len(starts) > 1 else None] += have
            last, have = key[batch.num_rows - 1].as_py(), int(local[-1])
            kept = local <= batch.column(keep).to_numpy(zero_copy_only=False)
            out = batch.append_column(pa.field("__local", pa.int64()), pa.array(local))
            yield out.filter(pa.array(kept))

    return run


def _free(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name += "_"
    return name


def top_n(df: DataFrame, group: Column, order: Sequence[Column], n: int | Column) -> DataFrame:
    """Rows of ``df`` that are among the first ``n`` of their group, with ``position`` (from 1).

    ``order`` are sort expressions; they should end in an identifier, else rows
    that tie in all of them may swap places.  Rows with a null group are left
    out, rows with a null ``n`` too; repeated rows count as often as they
    occur; ``n`` may be a column, equal within a group.  All columns of the
    input are kept, whatever their names; only one called ``position`` gives
    way to the new one.  Empty input gives an empty result.
    """
    kept = [c for c in df.columns if c != "position"]
    grp, most = _free("__group", df.columns), _free("__n", df.columns)
    keyed = df.select("*", group.cast("string").alias(grp), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias(most))
    keyed = keyed.filter(F.col(grp).isNotNull() & (F.col(most) > 0))
    spread = keyed.repartitionByRange(F.col(grp).asc(), *order).sortWithinPartitions(F.col(grp).asc(), *order)
    packed = spread.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), F.col(grp).alias("__group"), F.col(most).alias("__n"), F.spark_partition_id().alias("__part"))
    schema = T.StructType([*packed.schema.fields, T.StructField("__local", T.LongType())])
    local = packed.mapInArrow(_number("__n"), schema).repartition("__group")
    by_part = Window.partitionBy("__group", "__part")
    before = Window.partitionBy("__group").orderBy("__part", "__local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At a group's first row of a partition stands that partition's count; the sum up to here, less the own one, is what lies before.
    counted = local.withColumn("__count", F.max("__local").over(by_part))
    summed = F.sum(F.when(F.col("__local") == 1, F.col("__count")).otherwise(0)).over(before) - F.col("__count")
    placed = counted.withColumn("__at", (summed + F.col("__local")).cast("long"))
    return placed.filter(F.col("__at") <= F.col("__n")).select(*[F.col("__row")[c].alias(c) for c in kept], F.col("__at").alias("position"))
