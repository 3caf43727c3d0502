"""Places in an order without a window over everything: running sums and positions.

A global window would gather all rows in one task, and a window over a hot
group much of them.  Here rows are spread by range, each partition is summed by
itself and the partitions' sums (one row each and group) are added up, so only
as many rows meet as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import materialize


def group_running_sum(df: DataFrame, group: Column | None, order: Sequence[Column], value: Column, out: str, piece: int = 1 << 16) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the group's rows up to and with each row.

    ``order`` must tell rows apart.  Null values count as 0; a null group is a
    group of its own.  Rows are written once, sorted by range; a partition is
    then cut into pieces of ``piece`` rows by place, and only pieces' sums are
    windowed over a whole group.
    """
    keyed = df.select("*", (group if group is not None else F.lit(0)).alias("__g"), F.coalesce(value, F.lit(0)).alias("__v"))
    spread = keyed.repartitionByRange(F.col("__g").asc(), *order).sortWithinPartitions(F.col("__g").asc(), *order)
    placed = materialize(spread.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__piece", F.floor(F.col("__at") / piece))
    sums = placed.groupBy("__g", "__piece").agg(F.sum("__v").alias("__s"))
    w = Window.partitionBy("__g").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("__g").alias("__g2"), F.col("__piece").alias("__piece2"), F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__g", "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("__in", F.sum("__v").over(inside))
    joined = summed.join(before, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__piece") == F.col("__piece2")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__in")).alias(out))


def group_positions(df: DataFrame, group: Column | None, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Adds ``out``: the row's place (from 1) in its group."""
    return group_running_sum(df, group, order, F.lit(1).cast("long"), out)
