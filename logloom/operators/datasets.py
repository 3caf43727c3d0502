"""Token datasets: scan statistics, offsets, batches, padding, labels, flat-array checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.numbers import length_bin, round_up
from logloom.operators.ordering import group_positions, group_running_sum

IGNORED = -100


def numeric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, greatest, mean and percentiles with linear interpolation, exact; nulls left out."""
    v = F.col(value)
    points = [("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
    all_ = F.percentile(v, F.array(*[F.lit(p) for _, p in points])).alias("p")
    out = df.groupBy(*keys).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), all_)
    return out.select(*keys, "least", "most", "mean", *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, (n, _) in enumerate(points)])


def offsets(df: DataFrame, order: str, tokens: str) -> DataFrame:
    """``offset_start, offset_end`` of each row in the flat store, in ``order`` (unique)."""
    out = group_running_sum(df, None, [F.col(order).asc()], F.col(tokens).cast("long"), "offset_end")
    return out.withColumn("offset_start", F.col("offset_end") - F.coalesce(F.col(tokens), F.lit(0)))


def length_batches(df: DataFrame, key: str, tokens: str, batch: int, bucket: int, seed: int | None = None, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Batches of like lengths: rows by length, cut into buckets, shuffled within, cut into batches.

    Adds ``batch_id`` and, with a seed, ``batch_order`` (the order the batches
    come in).  Without a seed the order of length stays.  ``drop_last`` leaves
    out the last batch if it isn't full.
    """
    if bucket % batch:
        bucket = (bucket // batch + 1) * batch
    placed = group_positions(df, None, [F.col(tokens).asc_nulls_first(), F.col(key).asc()], "place").withColumn("bucket", F.floor((F.col("place") - 1) / bucket))
    if seed is not None:
        shuffle = [F.xxhash64(F.col(key), F.lit(seed + epoch)).asc(), F.col(key).asc()]
        placed = group_positions(placed.drop("place"), F.col("bucket"), shuffle, "in_bucket").withColumn("place", F.col("bucket") * bucket + F.col("in_bucket")).drop("in_bucket")
    out = placed.withColumn("batch_id", F.floor((F.col("place") - 1) / batch).cast("long")).drop("bucket", "place")
    if drop_last:
        total = df.count()
        out = out.filter(F.col("batch_id") < total // batch)
    return out if seed is None else out.withColumn("batch_order", F.xxhash64("batch_id", F.lit(seed + epoch)))


def padding_report(batched: DataFrame, tokens: str, multiple: int = 8) -> DataFrame:
    """Per batch: rows, width (the longest, rounded up), real and padding tokens, share of padding."""
    out = batched.groupBy("batch_id").agg(F.count("*").alias("rows"), round_up(F.max(tokens), multiple).alias("width"), F.sum(tokens).cast("long").alias("real_tokens"))
    slots = F.col("rows") * F.col("width")
    return out.select("batch_id", "rows", "width", "real_tokens", (slots - F.col("real_tokens")).alias("padding_tokens"), F.round(F.coalesce((slots - F.col("real_tokens")) / F.when(slots > 0, slots), F.lit(0.0)), 6).alias("padding_fraction"))


def pad(ids: Column, labels: Column, width: Column, pad_id: int) -> tuple[Column, Column, Column]:
    """Ids, labels and attention mask padded on the right to ``width``; too long is an error, nothing is cut."""
    n = F.size(ids)
    more = F.when(n > width, F.raise_error(F.lit("sequence longer than the batch"))).otherwise(width - n).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad_id), more)), F.concat(labels, F.array_repeat(F.lit(IGNORED), more)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), more))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds ``out``: each row's place in ``order`` (unique), from 0."""
    return group_positions(df, None, [F.col(order).asc()], "__place").withColumn(out, F.col("__place") - 1).drop("__place")


def training_length(longest: Column, multiple: int, limit: int) -> Column:
    """The longest row's length, rounded up; null where that is above the limit, since nothing is cut short."""
    rounded = round_up(longest, multiple).cast("long")
    return F.when(rounded <= limit, rounded)


def padded_batches(df: DataFrame, batch: str, tokens: str, to: int) -> DataFrame:
    """Each batch's rows, tokens, width (its longest row, rounded up to ``to``) and padding."""
    per = df.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(tokens).cast("long").alias("tokens"), round_up(F.max(tokens), to).cast("long").alias("width"))
    return per.withColumn("padding", F.col("rows") * F.col("width") - F.col("tokens"))


def supervised(labels: Column, shifted: bool = False) -> Column:
    """How many labels count (from the second on, if ``shifted``)."""
    used = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))) if shifted else labels
    return F.size(F.filter(used, lambda x: x != IGNORED))


def flat_array_errors(df: DataFrame, order: str, ids: str, labels: str, start: str, end: str) -> DataFrame:
    """Rows that break the flat store's contract, with what they break."""
    bad_label = F.exists(F.zip_with(F.col(labels), F.col(ids), lambda lab, i: (lab != IGNORED) & (lab != i)), lambda x: x)
    found = F.filter(
        F.array(
            F.when(F.size(ids) != F.size(labels), "lengths differ"), F.when(F.col(end) <= F.col(start), "offsets must be strictly increasing"), F.when(F.col(end) - F.col(start) != F.size(ids), "offsets don't fit the length"),
            F.when(bad_label, "label is neither -100 nor input_id"), F.when(supervised(F.col(labels)) == 0, "nothing is supervised"),
        ), lambda x: x.isNotNull(),
    )
    return df.select(order, found.alias("errors")).filter(F.size("errors") > 0)


def count_windows(df: DataFrame, order: str, size: int, loss: str, tokens: str) -> DataFrame:
    """Tumbling windows of ``size`` rows (the last may be smaller): token-weighted loss of each."""
    placed = group_positions(df, None, [F.col(order).asc()], "place")
    out = placed.groupBy(F.floor((F.col("place") - 1) / size).cast("long").alias("window")).agg(F.count("*").alias("micro_batches"), F.sum(tokens).cast("long").alias("tokens"), F.sum(F.col(loss) * F.col(tokens)).alias("w"))
    return out.select("window", "micro_batches", "tokens", F.round(F.coalesce(F.col("w") / F.when(F.col("tokens") > 0, F.col("tokens")), F.lit(0.0)), 6).alias("loss"))


def bins(df: DataFrame, tokens: str, most: int = 16384) -> DataFrame:
    return df.filter(F.col(tokens).isNotNull()).groupBy(length_bin(F.col(tokens), most).alias("length_bin")).agg(F.count("*").alias("rows"))


def schedule(rows: int, batch: int, accumulate: int, epochs: int, warmup: float) -> dict[str, int]:
    """Steps an epoch, steps in all and warm-up steps, each rounded up."""
    up = lambda a, b: -(-a // b)
    per = up(up(rows, batch), accumulate)
    total = per * epochs
    return {"steps_per_epoch": per, "total_steps": total, "warmup_steps": int(-(-total * warmup // 1))}
