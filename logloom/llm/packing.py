"""Filling containers of fixed capacity with texts of varying length.

Texts are dealt by hash of key and length into blocks of about ``BLOCK_TOKENS``
tokens, each packed by itself, so no task sees the whole corpus, only the last
container of a block is badly filled, and file order changes nothing.  In a
block, texts are taken longest first.  A text costs its length plus the square
of its length (linear layers and attention); it goes into the container with
the least cost so far that still has room, and a new one is opened only where
no other has room.  The more containers are open from the start, the better
their costs are balanced, but the more gaps are left that nothing fits.  So a
block is packed from each of ``STARTS`` (shares of the containers that its
tokens need at least), and of the results with the fewest containers the one
with the most even costs counts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import materialize

BLOCK_TOKENS, CHUNK = 1_000_000, 4096
#: Shares of the least number of containers that are open from the start.
STARTS = (0.0, 0.5, 0.75, 0.9, 1.0)
#: Cost of n tokens: LINEAR x n + QUADRATIC x n^2.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def pack_block(sizes: list[int], capacity: int, start: int | None = None) -> list[int]:
    """The container of each size (longest first), none filled above ``capacity``.

    ``start`` containers are open at first, by default as many as are needed at least.
    """
    opened = max(1, math.ceil(sum(sizes) / capacity)) if start is None else start
    # Containers by free space: a heap of (cost, container) for each, and the least cost of each heap.
    by_free: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    least = np.full(capacity + 1, np.inf)
    by_free[capacity] = [(0.0, i) for i in range(opened)]
    least[capacity] = 0.0 if opened else np.inf
    out = []
    for n in sizes:
        room = n + int(np.argmin(least[n:])) if n <= capacity else capacity
        if least[room] == np.inf:
            room, cost, to = capacity, 0.0, opened
            opened += 1
        else:
            cost, to = heapq.heappop(by_free[room])
            least[room] = by_free[room][0][0] if by_free[room] else np.inf
        cost += LINEAR * n + QUADRATIC * n * n
        heapq.heappush(by_free[room - n], (cost, to))
        least[room - n] = by_free[room - n][0][0]
        out.append(to)
    return out


def spread(sizes: list[int], to: list[int]) -> float:
    """The standard deviation of the containers' costs over their mean."""
    n = np.asarray(sizes, float)
    cost = np.bincount(to, weights=LINEAR * n + QUADRATIC * n * n)
    return float(cost.std() / cost.mean()) if cost.sum() else 0.0


def best_block(sizes: list[int], capacity: int) -> list[int]:
    """``pack_block`` from the start that needs the fewest containers; among equals the one with the most even costs."""
    needed = math.ceil(sum(sizes) / capacity)
    tried = [pack_block(sizes, capacity, start) for start in sorted({int(needed * s) for s in STARTS})]
    return min(tried, key=lambda to: (len(set(to)), spread(sizes, to)))


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Containers for all rows of ``sizes``: ``key, part, start, n_tokens, container_id``.

    A row no larger than ``capacity`` gives one part (``part`` 0, ``start`` 0).
    A larger one is cut into parts of exactly ``capacity``, each a full
    container, and the rest, which is packed like any other text.  Rows of size
    0, null or less take no room; they are put into some container all the
    same, with ``n_tokens`` 0, so that every row has a place.  Keys may be null
    or repeat.  Empty input gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    # Rows with equal key and size are counted and told apart by number, in chunks, so that a key with very many is spread.
    counted = sizes.groupBy(F.col(key).alias("key"), n.alias("n")).agg(F.count("*").alias("k"))
    chunks = counted.select("key", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / CHUNK))).alias("c")).repartition("key", "n", "c")
    numbered = F.sequence(F.col("c") * CHUNK, F.least(F.col("c") * CHUNK + CHUNK, F.col("k")) - 1)
    rows = materialize(chunks.select("key", "n", F.explode(numbered).alias("copy")), "sizes")
    total = rows.agg(F.coalesce(F.sum(F.col("n") % capacity), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil(total[0] / BLOCK_TOKENS), math.ceil(total[1] / BLOCK_TOKENS * 8))
    whole = F.floor(F.col("n") / capacity)
    exact = (F.col("n") > 0) & (F.col("n") % capacity == 0)
    cut = rows.filter(F.col("n") >= capacity).select("key", "n", "copy", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("part")).select(
        "key", F.col("part").cast("int").alias("part"), (F.col("part") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.to_json(F.struct("key", "n", "copy", "part")).alias("container_id")
    )
    rest = rows.filter(~exact).select("key", whole.cast("int").alias("part"), (whole * capacity).cast("long").alias("start"), (F.col("n") % capacity).cast("long").alias("n_tokens"), F.xxhash64("key", "n", "copy").alias("h"))
    dealt = rest.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))

    def one_block(part: pa.Table) -> pa.Table:
        part = part.sort_by([("n_tokens", "descending"), ("h", "ascending")])
        block = part.column("block")[0].as_py()
        to = best_block(part.column("n_tokens").to_pylist(), capacity)
        return part.select(["key", "part", "start", "n_tokens"]).append_column("container_id", pa.array([f"b{block}.{i}" for i in to], pa.string()))

    packed = dealt.groupBy("block").applyInArrow(one_block, cut.schema)
    return packed.unionByName(cut).withColumnRenamed("key", key)
