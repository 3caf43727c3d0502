"""Connected components by frontier breadth-first search from many seeds at once.

Adjacency lists are hash-partitioned: written once a level in buckets by node,
so that every hop reads them where they lie and shuffles only its frontier.
Hub nodes are salted, so a node that neighbours a third of all others is spread
over many tasks.  Every node whose name hashes lower than all its neighbours'
is a seed, so each component has at least one.  All seeds' frontiers grow
together, one hop a round, and a node takes the least label that reaches it.
All start at once, so a node's neighbours were reached a hop before it, with it
or a hop after it, and a hop looks back at the last two frontiers alone.  Edges
between nodes of different labels make a graph of the labels that is much
smaller.  It is merged by one task once it has at most ``SMALL`` links, and goes
through the same rounds before; the components are the same either way.  Nothing
but hub names and row counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import drop, materialize

#: A node is a hub when it has more than one in HUB_SHARE of all edges, so there are fewer than 2 * HUB_SHARE hubs.
HUB_SHARE, SALTS, LEAST_HUB = 500, 64, 10_000
#: Links of a graph of colliding labels that one task merges, some 30 MB.
SMALL = 200_000


def ordered(name: str) -> Column:
    """A node's name behind its hash: unique, and in an order that is as good as random."""
    return F.concat(F.lpad(F.hex(F.xxhash64(name)), 16, "0"), F.lit(":"), F.col(name))


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges(src, dst)`` (strings): ``node, component``.

    Edges count in both directions; loops, repeats and edges with a null end
    have no effect, except that a node with only a loop is its own component.
    A component's label is one of its nodes.  Empty input, empty result.
    """
    named = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).dropna()
    ends = named.select(ordered("src").alias("s"), ordered("dst").alias("d")).select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"))
    pairs = materialize(ends.distinct(), "edges")
    labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    links = pairs.filter("a < b")
    spent: list[DataFrame] = [pairs]
    while (total := links.count()):
        if spent[0] is pairs or total > SMALL:
            step, parts, links = _contract(links, total)
        else:
            step, parts, links = links.coalesce(1).mapInPandas(_merge, "node string, label string"), [], links.limit(0)
        joined = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("__to")), "label", "left")
        new = materialize(joined.select("node", F.coalesce("__to", "label").alias("label")), "labels")
        drop(labels, *parts, *spent)
        labels, spent = new, [links]
    drop(*spent[1:] if spent[0] is pairs else spent)
    return labels.select(F.substring("node", 18, 1 << 30).alias("node"), F.substring("label", 18, 1 << 30).alias("component"))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The least label of each component of a small graph."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    yield pd.DataFrame({"node": list(up), "label": [top(x) for x in list(up)]}, dtype=object)


def _contract(links: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """One level: every node of the ``total`` rows of ``links(a, b)``, each once with a < b, with a seed's label, the frontiers that hold them, and the links between labels."""
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    most = max(LEAST_HUB, total // HUB_SHARE)
    hubs = [r.a for r in both.groupBy("a").count().filter(F.col("count") > most).select("a").collect()] if total > most else []  # fewer than 2 * HUB_SHARE rows
    is_hub = F.col("a").isin(hubs)
    on = ["a", "salt"] if hubs else ["a"]
    salted = both.withColumn("salt", F.when(is_hub, F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0).cast("int")) if hubs else both
    copies = F.when(is_hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt_out = lambda df: df.withColumn("salt", F.explode(copies)) if hubs else df
    adjacency = materialize(salted, "adjacency", by=on)
    seeds = adjacency.groupBy("a").agg(F.min("b").alias("least")).filter("a < least").select(F.col("a").alias("node"), F.col("a").alias("label"))
    frontier = materialize(seeds, "frontier")
    parts, done = [frontier], frontier
    while True:
        sent = salt_out(frontier.withColumnRenamed("node", "a")).join(adjacency, on).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        recent = frontier if len(parts) < 2 else frontier.unionByName(parts[-2])
        fresh = materialize(sent.join(recent.select("node"), "node", "left_anti"), "frontier")
        if fresh.isEmpty():
            drop(fresh)
            break
        parts.append(fresh)
        done, frontier = done.unionByName(fresh), fresh
    left = salt_out(done.withColumnRenamed("node", "a"))
    cross = adjacency.filter("a < b").join(left, on).select("b", F.col("label").alias("la"))
    cross = cross.join(done.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").filter("la <> lb")
    between = materialize(cross.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
    drop(adjacency)
    return done, parts, between
