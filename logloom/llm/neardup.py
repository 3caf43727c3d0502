"""Conversations that repeat one another with small changes, over all pairs.

Similarity is 0.75 x Jaccard over the distinct runs of three words of user and
assistant text plus 0.25 x the match ratio of the tool traces.  One hash
function orders all word runs; a conversation's sketch is the lowest ``SKETCH``
of its values.  Inverted lists over the retained values give overlaps; since
single values of stock phrases are common to half of all conversations, a list
belongs to a stretch of values that follow one another in the sketch (five of
them; fewer for short conversations), which two conversations of Jaccard 0.6
share many times over and unlike ones hardly ever.  Pairs whose lengths rule
out a Jaccard of 0.6 are dropped, the union of the sketches estimates the rest,
and exact Jaccard and the exact ratio decide.

Conversations with equal features form a class and are compared once.  Stretches
of two values, for sketches of 6 to 39 values (which hold all of them), and
single values below that miss nothing: with three in five of a union's values
shared, two shared ones must stand side by side once it has more than five.
Longer stretches miss a pair of Jaccard 0.6 (at equal traces) with a chance of
1 in 2,500 at 120 word runs, less at more, and none in 8,000 was missed with
stretches of three below that, or at Jaccard 0.64 from 120 runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import drop, drop_part, gather, materialize, stored

SKETCH, ESTIMATE = 256, 64
TEXT_WEIGHT, TOOL_WEIGHT, LIMIT = 0.75, 0.25, 0.7
#: Jaccard below which no tool ratio reaches the limit.
LEAST_JACCARD = (LIMIT - TOOL_WEIGHT) / TEXT_WEIGHT
#: The union sketch of ESTIMATE values is off by more than this once in 100,000 pairs.
SLACK = 0.27
#: Word runs from which a list's stretch has so many values.
STRETCH = [(120, 5), (40, 3), (6, 2), (0, 1)]
#: What is shuffled grows faster than what is stored, so it goes in passes: of some PASS bytes, or of three quarters of the classes' where that is more.
PASS, SLICES, LIST_PASSES, PAIR_PASSES = 32 << 20, 8, 4, 256
#: Bytes of a pair with the lowest values of one.
LOW_PAIR = 24 + 4 * ESTIMATE


def _stretch(n: Column) -> Column:
    out = F.lit(1)
    for least, r in reversed(STRETCH):
        out = F.when(n >= least, F.lit(r)).otherwise(out)
    return out


def features(candidates: DataFrame) -> DataFrame:
    """``trajectory_id, ingested_at, grams, trace`` of every row with messages.

    ``grams`` are the sorted hashes of distinct runs of three words (of the words
    themselves where there are fewer than three), ``trace`` the hashes of tool
    calls in order.  Rows without an id or without messages are left out; a
    null content counts as none.
    """
    m = F.filter("messages", lambda x: x.isNotNull())
    spoken = F.filter(m, lambda x: x["role"].isin("user", "assistant") & (F.length(x["content"]) > 0))
    words = F.regexp_extract_all(F.lower(F.array_join(F.transform(spoken, lambda x: x["content"]), " ")), F.lit("([a-z0-9]+)"), 1)
    calls = F.flatten(F.transform(F.filter(m, lambda x: (x["role"] == "assistant") & (F.size(x["tool_calls"]) > 0)), lambda x: x["tool_calls"]))
    written = lambda c: F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), c["arguments"], F.lit(""))
    trace = F.transform(F.filter(calls, lambda c: c.isNotNull()), lambda c: F.xxhash64(F.coalesce(c["name"], F.lit("")), written(c)))
    rows = candidates.filter("trajectory_id IS NOT NULL AND size(messages) > 0").select("trajectory_id", "ingested_at", words.alias("w"), trace.alias("trace"))
    n = F.size("w")
    runs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    grams = F.when(n >= 3, runs).otherwise(F.transform("w", lambda x: F.xxhash64(x)))
    return rows.select("trajectory_id", "ingested_at", F.sort_array(F.array_distinct(grams)).alias("grams"), "trace")


def _passes(size: int, each: int, most: int) -> int:
    """In how many passes to move ``size`` bytes, some ``each`` at a time."""
    return min(most, max(1, -(-size // each)))


def _pass(column: str, i: int, of: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(of)) == i


def classes(feats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``trajectory_id, cls`` of every trajectory by its newest row; ``cls, print, first_id, copies`` and ``cls, grams, trace, n`` of every class; all written.

    The features are written as they come, in slices by their print.  Newest rows
    and classes are found without them; then slice by slice the rows that stand
    for a class move to the classes, and the slice is deleted.
    """
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    print_ = F.unhex(F.md5(F.concat_ws(",", text(F.col("grams")), F.array(F.lit("|")), text(F.col("trace")))))
    rows = feats.select("trajectory_id", "ingested_at", F.monotonically_increasing_id().alias("rid"), print_.alias("print"), F.xxhash64("grams", "trace").alias("h"), "grams", "trace")
    sliced = F.pmod(F.xxhash64("print"), F.lit(SLICES)).cast("int").alias("slice")
    kept = materialize(rows.select("*", sliced), "features", parts=["slice"])
    newest = kept.groupBy("trajectory_id").agg(F.max_by(F.struct("print", "rid"), F.struct("ingested_at", "h")).alias("f"))
    told = materialize(newest.select("trajectory_id", "f.print", "f.rid"), "newest")
    named = told.groupBy("print").agg(F.min("rid").alias("cls"), F.min("trajectory_id").alias("first_id"), F.count("*").alias("copies"))
    ids = materialize(named.select("cls", "print", "first_id", "copies"), "ids")
    members = materialize(told.select("trajectory_id", "print").join(ids.select("print", "cls"), "print").select("trajectory_id", "cls"), "members")
    drop(told)
    n = _passes(stored(kept), PASS, SLICES)

    def moved() -> Iterator[DataFrame]:
        for i in range(n):
            mine = [s for s in range(SLICES) if s % n == i]
            stand = ids.select("cls", sliced).filter(F.col("slice").isin(mine)).select("cls")
            full = kept.filter(F.col("slice").isin(mine)).select(F.col("rid").alias("cls"), "grams", "trace")
            yield full.join(stand, "cls", "left_semi").select("*", F.size("grams").alias("n"))
            for s in mine:
                drop_part(kept, "slice", s)

    one = gather(moved(), "classes")
    drop(kept)
    return members, ids, one


def _lists(one: DataFrame) -> DataFrame:
    """``key, cls, n``: the inverted lists a class is in."""
    longer = F.ceil(F.col("n") / LEAST_JACCARD).cast("int")
    rows = one.select("cls", "n", F.slice("grams", 1, SKETCH).alias("s"), F.explode(F.array_distinct(F.array(_stretch(F.col("n")), _stretch(longer)))).alias("r"))
    # One row a place, so that keys are hashed in generated code and not in a function of the array.
    placed = rows.select("cls", "n", "s", "r", F.explode(F.sequence(F.lit(0), F.greatest(F.size("s") - F.col("r"), F.lit(0)))).alias("i"))
    key = F.lit(None).cast("bigint")
    for r in sorted({r for _, r in STRETCH}, reverse=True):
        key = F.when(F.col("r") == r, F.xxhash64(*[F.get("s", F.col("i") + j) for j in range(r)], F.lit(r))).otherwise(key)
    return placed.select("cls", "n", key.alias("key"))


def _ratio(a: str, b: str) -> Column:
    """Twice the matched calls over all calls of two traces; 1 where both are empty."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, list(p), list(q)).ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(ratios, T.DoubleType())(a, b)


def similar_classes(one: DataFrame) -> DataFrame:
    """``a, b, similarity``: pairs of classes (a < b) at or above the limit; written."""
    size, count = stored(one), one.count()
    share = max(PASS, size * 3 // 4)
    lists = _lists(one)  # most hold one class alone and meet nothing; both sides of the join are the same shuffle

    def meeting() -> Iterator[DataFrame]:
        n = _passes(size, PASS, LIST_PASSES)
        for i in range(n):
            some = lists.filter(F.pmod("key", F.lit(n)) == i)
            left, right = some.select("key", F.col("cls").alias("a"), F.col("n").alias("na")), some.select("key", F.col("cls").alias("b"), F.col("n").alias("nb"))
            near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * LEAST_JACCARD)
            yield left.join(right.hint("merge"), "key").filter(near).select("a", "b").distinct()

    met = gather(meeting(), "met")
    # Half of each value's bits keeps the order and is enough to estimate by.
    low = materialize(one.select("cls", F.transform(F.slice("grams", 1, ESTIMATE), lambda x: F.shiftright(x, 32).cast("int")).alias("low")), "low", by=["cls"])

    def estimated() -> Iterator[DataFrame]:
        n = _passes(met.count() * LOW_PAIR, share, PAIR_PASSES)
        for i in range(n):
            pairs = met.filter(_pass("a", i, n, "met")).select("a", "b").distinct()
            la, lb = low.withColumnsRenamed({"cls": "a", "low": "la"}), low.withColumnsRenamed({"cls": "b", "low": "lb"})
            # Spark takes an array for one element long, so without a hint it would broadcast far too much.
            both = pairs.join(la.hint("merge"), "a").join(lb.hint("merge"), "b")
            # What the lowest values of both have in common is at least what is common in the union's, so few need the union.
            some = both.filter(F.size(F.array_intersect("la", "lb")) >= F.greatest(F.size("la"), F.size("lb")) * (LEAST_JACCARD - SLACK))
            union = some.select("a", "b", "la", "lb", F.slice(F.sort_array(F.array_union("la", "lb")), 1, ESTIMATE).alias("u"))
            common = F.size(F.array_intersect("u", F.array_intersect("la", "lb")))
            yield union.filter(common >= F.size("u") * (LEAST_JACCARD - SLACK)).select("a", "b")

    likely = gather(estimated(), "likely")
    drop(met, low)
    asked = materialize(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "asked")
    parts = _passes(size, PASS, SLICES)
    full = gather((one.filter(F.pmod("part", F.lit(parts)) == i).select("cls", "grams", "trace").join(asked, "cls", "left_semi") for i in range(parts)), "full")

    def scored() -> Iterator[DataFrame]:
        n = _passes(likely.count() * size // max(1, count), share, PAIR_PASSES)
        for i in range(n):
            pairs = likely.filter(_pass("a", i, n, "likely")).select("a", "b")
            fa, fb = full.select(F.col("cls").alias("a"), F.col("grams").alias("ga"), F.col("trace").alias("ta")).filter(_pass("a", i, n, "likely")), full.select(F.col("cls").alias("b"), F.col("grams").alias("gb"), F.col("trace").alias("tb"))
            ready = pairs.join(fa.hint("merge"), "a").join(fb.hint("merge"), "b")
            inter = F.size(F.array_intersect("ga", "gb"))
            whole = F.size("ga") + F.size("gb") - F.col("inter")
            exact = ready.select("a", "b", "ta", "tb", "ga", "gb", inter.alias("inter")).select("a", "b", "ta", "tb", F.when(whole > 0, F.col("inter") / whole).otherwise(1.0).alias("jaccard"))
            near = exact.filter(F.col("jaccard") >= LEAST_JACCARD - 1e-9).select("a", "b", (F.col("jaccard") * TEXT_WEIGHT + _ratio("ta", "tb") * TOOL_WEIGHT).alias("similarity"))
            yield near.filter(F.col("similarity") >= LIMIT - 1e-12)

    found = gather(scored(), "pairs")
    drop(likely, asked, full)
    return found


def near_duplicates(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members, the classes' names and features, and the pairs of classes; all written, so each is computed once."""
    members, ids, one = classes(features(candidates))
    return members, ids, one, similar_classes(one)


def similar_pairs(candidates: DataFrame) -> DataFrame:
    """``trajectory_a, trajectory_b`` (smaller first) of every pair at or above the limit."""
    members, _, one, pairs = near_duplicates(candidates)
    drop(one)
    left, right = members.withColumnsRenamed({"cls": "a", "trajectory_id": "ida"}), members.withColumnsRenamed({"cls": "b", "trajectory_id": "idb"})
    apart = pairs.join(left, "a").join(right, "b").select("ida", "idb")
    equal = left.join(right.withColumnRenamed("b", "a"), "a").filter("ida < idb").select("ida", "idb")
    return apart.unionByName(equal).select(F.least("ida", "idb").alias("trajectory_a"), F.greatest("ida", "idb").alias("trajectory_b"))


def groups(candidates: DataFrame) -> DataFrame:
    """One row a candidate: ``trajectory_id, group_id, class_id, links``.

    ``group_id`` is the smallest id of those linked directly or through others,
    ``class_id`` the smallest id with the same features, ``links`` the number of
    others at or above the limit.
    """
    from logloom.llm.components import components

    members, ids, one, pairs = near_duplicates(candidates)
    drop(one)
    ids = ids.select("cls", "first_id", "copies")
    named = pairs.join(ids.withColumnsRenamed({"cls": "a", "first_id": "src", "copies": "ka"}), "a").join(ids.withColumnsRenamed({"cls": "b", "first_id": "dst", "copies": "kb"}), "b")
    found = components(named.select("src", "dst"))
    smallest = found.groupBy("component").agg(F.min("node").alias("group_id"))
    grouped = found.join(smallest, "component").select(F.col("node").alias("first_id"), "group_id")
    links = named.select("src", F.col("kb").alias("k")).unionByName(named.select(F.col("dst").alias("src"), F.col("ka").alias("k"))).groupBy(F.col("src").alias("first_id")).agg(F.sum("k").alias("k"))
    out = members.join(ids, "cls").join(grouped, "first_id", "left").join(links, "first_id", "left")
    return out.select("trajectory_id", F.coalesce("group_id", "first_id").alias("group_id"), F.col("first_id").alias("class_id"), (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"))
