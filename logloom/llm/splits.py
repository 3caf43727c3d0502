"""Train, validation and test splits that keep related tasks together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.components import components, ordered
from logloom.session import materialize, task_number

#: A component of more than one in LARGE of all members is placed by itself, so there are fewer than LARGE of them.
LARGE, BUCKETS = 200, 4096

# What stands in an id's place where nobody or no order is known.
PLACEHOLDERS = ["", "guest", "unknown", "na", "none", "null", "nil", "anonymous", "anon", "tbd", "test", "nobody", "notavailable", "missing", "undefined"]
# What stands before a user's id, and an id: words and at least three digits.
_MEMBER = r"(?i)\b(?:you are|(?:member|user)(?:[ _]?(?:id|name|number))?(?: is)?)\s*:?\s*((?:\p{L}+[ _\-]+)+\d{3,})"
_ORDER = r"(?i)#?\bw[ _\-]?(\d{5,})\b"


def _plain(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))


def person_key(col: Column) -> Column:
    """A user id by its letters and digits; null for a placeholder or what has no number."""
    plain = _plain(col)
    return F.when(~plain.isin(PLACEHOLDERS) & plain.rlike(r"\d") & plain.rlike(r"\p{L}"), plain)


def order_key(col: Column) -> Column:
    """An order number by its digits; null for a placeholder (none, or only zeros)."""
    digits = F.regexp_replace(col, r"\D+", "")
    return F.when(digits.rlike("[1-9]"), digits)


def task_links(tasks: DataFrame) -> DataFrame:
    """``src, dst``: each task (a plain number) with the task of least hash among those that share a user, an order or an
    origin with it, once for each of these; a task that shares nothing with itself.  So what is shared needs no node of its own."""
    known = F.col("instructions.known_info")
    task = task_number(F.col("task_id"))
    people = F.transform(F.array_append(F.coalesce(F.regexp_extract_all(known, F.lit(_MEMBER), 1), F.array().cast("array<string>")), F.col("user_id")), person_key)
    orders = F.transform(F.concat(F.coalesce(F.regexp_extract_all(known, F.lit(_ORDER), 1), F.array().cast("array<string>")), F.coalesce("order_ids", F.array().cast("array<string>"))), order_key)
    tag = lambda found, mark: F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(mark), x))
    keys = F.concat(tag(people, "u:"), tag(orders, "o:"), tag(F.array(task_number(F.col("derived_from"))), "t:"), tag(F.array(task), "t:"))
    held = materialize(tasks.select(task.alias("src"), F.explode(keys).alias("key")).filter("src IS NOT NULL").distinct(), "held")
    least = held.groupBy("key").agg(F.min(ordered("src")).alias("least"))
    return held.join(least, "key").select("src", F.substring("least", 18, 1 << 30).alias("dst"))


def task_groups(tasks: DataFrame) -> DataFrame:
    """``task_id, group_task_id`` of every task: the smallest task it is related to, maybe itself.

    Tasks are related when they share a user, an order or an origin, directly or
    through others; spelling doesn't matter and placeholders relate nothing.
    Null or numberless task ids are left out; all rows of a repeated id count.
    """
    found = components(task_links(tasks))
    smallest = found.groupBy("component").agg(F.min(F.struct(F.length("node"), "node"))["node"].alias("group_task_id"))  # plain numbers, so shorter is smaller
    return found.join(smallest, "component").select(F.col("node").alias("task_id"), "group_task_id")


def assign_splits(groups: DataFrame, member: str, group: str, shares: Mapping[str, float]) -> DataFrame:
    """``member, split`` with all members of a group in one split, in the given shares.

    Groups are taken in the order of their hash and laid end to end; a group
    falls into the split in whose stretch its middle lies.  A group too large
    for that (more than one in ``LARGE`` of all members; there are fewer than
    ``LARGE``) is placed first, largest first, where most is still missing, and
    the stretches shrink by it.  Shares are scaled to 1; a share of 0 gets
    nothing.  Repeated members count once; null members or groups are left out.
    """
    spark: SparkSession = groups.sparkSession
    names = [k for k, v in shares.items() if v > 0]
    scale = sum(shares[k] for k in names)
    rows = materialize(groups.select(F.col(member).alias("m"), F.col(group).alias("g")).dropna().distinct(), "members")
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = [(r.g, r.n) for r in sizes.filter(F.col("n") * LARGE > max(total, LARGE)).collect()]  # fewer than LARGE rows
    missing, placed = {k: total * shares[k] / scale for k in names}, []
    for g, n in sorted(large, key=lambda x: (-x[1], x[0])):
        to = max(names, key=lambda k: missing[k])
        missing[to] -= n
        placed.append((g, to))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("split", T.StringType())])
    fixed = spark.createDataFrame(placed, schema)
    small = sizes.join(F.broadcast(fixed), "g", "left_anti").withColumn("h", F.xxhash64("g")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 52).cast("int"), F.lit(BUCKETS)))
    per = small.groupBy("bucket").agg(F.sum("n").alias("s"))
    before = per.select("bucket", (F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # at most BUCKETS rows
    w = Window.partitionBy("bucket").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.coalesce("before", F.lit(0)) + F.sum("n").over(w) - F.col("n") / 2.0
    rest = small.join(F.broadcast(before), "bucket").withColumn("middle", middle)
    room = sum(max(v, 0.0) for v in missing.values()) or 1.0
    held, split = 0.0, F.lit(names[-1])
    bounds = []
    for k in names[:-1]:
        held += max(missing[k], 0.0) / room
        bounds.append((k, held))
    filled = max(total - sum(n for _, n in large), 0)
    for k, upto in reversed(bounds):
        split = F.when(F.col("middle") < upto * filled, F.lit(k)).otherwise(split)
    decided = rest.select("g", split.alias("split")).unionByName(fixed)
    return rows.join(decided, "g").select(F.col("m").alias(member), "split")


def split_tasks(tasks: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """``task_id, split`` of every task, related tasks together."""
    return assign_splits(task_groups(tasks), "task_id", "group_task_id", shares)
