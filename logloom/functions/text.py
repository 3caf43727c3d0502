"""Column expressions over text and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and words that tell a tool's family.
READ_PREFIXES, WRITE_PREFIXES = ["find", "get", "list", "search"], ["cancel", "exchange", "modify", "return"]


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` evaluated once, however often the result names it: functions of arrays would evaluate it for every element."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def word_ngrams(tokens: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` words; the distinct words themselves where there are fewer."""

    def build(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, runs).otherwise(w))

    return bound(tokens, build)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalize_error(text: Column) -> Column:
    """An error message without what is particular to the call, at most 240 characters."""
    out = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^error:\s*", "")
    out = F.regexp_replace(out, r"(?i)#W\d+", "<order_id>")
    out = F.regexp_replace(out, r"\b\d{5,}\b", "<id>")
    out = F.substring(F.lower(F.trim(F.regexp_replace(out, r"\s+", " "))), 1, 240)
    return F.when(out == "", "unspecified tool error").otherwise(out)


def tool_family(name: Column) -> Column:
    """read, write, utility, transfer or other, by the tool's name."""
    prefix = lambda found: f"^({'|'.join(found)})_"
    return (
        F.when(name.rlike(prefix(READ_PREFIXES)), "read")
        .when(name.rlike(prefix(WRITE_PREFIXES)), "write")
        .when(name == "calculate", "utility")
        .when(name.contains("transfer") | name.contains("human"), "transfer")
        .otherwise("other")
    )


def canonical_json(text: Column) -> Column:
    """Sorted keys and no spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def slot_id(step: Column, sample: Column, rollout: Column) -> Column:
    return F.format_string("step_%06d:sample_%06d:rollout_%06d", step, sample, rollout)


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first character that differs; null where the texts are equal.

    Found by halving with prefix comparison, so a text costs the logarithm of
    its length in comparisons and no array of its characters is made.
    """

    def find(both: Column) -> Column:
        a, b = both["a"], both["b"]
        state = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).cast("int").alias("hi"))

        def halve(s: Column) -> Column:
            mid = ((s["lo"] + s["hi"] + 1) / 2).cast("int")
            equal = F.substr(a, F.lit(1), mid) == F.substr(b, F.lit(1), mid)
            return F.struct(F.when(equal, mid).otherwise(s["lo"]).alias("lo"), F.when(equal, s["hi"]).otherwise(mid - 1).alias("hi"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, lambda s, _: F.when(s["lo"] < s["hi"], halve(s)).otherwise(s))
        return F.when(a != b, found["lo"])

    return bound(F.struct(a.alias("a"), b.alias("b")), find)


def json_object_in(text: Column) -> Column:
    """What stands from the first ``{`` to the last ``}``, if it is JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def task_order(task: Column) -> list[Column]:
    """Sort keys: numbers first, by value, then other texts; nulls last."""
    number = task.try_cast("bigint")
    return [number.isNull().asc(), number.asc(), task.asc_nulls_last()]
