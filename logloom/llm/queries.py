"""The named queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import encode, neardup, packing, runs, sentences, splits, topn, varied
from logloom.session import drop, latest, table, task_number


def setting(spark: SparkSession, sf_dir: str, name: str, default: float) -> float:
    """One value of the fixed table run_settings (seven rows)."""
    row = table(spark, sf_dir, "run_settings").filter(F.col("setting_name") == name).select("setting_value").first()
    return default if row is None or row[0] is None else float(row[0])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.call_runs(table(spark, sf_dir, "tool_calls")).filter("run_length >= 2")
    return found.select(F.col("group").alias("trajectory_id"), F.col("first_id").alias("first_call_id"), F.col("last_id").alias("last_call_id"))


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, those of one call too."""
    found = runs.call_runs(table(spark, sf_dir, "tool_calls"))
    return found.select(F.col("group").alias("trajectory_id"), F.col("first_id").alias("first_call_id"), F.col("last_id").alias("last_call_id"), "run_length", "duration_seconds")


def p1_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries in runs of each trajectory, beside what the features say of exact ones."""
    found = runs.call_runs(table(spark, sf_dir, "tool_calls"))
    mine = found.groupBy(F.col("group").alias("trajectory_id")).agg(
        F.sum("run_length").cast("long").alias("calls"), F.count("*").alias("runs"), F.sum(F.col("run_length") - 1).cast("long").alias("retries_in_runs"), F.max("run_length").cast("long").alias("longest_run")
    )
    told = table(spark, sf_dir, "trajectory_features").groupBy("trajectory_id").agg(F.max("consecutive_exact_retries").alias("consecutive_exact_retries"), F.max("exact_repeated_calls").alias("exact_repeated_calls"))
    return mine.join(told, "trajectory_id", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "candidates"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "candidates"))


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied subset of the accepted candidates (the latest row of each)."""
    candidates = table(spark, sf_dir, "candidates")
    judged = candidates.select("trajectory_id", "task_id", "tier", F.col("semantic_screening.decision").alias("decision"), "ingested_at")
    accepted = latest(judged.filter("trajectory_id IS NOT NULL"), ["trajectory_id"], "ingested_at").filter("decision = 'accepted'")
    accepted = accepted.select("trajectory_id", task_number(F.col("task_id")).alias("task"), F.lower(F.trim("tier")).alias("tier"))
    taking_part = candidates.join(accepted.select("trajectory_id"), "trajectory_id", "left_semi")
    members, named, one, pairs = neardup.near_duplicates(taking_part)
    ids = named.select("cls", "first_id")
    later = pairs.join(ids.withColumnsRenamed({"cls": "a", "first_id": "ia"}), "a").join(ids.withColumnsRenamed({"cls": "b", "first_id": "ib"}), "b").select(F.greatest("ia", "ib").alias("first_id")).distinct()
    known = members.join(ids, "cls").join(later.withColumn("later", F.lit(True)), "first_id", "left")
    known = known.select("trajectory_id", "cls", (F.col("later").isNull() & (F.col("trajectory_id") == F.col("first_id"))).alias("fresh"))
    # The word runs come last: Spark takes an array for one element long and would broadcast them, and joins after them would shuffle them again.
    rows = accepted.join(known, "trajectory_id", "left").join(one.select("cls", "grams").hint("merge"), "cls", "left")
    rows = rows.select(F.col("trajectory_id").alias("id"), "task", "tier", "fresh", F.coalesce("grams", F.array().cast("array<bigint>")).alias("grams"))
    size = varied.subset_size(accepted.count(), setting(spark, sf_dir, "subset_share", 0.25))
    chosen = varied.choose(rows, size, int(setting(spark, sf_dir, "subset_min_per_task", 1)))
    drop(members, named, one, pairs)  # the rows are written by now
    return chosen.select(F.col("id").alias("trajectory_id"), F.col("task").alias("task_id"), "tier", "cluster", "phase")


def _ranked(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").select("trajectory_id", "task_id", F.col("semantic_screening.confidence").alias("confidence"), F.col("screening.task_rank").alias("task_rank"), "ingested_at")
    newest = latest(rows, ["trajectory_id"], "ingested_at").filter("confidence IS NOT NULL AND NOT isnan(confidence)")
    keyed = newest.select(task_number(F.col("task_id")).alias("task_id"), "trajectory_id", "confidence", "task_rank")
    return topn.top_n(keyed, F.col("task_id"), [F.col("confidence").desc(), F.col("task_rank").asc_nulls_last(), F.col("trajectory_id").asc()], n)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 3).select("task_id", "trajectory_id")


def p5_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each task with their positions."""
    return _ranked(spark, sf_dir, 10).select("task_id", "position", "trajectory_id", "confidence")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.task_groups(table(spark, sf_dir, "tasks")).filter("task_id <> group_task_id").select("group_task_id", "task_id")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {k: setting(spark, sf_dir, f"split_{k}", d) for k, d in (("train", 0.8), ("validation", 0.1), ("test", 0.1))}
    return splits.split_tasks(table(spark, sf_dir, "tasks"), shares)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _packed(spark: SparkSession, sf_dir: str, which: str, default: int) -> DataFrame:
    sizes = encode.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", int(setting(spark, sf_dir, f"pack_capacity_{which}", default)))


def p8_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "small", 256)


def p8_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "large", 2048)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("kind IS NULL OR kind <> 'tool_output'")
    return sentences.sentence_units(docs.select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_runs, p1_retries, p2_found, p2_groups, p4_subset, p5_found, p5_top10, p6_found, p6_splits, p7_ids, p8_small, p8_large, p9_found]
    return {f.__name__: f for f in own}


_LATEST = """
with l as (select trajectory_id, task_id, semantic_screening.confidence as confidence, screening.task_rank as task_rank,
             row_number() over (partition by trajectory_id order by ingested_at desc nulls last) as newest from candidates),
     k as (select cast(try_cast(regexp_extract(task_id, '([0-9]+)', 1) as bigint) as varchar) as task_id, trajectory_id, confidence, task_rank from l
           where newest = 1 and confidence is not null and not isnan(confidence) and regexp_extract(task_id, '([0-9]+)', 1) <> ''),
     r as (select *, row_number() over (partition by task_id order by confidence desc, task_rank asc nulls last, trajectory_id) as position from k)
"""


# Arguments as the set of their leaves' paths and values, so that neither order nor layout counts.
_NUM = r"^\s*[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"
_LEAF = f"case when regexp_matches(t, '{_NUM}') then '#' || regexp_replace(regexp_replace(case when contains(lower(t), 'e') then cast(t as double)::decimal(38,12)::varchar else cast(trim(t) as decimal(38,12))::varchar end, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') else lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) end"
_RUNS = f"""with o as (select trajectory_id, call_id, min(message_index) m, min(call_pos) p, min(name) as name, min(arguments) as arguments, min(called_at) as b, min(coalesce(finished_at, called_at)) as e from tool_calls group by 1, 2),
 a as (select distinct arguments, case when json_valid(arguments) and json_type(arguments) = 'VARCHAR' then json_extract_string(arguments, '$') else arguments end as doc from o),
 j as (select arguments, case when json_valid(doc) then doc else cast(to_json(doc) as varchar) end as doc from a where arguments is not null),
 l as (select arguments, fullkey as k, json_extract_string(doc, fullkey) as t from j, json_tree(doc) where atom is not null and type <> 'NULL'),
 n as (select arguments, k, {_LEAF} as v from l),
 g as (select arguments, string_agg(k || chr(1) || v, chr(2) order by k) as sig from n where v <> '' group by 1),
 s as (select o.*, coalesce(name, '') || chr(3) || coalesce(sig, '') as sig from o left join g using (arguments)),
 b as (select *, sum(case when sig = ps then 0 else 1 end) over (partition by trajectory_id order by m, p rows unbounded preceding) as run from (select *, lag(sig) over (partition by trajectory_id order by m, p) as ps from s))
 select trajectory_id, arg_min(call_id, m * 1000 + p) as first_call_id, arg_max(call_id, m * 1000 + p) as last_call_id, count(*) as n, greatest(date_diff('microsecond', arg_min(b, m * 1000 + p), arg_max(e, m * 1000 + p)) / 1e6, 0.0) as seconds from b group by trajectory_id, run"""
_GROUPS = """with recursive k as (select distinct 't:' || cast(try_cast(regexp_extract(task_id, '([0-9]+)', 1) as bigint) as varchar) as t, user_id, order_ids, instructions.known_info as ki, derived_from from tasks where regexp_extract(task_id, '([0-9]+)', 1) <> ''),
 n as (select t, 'u:' || lower(regexp_replace(u, '[^\\p{L}\\p{N}]+', '', 'g')) as x from (select t, user_id as u from k union select t, unnest(regexp_extract_all(lower(ki), '[a-z]+[ _-]+[a-z]+[ _-]+[0-9]{6}')) from k) where regexp_matches(u, '[0-9]') and regexp_matches(u, '\\p{L}')
   union select t, 'o:' || regexp_replace(o, '\\D+', '', 'g') from (select t, unnest(list_concat(coalesce(order_ids, []), coalesce(regexp_extract_all(ki, '(?i)#?\\bw[ _\\-]?(\\d{5,})\\b', 1), []))) as o from k) where regexp_matches(o, '[1-9]')
   union select t, 't:' || cast(try_cast(regexp_extract(derived_from, '([0-9]+)', 1) as bigint) as varchar) from k where regexp_extract(derived_from, '([0-9]+)', 1) <> ''
   union select t, t from k),
 e as (select a.t as a, b.t as b from n a join n b on a.x = b.x),
 r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
 g as (select a as t, min(substr(b, 3)::bigint) as s from r where b in (select t from k) group by 1)
 select s::varchar as group_task_id, substr(t, 3) as task_id from g where substr(t, 3) <> s::varchar"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"select trajectory_id, first_call_id, last_call_id from ({_RUNS}) where n > 1",
        "p1_runs": f"select trajectory_id, first_call_id, last_call_id, n as run_length, seconds as duration_seconds from ({_RUNS})",
        "p1_retries": f"""with r as (select trajectory_id, sum(n)::bigint as calls, count(*) as runs, sum(n - 1)::bigint as retries_in_runs, max(n) as longest_run from ({_RUNS}) group by 1),
            f as (select trajectory_id, max(consecutive_exact_retries) as consecutive_exact_retries, max(exact_repeated_calls) as exact_repeated_calls from trajectory_features group by 1)
            select r.*, consecutive_exact_retries, exact_repeated_calls from r left join f using (trajectory_id)""",
        "p6_found": _GROUPS,
        "p5_found": _LATEST + "select task_id, trajectory_id from r where position <= 3",
        "p5_top10": _LATEST + "select task_id, position, trajectory_id, confidence from r where position <= 10",
    }
