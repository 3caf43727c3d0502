"""Queries over rendered and labelled conversations, and over event streams, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import curation as cu
from logloom.operators import datasets as ds
from logloom.operators import preprocess as pp
from logloom.plans.curation import _N, _TRAIN, GREETINGS, SYSTEM, newest
from logloom.session import table
from logloom.streaming import windows as st


def rendered(spark: SparkSession, d: str) -> DataFrame:
    return pp.render(cu.training_messages(newest(spark, d, "messages"), GREETINGS, SYSTEM))


def prj_17_rendered(spark: SparkSession, d: str) -> DataFrame:
    return rendered(spark, d).select("trajectory_id", F.sha2("rendered", 256).alias("text_sha256"), F.length("rendered").cast("long").alias("characters"), F.size("spans").cast("long").alias("assistant_spans"))


def flt_11_rendering_errors(spark: SparkSession, d: str) -> DataFrame:
    return rendered(spark, d).select(F.explode_outer(pp.rendering_errors(F.col("rendered"), F.col("spans"))).alias("error")).groupBy("error").agg(F.count("*").alias("trajectories"))


def str_08_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = rendered(spark, d).select("trajectory_id", "rendered", F.explode("spans").alias("s"))
    target = F.substr("rendered", F.col("s.content_start") + 1, F.col("s.target_end") - F.col("s.content_start"))
    return rows.select("trajectory_id", F.col("s.ordinal").cast("long").alias("ordinal"), F.col("s.kind").alias("kind"), F.md5(target).alias("target_md5"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return pp.label(rendered(spark, d), "trajectory_id")


def jsn_14_labels(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.size("input_ids"), ds.supervised(F.col("labels"))
    return labelled(spark, d).select("trajectory_id", n.alias("tokens"), s.alias("supervised"), (n - s).alias("masked"), "merged_spans", ds.supervised(F.col("labels"), True).alias("shifted_supervised"))


def prj_18_regions(spark: SparkSession, d: str) -> DataFrame:
    made = rendered(spark, d)
    tokens = pp.token_rows(pp.label(made, "trajectory_id"), "trajectory_id")
    return pp.regions(tokens, made, "trajectory_id").groupBy("region", "loss").agg(F.count("*").alias("tokens"))


def flt_12_flat_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the label store that break its contract (none, if all is well), by error."""
    rows = labelled(spark, d).select("trajectory_id", "input_ids", "labels", F.size("input_ids").alias("n"))
    placed = ds.offsets(rows, "trajectory_id", "n")
    return ds.flat_array_errors(placed, "trajectory_id", "input_ids", "labels", "offset_start", "offset_end").select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def flt_25_completions(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(spark, d, "messages").select(F.explode("messages").alias("m")).filter("m.role = 'assistant'")
    return rows.groupBy(pp.completion_kind(pp.message_parts(F.col("m"))[1]).alias("kind")).agg(F.count("*").alias("messages"))


def stm_04_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return st.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "event_type", "value")


def stm_04_sliding(spark: SparkSession, d: str) -> DataFrame:
    return st.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", "event_type", "value", slide="1 hour")


def stm_04_sessions(spark: SparkSession, d: str) -> DataFrame:
    return st.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [prj_17_rendered, flt_11_rendering_errors, str_08_spans, jsn_14_labels, prj_18_regions, flt_12_flat_arrays, flt_25_completions, stm_04_tumbling, stm_04_sliding, stm_04_sessions]
    return {f.__name__: f for f in own}


_BODY = "case when m.role = 'tool' then '<tool_response>' || chr(10) || coalesce(m.content, '') || chr(10) || '</tool_response>' when len(coalesce(m.tool_calls, [])) > 0 then array_to_string(list_transform(m.tool_calls, lambda c: '<tool_call>' || chr(10) || '{\"name\": \"' || coalesce(c.name, '') || '\", \"arguments\": ' || coalesce(c.arguments, 'null') || '}' || chr(10) || '</tool_call>'), chr(10)) else coalesce(m.content, '') end"


def rendered_sql() -> str:
    """Training conversations with their messages ``ms`` and rendered text ``t``, as the table ``re``."""
    return f"{_TRAIN}, re as (select trajectory_id, ms, '<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || coalesce(array_to_string(list_transform(ms, lambda m: '<|im_start|>' || case when m.role = 'tool' then 'user' else coalesce(m.role, 'user') end || chr(10) || {_BODY} || '<|im_end|>' || chr(10)), ''), '') as t from tr)"


def oracle_sql() -> dict[str, str]:
    text = rendered_sql()
    hour = "date_trunc('hour', ts)"
    return {
        "prj_17_rendered": f"with {text} select trajectory_id, sha256(t) as text_sha256, length(t) as characters, len(list_filter(ms, lambda m: m.role = 'assistant')) as assistant_spans from re",
        "str_08_spans": f"with {_TRAIN}, a as (select trajectory_id, list_filter(ms, lambda m: m.role = 'assistant') as o from tr), u as (select trajectory_id, generate_subscripts(o, 1) - 1 as ordinal, unnest(o) as m from a) select trajectory_id, ordinal, case when len(coalesce(m.tool_calls, [])) > 0 then 'tool_call' else 'text' end as kind, md5({_BODY} || '<|im_end|>') as target_md5 from u",
        "flt_25_completions": f"""with {_N}, u as (select unnest(messages) as m from l), k as (select case when len(coalesce(m.tool_calls, [])) > 0 then case when len(list_filter(m.tool_calls, lambda c: not coalesce(json_valid(c.arguments) and json_type(c.arguments) = 'OBJECT', false))) > 0 then 'bad arguments' else 'tool_call' end
          when trim(coalesce(m.content, '')) = '' then 'empty' when contains(m.content, '<tool_call>') or contains(m.content, '</tool_call>') then 'left-over tag' else 'text' end as kind from u where m.role = 'assistant') select kind, count(*) as messages from k group by 1""",
        "flt_11_rendering_errors": f"""with {text}, e as (select list_filter([case when not ends_with(t, '<|im_end|>' || chr(10)) then 'no end mark at the end' end, case when len(string_split(t, '<|im_start|>')) <> len(string_split(t, '<|im_end|>')) then 'unbalanced messages' end, case when len(string_split(t, '<tool_call>')) <> len(string_split(t, '</tool_call>')) then 'unbalanced tool calls' end, case when len(list_filter(ms, lambda m: m.role = 'assistant')) = 0 then 'no assistant' end], lambda x: x is not null) as e from re)
          select case when len(e) = 0 then null else x end as error, count(*) as trajectories from (select e, unnest(case when len(e) = 0 then [null] else e end) as x from e) group by 1""",
        "stm_04_tumbling": f"select {hour} as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
        "stm_04_sliding": f"with w as (select {hour} as s, event_type, value from events union all select {hour} - interval 1 hour, event_type, value from events) select s as window_start, event_type, count(*) as events, round(sum(value), 4) as total from w group by 1, 2",
        "stm_04_sessions": "with m as (select user_id, ts, value, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by ts) as k from m) select user_id, min(ts) as session_start, count(*) as events, round(sum(value), 4) as total from s group by user_id, k",
    }
