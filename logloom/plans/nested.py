"""Queries over the raw records: flat tables with parent links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import nested
from logloom.session import table


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_records(table(spark, sf_dir, "candidate_records").select("record_id", "body"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir).filter("entity IN ('call', 'reward')")
    place = lambda c: F.when(F.col("entity") == "reward", -1).otherwise(F.col(c)).cast("int").alias(c)
    return flat.select("trajectory_id", F.col("entity").alias("kind"), place("message_pos"), "item", place("answer_pos")).distinct()


def _kind(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.tables(_flat(spark, sf_dir))[kind]

    return query


def p3_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shapes(_flat(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p3_candidates": _kind("candidate"), "p3_messages": _kind("message"), "p3_calls": _kind("call"), "p3_rewards": _kind("reward"), "p3_rejects": _kind("reject"), "p3_shapes": p3_shapes}


_FOUND = """with recursive d as (select record_id, body::json as j from candidate_records where json_valid(body) and json_type(body) = 'OBJECT'),
 h as (select record_id, coalesce(json_extract_string(j, '$.trajectory_id'), json_extract_string(j, '$.id')) as trajectory_id,
   case when json_type(j, '$.messages') = 'VARCHAR' then json_extract_string(j, '$.messages')::json else json_extract(j, '$.messages') end as ms,
   case when json_type(j, '$.outcome') = 'OBJECT' then json_extract(j, '$.outcome') when json_type(j, '$.reward_info') = 'OBJECT' then json_extract(j, '$.reward_info') else j end as o from d),
 b as (select *, case when json_type(o, '$.reward_breakdown') = 'VARCHAR' then json_extract_string(o, '$.reward_breakdown')::json else json_extract(o, '$.reward_breakdown') end as rb from h),
 m as (select record_id, trajectory_id, unnest(range(0, json_array_length(ms)::bigint)) as pos, unnest(json_extract(ms, '$[*]')) as m from b where json_type(ms) = 'ARRAY'),
 c as (select record_id, trajectory_id, pos, unnest(case when json_type(m, '$.tool_calls') = 'ARRAY' then json_extract(m, '$.tool_calls[*]') else [json_extract(m, '$.tool_calls')] end) as c from m where json_type(m, '$.tool_calls') in ('ARRAY', 'OBJECT')),
 a as (select record_id, coalesce(json_extract_string(m, '$.tool_call_id'), json_extract_string(m, '$.id')) as id, min(pos) as pos from m where json_extract_string(m, '$.role') = 'tool' group by 1, 2),
 t as (select trajectory_id, '' as path, rb as v from b where rb is not null
   union all select trajectory_id, case when path = '' then k else path || '.' || k end, json_extract(v, case when json_type(v) = 'ARRAY' then '$[' || k || ']' else '$."' || k || '"' end)
   from (select trajectory_id, path, v, unnest(case when json_type(v) = 'OBJECT' then json_keys(v) when json_type(v) = 'ARRAY' then list_transform(range(0, json_array_length(v)::bigint), lambda i: i::varchar) else [] end) as k from t))
 select distinct trajectory_id, 'call' as kind, c.pos::integer as message_pos, json_extract_string(c, '$.id') as item, coalesce(a.pos, -1)::integer as answer_pos from c left join a on a.record_id = c.record_id and a.id = json_extract_string(c, '$.id')
 union select distinct trajectory_id, 'reward', -1, path, -1 from t where json_type(v) not in ('OBJECT', 'ARRAY', 'NULL')"""


def oracle_sql() -> dict[str, str]:
    rejects = "select record_id::varchar as record_key, null::varchar as trajectory_id, null::varchar as shape, case when body is null then 'null' when trim(body) = '' then 'empty' else 'incomplete' end as subtype, null::varchar as path, null::varchar as parent from candidate_records where body is null or not json_valid(body) or json_type(body) <> 'OBJECT'"
    return {"p3_found": _FOUND, "p3_rejects": rejects}
