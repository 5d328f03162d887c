"""Model answers and task graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as fr
from ..operators import graph as g
from ..operators import responses as r
from .registry import plan


def _q(text: str) -> str:
    return text.replace("'", "''")


def _repaired(col: str) -> str:
    for pattern, replacement in fr.REPAIRS:
        new = replacement.replace("$1", "\\1")
        col = f"regexp_replace({col}, '{_q(pattern)}', '{_q(new)}', 'g')"
    return col


_BODY = r"""
    b as (select response_id, case when regexp_matches(text, '^\s*```[A-Za-z]*\s*')
              then regexp_replace(regexp_replace(text, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '')
              else text end as body from llm_responses_v)"""
_PARSED = f"""{_BODY},
    f as (select *, {_repaired('body')} as fixed from b),
    m as (select *, case when json_valid(body) then 'valid' when json_valid(fixed) then 'repaired'
              else 'failed' end as parse_mode,
              case when json_valid(body) then body when json_valid(fixed) then fixed end as good from f)"""
_GUESSED = f"""
    fields as (select response_id, body, {', '.join(
        f"case when regexp_matches(body, '{p}') then regexp_extract(body, '{p}', 1) "
        f"else '{fr.FIELD_DEFAULTS[n]}' end as {n}" for n, p in fr.FIELD_PATTERNS.items())},
        regexp_extract_all(body, '{fr.TASK_PATTERN}', 1) as a,
        regexp_extract_all(body, '{fr.TASK_PATTERN}', 2) as o,
        regexp_extract_all(body, '{fr.TASK_PATTERN}', 3) as d,
        list_filter(regexp_extract_all(body, '{fr.BLOCK_PATTERN}'),
                    lambda x: regexp_matches(x, '{_q(fr.BLOCK_ID)}')) as blocks from b),
    numbered as (
        select response_id, unnest(range(len(a))) as pos, a, o, d, blocks, 1 as how from fields where len(a) > 0
        union all select response_id, unnest(range(len(blocks))), a, o, d, blocks, 2 from fields
        where len(a) = 0 and len(blocks) > 0
        union all select response_id, unnest(range(3)), a, o, d, blocks, 3 from fields
        where len(a) = 0 and len(blocks) = 0 and regexp_matches(lower(body), 'extract|etl|data')),
    guessed as (select response_id, cast(pos as int) as pos,
        case how when 1 then a[pos + 1] when 2 then regexp_extract(blocks[pos + 1], '{_q(fr.BLOCK_ID)}', 1)
             else ['extract_data', 'validate_data', 'load_data'][pos + 1] end as id,
        case how when 1 then o[pos + 1]
             when 2 then case when regexp_matches(blocks[pos + 1], '{_q(fr.BLOCK_OPERATOR)}')
                 then regexp_extract(blocks[pos + 1], '{_q(fr.BLOCK_OPERATOR)}', 1) else 'PythonOperator' end
             else 'PythonOperator' end as operator,
        case how when 1 then d[pos + 1]
             when 2 then case when regexp_matches(blocks[pos + 1], '{_q(fr.BLOCK_DESCRIPTION)}')
                 then regexp_extract(blocks[pos + 1], '{_q(fr.BLOCK_DESCRIPTION)}', 1)
                 else 'Task: ' || regexp_extract(blocks[pos + 1], '{_q(fr.BLOCK_ID)}', 1) end
             else ['Extract data from source', 'Validate data quality', 'Load data to destination'][pos + 1]
        end as description from numbered)"""


@plan("strip_fences", f"with {_BODY} select * from b")
def strip_fences(t):
    return r.strip_fences(t.llm_responses_v)


@plan("repair_json", f"""with {_PARSED}
    select response_id, parse_mode, good ->> '$.dag_id' as dag_id, good ->> '$.description' as description,
           good ->> '$.schedule_interval' as schedule_interval,
           cast(json_array_length(good, '$.tasks') as int) as task_count from m""")
def repair_json(t):
    return r.repair_json(t.llm_responses_v).select(
        "response_id", "parse_mode", "workflow.dag_id", "workflow.description",
        "workflow.schedule_interval", F.size("workflow.tasks").alias("task_count"),
    ).withColumn("task_count", F.when(F.col("parse_mode") != "failed", F.col("task_count")))


@plan("extract_workflow_fields", f"""with {_BODY}, {_GUESSED}
    select f.response_id, dag_id, f.description as description, schedule_interval, pos, id, operator,
           g.description as task_description
    from fields f left join guessed g on g.response_id = f.response_id""")
def extract_workflow_fields(t):
    found = r.extract_workflow_fields(t.llm_responses_v)
    return found.select(
        "response_id", "dag_id", "description", "schedule_interval", F.posexplode_outer("tasks")
    ).select(
        "response_id", "dag_id", "description", "schedule_interval", "pos", "col.id",
        "col.operator", F.col("col.description").alias("task_description"),
    )


@plan("chain_missing_dependencies", f"""with {_BODY}, {_GUESSED}
    select response_id, pos, id, lag(id) over (partition by response_id order by pos) as upstream
    from guessed""")
def chain_missing_dependencies(t):
    chained = r.chain_missing_dependencies(r.extract_workflow_fields(t.llm_responses_v))
    return chained.select("response_id", F.posexplode_outer("tasks")).where("pos is not null").select(
        "response_id", "pos", "col.id", F.get("col.upstream_dependencies", F.lit(0)).alias("upstream")
    )


@plan("parse_workflows", f"""with {_PARSED}, {_GUESSED},
    n as (select response_id, count(*) as c from guessed group by 1)
    select m.response_id, case when parse_mode <> 'failed' then parse_mode when c > 0 then 'regex'
               else 'default' end as parse_mode,
           case when parse_mode <> 'failed' then good ->> '$.dag_id' else dag_id end as dag_id,
           case when parse_mode <> 'failed' then good ->> '$.schedule_interval' else schedule_interval end
               as schedule_interval,
           cast(case when parse_mode <> 'failed' then json_array_length(good, '$.tasks')
                     else coalesce(c, 0) end as int) as task_count
    from m join fields f using (response_id) left join n using (response_id)""")
def parse_workflows(t):
    return r.parse_workflows(t.llm_responses_v).select(
        "response_id", "parse_mode", "dag_id", "schedule_interval", F.size("tasks").alias("task_count")
    )


# ---- graphs --------------------------------------------------------------


@plan("clean_edges", "select * from edges_v where task_id <> upstream_id")
def clean_edges(t):
    return g.clean_edges(t.edges_v)


@plan("dataflow_edges", """
    with o as (select dag_id, task_id, pos, unnest(outputs) as item from pipeline_tasks_v),
    i as (select dag_id, task_id, pos, unnest(inputs) as item from pipeline_tasks_v)
    select distinct i.dag_id, i.task_id, o.task_id as upstream_id
    from i join o on o.dag_id = i.dag_id and o.item = i.item and o.pos < i.pos""")
def dataflow_edges(t):
    return g.dataflow_edges(t.pipeline_tasks_v)


@plan("dataflow_items", """
    with o as (select dag_id, task_id, pos, unnest(outputs) as item from pipeline_tasks_v),
    i as (select dag_id, task_id, pos, unnest(inputs) as item from pipeline_tasks_v),
    e as (select dag_id, item, i.task_id as user_id, i.pos as user_pos, o.task_id as maker_id, o.pos as maker_pos
          from i join o using (dag_id, item) where o.pos < i.pos)
    select distinct dag_id, item, maker_id as task_id, maker_pos as pos, 'produces' as role from e
    union all select distinct dag_id, item, user_id, user_pos, 'uses' from e""")
def dataflow_items(t):
    return g.dataflow_items(t.pipeline_tasks_v)


@plan("shared_items", """
    select dag_id, unnest(outputs) as item from pipeline_tasks_v
    intersect select dag_id, unnest(inputs) from pipeline_tasks_v""")
def shared_items(t):
    return g.shared_items(t.pipeline_tasks_v)


@plan("plan_profile", """
    select dag_id, count(*) * 5 as runtime_minutes, cast(sum(cpu) as bigint) as total_cpu,
           cast(sum(memory_gb) as bigint) as total_memory_gb,
           count(*) filter (where inputs is null) as parallelizable_tasks,
           cast(count(*) * 10 + sum(cpu) * 5 as bigint) as complexity_score
    from pipeline_tasks_v group by 1""")
def plan_profile(t):
    return g.plan_profile(t.pipeline_tasks_v)


@plan("plan_cost", """
    with c as (select dag_id, cast(sum(cast((cpu * 0.10 + memory_gb * 0.02) * 0.5 as decimal(18,3)))
                   as decimal(24,3)) as v from pipeline_tasks_v group by 1)
    select dag_id, cast(round(v, 2) as double) as cost_per_run,
           cast(round(v * 30, 2) as double) as monthly_cost,
           cast(round(v * 0.7, 2) as double) as compute, cast(round(v * 0.2, 2) as double) as storage,
           cast(round(v * 0.1, 2) as double) as network from c""")
def plan_cost(t):
    return g.plan_cost(t.pipeline_tasks_v)


@plan("critical_path", """
    with recursive walk as (
        select dag_id, task_id as at, [task_id] as path, 1 as depth from pipeline_tasks_v
        union all
        select w.dag_id, e.upstream_id, list_append(w.path, e.upstream_id), w.depth + 1
        from walk w join edges_v e on e.dag_id = w.dag_id and e.task_id = w.at
        where not list_contains(w.path, e.upstream_id))
    select dag_id, cast(max(depth) as bigint) as critical_path from walk group by 1""")
def critical_path(t):
    return g.critical_path(t.pipeline_tasks_v, t.edges_v)
