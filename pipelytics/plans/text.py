"""Descriptions and prompts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import text as o
from .registry import plan


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _contains_any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _case(col: str, words) -> str:
    return "case " + " ".join(f"when contains({col}, '{w}') then '{w}'" for w in words) + " end"


_STEPS = r"""
    parts as (select doc_id, string_split_regex(text, '[.;]\s+') as p from descriptions_v),
    numbered as (select doc_id, p, unnest(range(len(p))) as idx from parts),
    steps as (select doc_id, cast(idx as int) as idx,
                     regexp_replace(p[idx + 1], '^\s+|\s+$', '', 'g') as step
              from numbered where regexp_replace(p[idx + 1], '^\s+|\s+$', '', 'g') <> '')"""

_ENTITIES = _STEPS + f""",
    entities as (select *, coalesce(
            nullif(regexp_extract(step, '(?i){x.TABLE_PATTERNS[0]}', 1), ''),
            nullif(regexp_extract(step, '(?i){x.TABLE_PATTERNS[1]}', 1), ''),
            nullif(regexp_extract(step, '(?i){x.TABLE_PATTERNS[2]}', 1), '')) as table_name,
        {_case('lower(step)', x.DATABASES)} as database_type,
        {_case('lower(step)', x.FILE_FORMATS)} as file_format from steps),
    words as (select *, list_filter(regexp_extract_all(lower(step), '\\b[a-zA-Z]+\\b'),
                  lambda w: w in ({_quoted(x.ACTION_WORDS)}))[1] as action,
              list_filter(regexp_extract_all(lower(step), '\\b[a-zA-Z]+\\b'),
                  lambda w: w in ({_quoted(x.OBJECT_WORDS)}))[1] as thing from entities),
    named as (select *, case when action is null then 'task_' || cast(idx + 1 as varchar)
                  else action || '_' || coalesce(thing, 'data') || '_' || cast(idx + 1 as varchar) end
                  as step_id from words)"""


def _steps(t):
    return o.split_steps(t.descriptions_v)


@plan("split_steps", f"with {_STEPS} select * from steps")
def split_steps(t):
    return _steps(t)


_SCORES = ", ".join(
    " + ".join(f"cast(regexp_matches(lower(step), '{p}') as int)" for p in ps) + f" as s{i}"
    for i, ps in enumerate(x.STEP_PATTERNS.values())
)
_TOP = "greatest(" + ", ".join(f"s{i}" for i in range(len(x.STEP_PATTERNS))) + ")"
_PICK = " ".join(f"when s{i} = {_TOP} then '{n}'" for i, n in enumerate(x.STEP_PATTERNS))
_WORDS = " ".join(
    f"when {_contains_any('lower(step)', ws)} then '{n}'" for n, ws in x.STEP_WORDS.items()
)


@plan("classify_steps", f"""with {_STEPS}, scored as (select *, {_SCORES} from steps)
    select doc_id, idx, step, case when {_TOP} > 0 then case {_PICK} end
           else case {_WORDS} else 'python_processing' end end as step_type from scored""")
def classify_steps(t):
    return o.classify_steps(_steps(t))


@plan("extract_entities", f"""with {_ENTITIES}
    select doc_id, idx, step, table_name, database_type, file_format,
           case database_type when 'postgresql' then 'postgres_default' when 'mysql' then 'mysql_default'
                when 'redshift' then 'redshift_default' when 'snowflake' then 'snowflake_default'
                when 'bigquery' then 'bigquery_default' when 's3' then 'aws_default'
                when 'mongodb' then 'mongodb_default' end as connection_id from entities""")
def extract_entities(t):
    return o.extract_entities(_steps(t))


@plan("step_ids", f"with {_ENTITIES} select doc_id, idx, step, step_id from named")
def step_ids(t):
    return o.step_ids(_steps(t))


@plan("step_dependencies", f"""with {_ENTITIES}, pairs as (
        select b.doc_id, b.idx, a.idx as before, a.step_id as earlier
        from named b join named a on a.doc_id = b.doc_id and a.idx < b.idx
        where {_contains_any('lower(b.step)', x.NOTIFYING_WORDS)}
           or (a.table_name is not null and {_contains_any('lower(b.step)', x.CONSUMING_WORDS)}))
    select n.doc_id, n.idx, n.step_id, coalesce(string_agg(earlier, ',' order by before), '') as depends_on
    from named n left join pairs p on p.doc_id = n.doc_id and p.idx = n.idx group by 1, 2, 3""")
def step_dependencies(t):
    deps = o.step_dependencies(t.descriptions_v)
    return deps.withColumn("depends_on", F.array_join("depends_on", ","))


@plan("step_waits", f"""with {_ENTITIES}
    select doc_id, idx, step_id, table_name is not null as names_table,
           case when {_contains_any('lower(step)', x.NOTIFYING_WORDS)} then 'all'
                when {_contains_any('lower(step)', x.CONSUMING_WORDS)} then 'tables' else 'none' end as waits_for
    from named""")
def step_waits(t):
    return o.step_waits(t.descriptions_v)


def _stage_rows(stages) -> str:
    return " union all ".join(
        f"select doc_id, text, {i} as ord, {cols} from w where list_has_any(words, [{_quoted(ws)}])"
        for i, (cols, ws) in enumerate(stages, start=1)
    )


_WORD_LIST = r"w as (select doc_id, text, string_split_regex(lower(text), '\s+') as words from descriptions_v)"
_STAGE_SQL = _stage_rows([
    (f"'{n}_data' as task, '{'python' if n in x.PYTHON_STAGES else 'postgresql'}' as operator", ws)
    for n, ws in x.STAGES.items()
])


@plan("keyword_stages", f"""with {_WORD_LIST},
    s as ({_STAGE_SQL} union all select doc_id, text, 0, 'init', 'dummy' from w
          union all select doc_id, text, 99, 'done', 'dummy' from w)
    select doc_id, cast(row_number() over o - 1 as int) as pos, task, operator,
           coalesce(lag(task) over o, 'none') as depends_on
    from s window o as (partition by doc_id order by ord)""")
def keyword_stages(t):
    return o.keyword_stages(t.descriptions_v)


_FALLBACK_SQL = _stage_rows([
    (f"'{n}' as name, '{k}' as type, '{d}' as description", ws) for n, k, d, ws in x.FALLBACK_STAGES
])


@plan("stage_fallback", f"""with {_WORD_LIST}, s as ({_FALLBACK_SQL})
    select doc_id, name || '_' || cast(row_number() over (partition by doc_id order by ord) as varchar) as name,
           type, description from s
    union all select doc_id, 'execute_pipeline', 'generic', text from descriptions_v
    where doc_id not in (select doc_id from s)""")
def stage_fallback(t):
    return o.stage_fallback(t.descriptions_v)


@plan("default_tasks", f"""
    with k as (select *, case when {_contains_any('lower(text)', x.DATA_WORDS)} then 'data'
                   when {_contains_any('lower(text)', x.MODEL_WORDS)} then 'model' else 'one' end as kind
               from descriptions_v),
    c as (select * from (values
        ('data', 'extract_data', 'Extract data from source', null),
        ('data', 'transform_data', 'Transform and clean data', 'extract_data'),
        ('data', 'load_data', 'Load data to destination', 'transform_data'),
        ('model', 'prepare_data', 'Prepare training data', null),
        ('model', 'train_model', 'Train ML model', 'prepare_data'),
        ('model', 'evaluate_model', 'Evaluate model performance', 'train_model'),
        ('one', 'execute_task', null, null)) t(kind, task_id, description, upstream))
    select doc_id, task_id, 'PythonOperator' as operator, coalesce(description, text) as description, upstream
    from k join c using (kind)""")
def default_tasks(t):
    return o.default_tasks(t.descriptions_v)


@plan("operator_and_resources", """
    select dag_id, task_id, task_type,
           case when contains(lower(task_type), 'bash') or contains(lower(task_type), 'shell') then 'BashOperator'
                when contains(lower(task_type), 'http') or contains(lower(task_type), 'api') then 'SimpleHttpOperator'
                when contains(lower(task_type), 'sql') then 'SqlOperator' else 'PythonOperator' end as operator,
           cast(case when h then 4 when m then 2 else 1 end as int) as est_cpu,
           case when h then '16Gi' when m then '8Gi' else '2Gi' end as est_memory,
           cast(case when h then 1 else 0 end as int) as est_gpu,
           case when h then 'nvidia-tesla-t4' end as est_gpu_type
    from (select *, regexp_matches(lower(task_type), 'train|model|gpu') as h,
                 regexp_matches(lower(task_type), 'etl|process') as m from pipeline_tasks_v)""")
def operator_and_resources(t):
    return o.operator_and_resources(t.pipeline_tasks_v.select("dag_id", "task_id", "task_type"))


@plan("slug_ids", f"""
    select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '\\b[a-zA-Z]+\\b'),
        lambda w: len(w) > 2 and w not in ({_quoted(x.STOP_WORDS)}))[1:4], '_') || '_20240131' as slug
    from descriptions_v""")
def slug_ids(t):
    return o.slug_ids(t.descriptions_v, date(2024, 1, 31))


@plan("token_estimate", f"""
    select doc_id, cast(len(list_filter(string_split_regex(text, '{x.SPACE}'), lambda w: w <> '')) as int) as words,
           len(list_filter(string_split_regex(text, '{x.SPACE}'), lambda w: w <> '')) * 1.3::double as tokens
    from documents""")
def token_estimate(t):
    return o.token_estimate(t.documents).select("doc_id", "words", "tokens")


_AVAILABLE = ("codellama-7b", "phi3-mini", "wizardcoder-7b")


@plan("route_prompts", f"""
    select request_id, prompt, case when {_contains_any('lower(prompt)', x.PYTHON_WORDS)} then 'wizardcoder-7b'
        when {_contains_any('lower(prompt)', x.REASONING_WORDS)} then 'phi3-mini' else 'phi3-mini' end as routed_to
    from llm_requests_v""")
def route_prompts(t):
    return o.route_prompts(t.llm_requests_v.select("request_id", "prompt"), _AVAILABLE)


_TASK_TYPES = [*x.MODEL_FOR_TASK, "poetry"]
_TASK_CASE = "case p_partkey % 9 " + " ".join(
    f"when {i} then '{n}'" for i, n in enumerate(_TASK_TYPES)) + " end"


@plan("recommend_model", f"""
    select p_partkey as task_id, {_TASK_CASE} as task_type,
           case when {_TASK_CASE} in ('sql_generation', 'python_code', 'testing', 'error_debugging')
                then 'codellama:7b' else 'phi3' end as recommended
    from part""")
def recommend_model(t):
    tasks = t.part.select(
        F.col("p_partkey").alias("task_id"), F.expr(_TASK_CASE).alias("task_type")
    )
    return o.recommend_model(tasks, ("codellama:7b", "phi3"))
