"""Business tables derived from the stored ones.

Each view is one portable SELECT. Spark runs it over DataFrames, and the checks
run the same text elsewhere, so only the operators under test differ. ``{name}``
stands for a stored table or another view. ``@epoch(x)`` is whole seconds since
1970, ``@later[x | us]`` moves a timestamp by microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"

VIEWS: dict[str, str] = {
    "orders_v": """
        select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_date,
               o_totalprice as total_amount,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'open'
                    else 'pending' end as status
        from {orders}""",
    "customers_v": """
        select c_custkey as customer_id, c_name as name, c_mktsegment as segment,
               c_acctbal as balance, c_nationkey as nation_key
        from {customer}""",
    "items_v": """
        select l_orderkey as order_id, l_partkey as product_id, l_linenumber as line,
               l_quantity as quantity, l_extendedprice / nullif(l_quantity, 0) as unit_price
        from {lineitem}""",
    "dirty_orders_v": """
        select order_id,
               case when order_id % 89 = 0 then customer_id + 10000000 else customer_id end
                   as customer_id,
               case when order_id % 79 = 0 then null else order_date end as order_date,
               case when order_id % 97 = 0 then -total_amount else total_amount end
                   as total_amount,
               status
        from {orders_v}
        union all
        select order_id,
               case when order_id % 89 = 0 then customer_id + 10000000 else customer_id end,
               case when order_id % 79 = 0 then null else order_date end,
               case when order_id % 97 = 0 then -total_amount else total_amount end,
               status
        from {orders_v} where order_id % 83 = 0""",
    "task_runs_v": f"""
        select event_id as attempt_id,
               'dag_' || cast(user_id % 5 as string) as dag_id,
               'task_' || cast(event_id % 7 as string) as task_id,
               'dag_' || cast(user_id % 5 as string) || '_'
                   || cast(cast(floor(@epoch(ts) / 3600) as bigint) as string) as run_id,
               ts as start_ts,
               @later[ts | cast(round(value * 100) as bigint) * 100000] as end_ts,
               round(value * 10, 2) as duration_s,
               case when event_type = 'error' then 'failed' else 'success' end as state,
               cast(1 + event_id % 8 as int) as cpu,
               case event_id % 10 when 0 then 'a100' when 1 then 'v100' when 2 then 't4'
                    when 3 then 'h100' end as gpu,
               cast({_K} as double) as cpu_pct,
               value * 40 as memory_mb
        from {{events}}""",
    "runs_v": """
        select run_id, min(dag_id) as dag_id, min(start_ts) as start_ts, max(end_ts) as end_ts,
               case when max(case when state = 'failed' then 1 else 0 end) = 1
                    then 'failed' else 'success' end as state
        from {task_runs_v} group by run_id""",
    "errors_v": f"""
        select event_id as error_id, ts, user_id as task_key,
               case event_id % 10 when 0 then 'ModuleNotFoundError' when 1 then 'Exception'
                    when 2 then 'ImportError' when 3 then 'MemoryError'
                    when 4 then 'ConnectionError' when 5 then 'TimeoutError'
                    when 6 then 'OSError' else 'RuntimeError' end as error_class,
               case event_id % 10
                    when 0 then 'No module named ''alpha_' || cast(user_id as string) || '.io.core'''
                    when 1 then 'No module named beta_' || cast(user_id as string) || '.util here'
                    when 2 then 'ImportError: cannot import name ''gamma'' from package'
                    when 3 then 'worker ' || cast(user_id as string) || ' ran Out Of Memory'
                    when 4 then 'Connection refused, permission denied by peer'
                    when 5 then 'request TIMEOUT after 30 s'
                    when 6 then 'Permission denied: /srv/' || cast(user_id as string)
                    when 7 then 'quota Limit Exceeded for pool'
                    when 8 then 'bad date format in line ' || cast(event_id as string)
                    else 'something odd happened' end as message,
               case event_id % 5 when 0 then '2Gi' when 1 then '16Gi' when 2 then '4G'
                    when 3 then '512Mi' else '8' end as memory,
               cast(1 + user_id % 8 as int) as cpu,
               {_K} as k
        from {{events}} where event_type = 'error'""",
    "attempts_v": """
        select event_id as attempt_id, ts,
               cast(user_id as string) || '/' || cast(cast(ts as date) as string) as call_key
        from {events}""",
    "requirements_v": """
        select p_partkey as req_id, p_partkey % 20 as pool,
               cast(1 + p_size % 16 as int) as cpu,
               case p_partkey % 4
                    when 0 then cast(2 * (1 + p_size % 32) as string) || 'Gi'
                    when 1 then cast(2 * (1 + p_size % 32) as string) || 'G'
                    when 2 then cast(2048 * (1 + p_size % 32) as string) || 'Mi'
                    else cast(2 * (1 + p_size % 32) as string) end as memory,
               case p_partkey % 6 when 0 then 'nvidia-tesla-t4' when 1 then 'nvidia-tesla-v100'
                    when 2 then 'nvidia-a100' when 3 then 'nvidia-h100'
                    when 4 then 'unlisted-gpu' end as gpu,
               cast(600 + 60 * p_size as bigint) as estimated_runtime
        from {part}""",
    "spot_history_v": """
        select case user_id % 4 when 0 then 'aws' when 1 then 'gcp' when 2 then 'azure'
                    else 'coreweave' end as provider,
               event_type as instance_type,
               'zone-' || cast(user_id % 3 as string) as zone,
               value > 150 as interrupted
        from {events}""",
    "spot_keys_v": """
        select distinct provider, instance_type, zone from {spot_history_v}
        union
        select distinct provider, instance_type, 'zone-9' from {spot_history_v}""",
    "descriptions_v": """
        select p_partkey as doc_id,
               case p_partkey % 8
               when 0 then 'Extract ' || p_name || ' rows from the ' || lower(p_type)
                    || '_orders table in postgresql. Validate data quality and schema. '
                    || 'Load results into warehouse_' || lower(p_type)
                    || '; notify the team by email.'
               when 1 then 'Read ' || p_name || ' csv files from s3. Clean the data and filter '
                    || 'bad rows; write parquet to archive_' || lower(p_type) || ' table'
               when 2 then 'Train a model on ' || p_brand || ' sales. Score rows with the model. '
                    || 'Send a slack alert with the summary'
               when 3 then 'Query the mysql database for ' || p_name || '. Aggregate totals in sql. '
                    || 'Create a materialized view of ' || lower(p_type) || '; publish the report'
               when 4 then 'Call the pricing API endpoint for ' || p_brand
                    || '.  Transform it with business rules; ; Store json in snowflake table totals'
               when 5 then p_name || ' ' || p_brand
               when 6 then ''
               else 'Fetch html pages of ' || p_name || '. Process them; check values. '
                    || 'Copy file to gcs; explain why. Load, then email' end as text
        from {part}""",
    "pipeline_tasks_v": """
        select cast(floor(p_partkey / 8) as bigint) as dag_id, cast(p_partkey % 8 as int) as pos,
               't' || cast(p_partkey % 8 as string) as task_id,
               case p_partkey % 8 when 0 then 'sql_extract' when 1 then 'bash_copy'
                    when 2 then 'http_pull' when 3 then 'etl_process' when 4 then 'train_model'
                    when 5 then 'gpu_score' when 6 then 'Shell_SQL' else '' end as task_type,
               split('item_' || cast(p_partkey % 8 as string), ',') as outputs,
               case when p_partkey % 8 = 0 then null
                    when p_partkey % 8 % 3 = 0 then
                        split('item_' || cast(cast(floor((p_partkey % 8 - 1) / 2) as bigint) as string)
                              || ',item_' || cast(p_partkey % 8 - 1 as string), ',')
                    else split('item_'
                         || cast(cast(floor((p_partkey % 8 - 1) / 2) as bigint) as string), ',')
               end as inputs,
               cast(1 + p_size % 4 as int) as cpu, cast(2 * (1 + p_size % 8) as int) as memory_gb
        from {part}""",
    "edges_v": """
        select dag_id, task_id,
               't' || cast(cast(floor((pos - 1) / 2) as bigint) as string) as upstream_id
        from {pipeline_tasks_v} where pos > 0
        union
        select dag_id, task_id, 't' || cast(pos - 1 as string)
        from {pipeline_tasks_v} where pos > 0 and pos % 3 = 0
        union
        select dag_id, task_id, task_id from {pipeline_tasks_v} where pos % 5 = 0
        union
        select dag_id, task_id, 't3' from {pipeline_tasks_v} where pos = 1 and dag_id % 50 = 0
        union
        select dag_id, task_id, 'missing' from {pipeline_tasks_v} where pos = 7 and dag_id % 30 = 0""",
    "llm_requests_v": f"""
        select event_id as request_id, ts,
               'model_' || cast(user_id % 6 as string) as model,
               case event_type when 'view' then 'Select totals from ledger '
                    when 'click' then 'write a python function '
                    when 'purchase' then 'explain why sales moved '
                    when 'signup' then 'hello there ' else 'lambda import fix ' end
                    || cast(event_id % 20 as string) as prompt,
               cast(128 * (1 + event_id % 2) as int) as max_tokens,
               cast(0.1 as double) as temperature,
               case when event_id % 50 = 0 then 0.0 else round(value * 10, 2) end as latency_ms,
               {_K} as tokens,
               event_type <> 'error' as success,
               cast(floor(event_id / 100) as bigint) as batch
        from {{events}}""",
    "llm_responses_v": """
        select o_orderkey as response_id,
               case o_orderkey % 6
               when 0 then '{{"dag_id": "flow_' || cast(o_orderkey as string)
                    || '", "description": "Load batch", "schedule_interval": "@hourly", "tasks": ['
                    || '{{"id": "pull", "operator": "SqlTask", "description": "Pull rows", "upstream_dependencies": []}}, '
                    || '{{"id": "push", "operator": "BashTask", "description": "Push rows", "upstream_dependencies": ["pull"]}}]}}'
               when 1 then '```json' || chr(10) || '{{"dag_id": "flow_' || cast(o_orderkey as string)
                    || '", "description": "Fenced", "schedule_interval": "@weekly", "tasks": ['
                    || '{{"id": "only", "operator": "SqlTask", "description": "One", "upstream_dependencies": []}}]}}'
                    || chr(10) || '```'
               when 2 then '```' || chr(10) || '{{"dag_id": "flow_' || cast(o_orderkey as string)
                    || '", "description": "Plain fence", "schedule_interval": "@daily", "tasks": []}}'
                    || chr(10) || '```'
               when 3 then '{{"dag_id": "flow_' || cast(o_orderkey as string)
                    || '", "description": "Trailing", "schedule_interval": "@hourly", "tasks": [' || chr(10)
                    || '{{"id": "a", "operator": "SqlTask", "description": "A", "upstream_dependencies": [],' || chr(10) || '}}' || chr(10)
                    || '{{"id": "b", "operator": "SqlTask", "description": "B", "upstream_dependencies": []}},' || chr(10)
                    || '],' || chr(10) || '}}'
               when 4 then '{{''dag_id'': ''flow_' || cast(o_orderkey as string)
                    || ''', ''description'': ''Bare'', ''schedule_interval'': ''@daily'', ''tasks'': ['
                    || '{{id: ''x'', hallmark: ''SqlTask'', description: ''X'', upstream_dependencies: []}}, '
                    || '{{id: ''y'', hallmark: ''BashTask'', description: ''Y'', upstream_dependencies: [''x'']}}]}}'
               else case when o_orderkey % 4 = 1 then 'The data flow: ["dag_id": "flow_' || cast(o_orderkey as string)
                    || '", tasks follow: "id": "m", "operator": "SqlTask", "description": "M" then '
                    || '"id": "n", "operator": "BashTask", "description": "N"'
                    when o_orderkey % 8 = 3 then 'sorry, nothing here'
                    else 'Plan {{id: ''p'', hallmark: ''SqlTask''}} and {{"id": "q", "description": "Q" etc'
                    || ' {{ "id": "r" }} "schedule_interval": "@monthly"' end end as text
        from {orders}""",
    "features_v": """
        select c.c_custkey as customer_id, o.income, cast(20 + c.c_custkey % 60 as double) as age,
               c.c_acctbal as credit_score, c.c_acctbal * 3 + 1 as account_balance,
               o.transaction_count, o.last_order, cast(7 as double) as constant
        from {customer} c left join (
            select o_custkey, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as income,
                   cast(count(*) as double) as transaction_count, max(o_orderdate) as last_order
            from {orders} group by o_custkey) o on c.c_custkey = o.o_custkey""",
    "labelled_v": """
        select d.doc_id, cast(length(d.text) as double) as chars,
               cast(length(d.text) - length(replace(d.text, ' ', '')) + 1 as double) as words,
               cast(length(d.text) as double)
                   / (length(d.text) - length(replace(d.text, ' ', '')) + 1) as word_length,
               cast(length(d.text) - length(translate(d.text, '0123456789', '')) as double)
                   / greatest(length(d.text), 1) as digit_share,
               cast(length(d.text) - length(replace(d.text, chr(10), '')) as double) as newlines,
               l.quality as label
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "predictions_v": """
        select event_id as id, ts, user_id % 6 as model_no,
               floor(least(value, 400.0) / 4) / 100 as score,
               case when value > 40 then 1 else 0 end as prediction,
               case when event_id % 3 = 0 then 1 else 0 end as label
        from {events}""",
    "variants_v": """
        select event_id, user_id, case when user_id % 2 = 0 then 'A' else 'B' end as variant,
               event_type = 'purchase' as converted
        from {events}""",
    "series_v": """
        select user_id, cast(floor(@epoch(ts) / 3600) as bigint) as hour,
               cast(sum(cast(value as decimal(18, 2))) as double) as total
        from {events} group by user_id, cast(floor(@epoch(ts) / 3600) as bigint)""",
    "lexicon_v": """
        select * from (values ('the', 1), ('of', -1), ('and', 1), ('in', -1), ('is', 1), ('to', -1),
            ('on', 1), ('that', -1), ('for', 1), ('was', -1), ('with', 1), ('are', -1),
            ('le', 1), ('la', -1), ('les', 1), ('des', -1), ('de', 1), ('un', -1), ('et', 1),
            ('que', -1), ('en', 1), ('qui', -1), ('elle', 1), ('dans', -1),
            ('der', 1), ('die', -1), ('und', 1), ('den', -1), ('von', 1), ('zu', -1),
            ('das', 1), ('mit', -1), ('el', 1), ('los', -1), ('por', 1), ('con', -1),
            ('una', 1), ('del', -1), ('se', 1), ('las', -1)) as t(word, polarity)""",
}

_EPOCH = re.compile(r"@epoch\((\w+)\)")
_LATER = re.compile(r"@later\[(\w+) \| (.+?)\]")
_NAME = re.compile(r"(?<!\{)\{(\w+)\}")


def spark_text(text: str) -> str:
    text = _EPOCH.sub(r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", text)
    return _LATER.sub(r"timestampadd(MICROSECOND, \2, \1)", text)


def _duckdb_clock(text: str) -> str:
    text = _EPOCH.sub(r"cast(floor(epoch(\1)) as bigint)", text)
    return _LATER.sub(r"(\1 + to_microseconds(\2))", text)


def duckdb_text(text: str) -> str:
    return _NAME.sub(r"\1", _duckdb_clock(text)).replace("{{", "{").replace("}}", "}")


class Tables:
    """The stored tables of one folder, and the views on them, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            text = spark_text(VIEWS[name])
            inputs = {n: getattr(self, n) for n in set(_NAME.findall(text))}
            return self.spark.sql(text, **inputs)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the views it mentions, as common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for inner in sorted(set(_NAME.findall(VIEWS[name])) & set(VIEWS)):
            visit(inner)
        if name not in needed:
            needed.append(name)

    for name in sorted(set(re.findall(r"\b\w+_v\b", sql)) & set(VIEWS)):
        visit(name)
    sql = _duckdb_clock(sql.strip())
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} as ({duckdb_text(VIEWS[n])})" for n in needed)
    head = re.match(r"with\s+(recursive\s+)?", sql, re.IGNORECASE)
    recursive = "recursive " if head and head.group(1) else ""
    rest = ", " + sql[head.end():] if head else " " + sql
    return f"with {recursive}{ctes}{rest}"
