"""Workflow history, error logs and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as m
from ..operators import recovery as r
from ..operators import runs as h
from .commerce import _REVENUE, _revenue
from .registry import plan

_COST = """
    select run_id, cast(sum(cast(duration_s / 3600 * case
        when gpu = 'a100' then 3.5::double when gpu = 'v100' then 2.2::double
        when gpu = 't4' then 0.75::double when gpu is not null then 1.0::double
        else 0.1::double * cpu end as decimal(18,9))) as double) as cost
    from task_runs_v group by run_id"""


@plan("run_cost", _COST)
def run_cost(t):
    return h.run_cost(t.task_runs_v)


@plan("run_metrics", f"""
    with c as ({_COST}),
    l as (select *, row_number() over (partition by dag_id order by start_ts desc, run_id desc) as rn
          from runs_v)
    select dag_id, count(*) as runs,
           cast(sum(epoch_us(end_ts) - epoch_us(start_ts)) as double) / (count(*) * 1e6::double) as avg_runtime_s,
           cast(count(*) filter (where state = 'success') as double) / count(*) as success_rate,
           cast(sum(cast(cost as decimal(18,9))) as double) / count(*) as cost_per_run
    from l join c using (run_id) where rn <= 100 group by 1""")
def run_metrics(t):
    return h.run_metrics(t.runs_v, h.run_cost(t.task_runs_v))


@plan("resource_utilization", """
    select dag_id, cast(sum(cast(cpu_pct as decimal(18,9))) as double) / count(*) as cpu_avg,
           max(cpu_pct) as cpu_max,
           cast(sum(cast(memory_mb as decimal(18,9))) as double) / count(*) as mem_avg,
           max(memory_mb) as mem_max
    from task_runs_v group by 1""")
def resource_utilization(t):
    use = h.resource_utilization(t.task_runs_v)
    return use.select(
        "dag_id",
        *[F.col("utilization")[n].alias(n) for n in ("cpu_avg", "cpu_max", "mem_avg", "mem_max")],
    )


@plan("bottlenecks", """
    with s as (select dag_id, task_id, cast(sum(cast(duration_s as decimal(18,9))) as double) as runtime_s
               from task_runs_v group by 1, 2),
    d as (select dag_id, cast(sum(cast(duration_s as decimal(18,9))) as double) as total
          from task_runs_v group by 1)
    select dag_id, task_id, runtime_s, cast(position as int) as position,
           runtime_s / total as runtime_share
    from (select *, dense_rank() over (partition by dag_id order by runtime_s desc) as position from s)
    join d using (dag_id) where position <= 3""")
def bottlenecks(t):
    return h.bottlenecks(t.task_runs_v, 3)


@plan("predict_failures", """
    with l as (select *, row_number() over (partition by dag_id, task_id
                   order by start_ts desc, attempt_id desc) as rn from task_runs_v),
    p as (select dag_id, task_id,
                 cast(count(*) filter (where state = 'failed') as double) / count(*) as failure_probability,
                 cast(sum(cast(duration_s as decimal(18,9))) as double) / count(*) as expected_time_s
          from l where rn <= 20 group by 1, 2)
    select *, case when failure_probability >= 0.5 then 'pause and inspect'
                   when failure_probability >= 0.3::double then 'add retries' else 'watch' end as recommendation
    from p where failure_probability > 0.2::double""")
def predict_failures(t):
    return h.predict_failures(t.task_runs_v)


@plan("runtime_trend", """
    with n as (select *, row_number() over w as run_number, lag(duration_s) over w as previous_s,
                      cast(sum(cast(duration_s as decimal(18,9))) over f as double) / count(*) over f
                          as rolling_mean_s
               from task_runs_v
               window w as (partition by dag_id, task_id order by start_ts, attempt_id),
                      f as (partition by dag_id, task_id order by start_ts, attempt_id
                            rows between 4 preceding and current row)),
    s as (select dag_id, task_id, round(regr_slope(duration_s, run_number), 6) as slope from n group by 1, 2)
    select dag_id, task_id, start_ts, attempt_id, duration_s, run_number, previous_s, rolling_mean_s, slope
    from n join s using (dag_id, task_id)""")
def runtime_trend(t):
    return h.runtime_trend(t.task_runs_v)


@plan("retry_schedule", """
    with n as (select *, row_number() over (partition by call_key order by ts, attempt_id) - 1 as attempt
               from attempts_v)
    select call_key, attempt_id, attempt,
           case when attempt >= 3 then 0.0::double else cast(pow(2, attempt) as double) end as delay_s,
           case when attempt = 0 then 1.0::double when attempt = 1 then 3.0::double else 7.0::double end
               as total_wait_s,
           attempt >= 3 as exhausted
    from n""")
def retry_schedule(t):
    return h.retry_schedule(t.attempts_v)


# ---- errors --------------------------------------------------------------

CLASSIFIED = """
    classified as (select *, case
        when error_class in ('ImportError', 'ModuleNotFoundError') or contains(lower(message), 'no module named')
            then 'import_error'
        when error_class = 'MemoryError' or contains(lower(message), 'out of memory') then 'memory_error'
        when contains(lower(message), 'connection') or contains(lower(message), 'timeout') then 'connection_error'
        when contains(lower(message), 'permission denied') or contains(lower(message), 'access denied')
            then 'permission_error'
        when contains(lower(message), 'resource') or contains(lower(message), 'limit exceeded')
            then 'resource_error'
        when contains(lower(message), 'data') or contains(lower(message), 'format') then 'data_error'
        else 'unknown' end as error_type,
        nullif(split_part(coalesce(nullif(regexp_extract(message, 'No module named ''([^'']+)''', 1), ''),
                 nullif(regexp_extract(message, 'No module named ([^\\s]+)', 1), ''),
                 nullif(regexp_extract(message, 'ImportError: cannot import name ''([^'']+)''', 1), '')),
            '.', 1), '') as module,
        case when memory like '%Gi' then cast(cast(left(memory, length(memory) - 2) as bigint) * 2 as varchar) || 'Gi'
             when memory like '%G' then cast(cast(left(memory, length(memory) - 1) as bigint) * 2 as varchar) || 'G'
             else '8Gi' end as new_memory,
        cast(least(cpu * 2, 8) as int) as new_cpu
        from errors_v),
    planned as (select *, case error_type
        when 'import_error' then case when module is null then 'Check import paths and package installation'
             else 'Install missing package: ' || module end
        when 'memory_error' then 'Increase memory allocation to ' || new_memory
        when 'connection_error' then 'Implement exponential backoff retry'
        when 'permission_error' then 'Check file permissions and ownership'
        when 'resource_error' then 'Increase CPU allocation to ' || cast(new_cpu as varchar) || ' cores'
        else 'Manual intervention required' end as suggested_fix,
        cast(case error_type when 'import_error' then case when module is null then 0.5 else 0.9 end
             when 'memory_error' then 0.8 when 'connection_error' then 0.7 when 'permission_error' then 0.6
             when 'resource_error' then 0.7 else 0.1 end as double) as confidence,
        case error_type when 'import_error' then module is not null when 'memory_error' then true
             when 'connection_error' then true when 'resource_error' then true else false end as auto_fixable,
        case when error_type = 'import_error' and module is not null then 'pip install ' || module
             when error_type = 'connection_error' then 'retry_with_backoff' end as fix_command,
        case when error_type = 'memory_error' then 'memory=' || new_memory
             when error_type = 'resource_error' then 'cpu=' || cast(new_cpu as varchar) end as adjustment
        from classified)"""

FIX_COLUMNS = "error_id, error_type, suggested_fix, confidence, auto_fixable, fix_command, adjustment"


def flat_plan(planned):
    """The remedy with its settings as text, for comparison."""
    settings = F.transform(
        F.map_entries("adjustment"), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    text = F.when(F.col("adjustment").isNotNull(), F.array_join(settings, ","))
    return planned.withColumn("adjustment", text).select(*FIX_COLUMNS.split(", "))


@plan("classify_errors", f"with {CLASSIFIED} select error_id, error_class, message, error_type from classified")
def classify_errors(t):
    return r.classify_errors(t.errors_v).select("error_id", "error_class", "message", "error_type")


@plan("missing_modules", f"with {CLASSIFIED} select error_id, module from classified")
def missing_modules(t):
    return r.missing_modules(t.errors_v).select("error_id", "module")


@plan("fix_plan", f"with {CLASSIFIED} select {FIX_COLUMNS} from planned")
def fix_plan(t):
    return flat_plan(r.fix_plan(t.errors_v))


@plan("scale_resources", f"with {CLASSIFIED} select error_id, memory, cpu, new_memory, new_cpu from classified")
def scale_resources(t):
    return r.scale_resources(t.errors_v).select("error_id", "memory", "cpu", "new_memory", "new_cpu")


@plan("fix_success_rate", f"""with {CLASSIFIED}
    select error_type, count(*) as attempts, count(*) filter (where k < 70) as successes,
           cast(count(*) filter (where k < 70) as double) / count(*) as success_rate
    from classified group by 1""")
def fix_success_rate(t):
    return r.fix_success_rate(r.classify_errors(t.errors_v).withColumn("success", F.col("k") < 70))


@plan("error_breakdown", f"""with {CLASSIFIED}
    select coalesce(error_type, 'all') as error_type, count(*) as errors,
           cast(count(*) filter (where auto_fixable) as double) / count(*) as auto_fixable_share
    from planned group by rollup (error_type)""")
def error_breakdown(t):
    return r.error_breakdown(t.errors_v)


# ---- alerts --------------------------------------------------------------


@plan("threshold_alerts", """
    select attempt_id, dag_id, task_id, 'duration_s' as metric, duration_s as value,
           1500::double as threshold from task_runs_v where duration_s > 1500
    union all select attempt_id, dag_id, task_id, 'memory_mb', memory_mb, 4000::double
    from task_runs_v where memory_mb > 4000
    union all select attempt_id, dag_id, task_id, 'cpu_pct', cpu_pct, 90::double
    from task_runs_v where cpu_pct > 90""")
def threshold_alerts(t):
    return m.threshold_alerts(t.task_runs_v, {"duration_s": 1500, "memory_mb": 4000, "cpu_pct": 90})


@plan("observed_metrics", """
    select count(*) as row_count, cast(sum(cast(duration_s as decimal(18,9))) as double) as total_s,
           count(*) - count(gpu) as no_gpu from task_runs_v""")
def observed_metrics(t):
    return m.observed_metrics(t.task_runs_v, {
        "row_count": F.count(F.lit(1)),
        "total_s": F.sum(F.col("duration_s").cast("decimal(18,9)")).cast("double"),
        "no_gpu": F.count_if(F.col("gpu").isNull()),
    })


@plan("sla_breaches", """
    select run_id, dag_id, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 as runtime_s,
           (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 > 2400 as sla_missed,
           (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 > 1200 as timed_out
    from runs_v where (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 > 1200""")
def sla_breaches(t):
    return m.sla_breaches(t.runs_v, 2400, 1200)


@plan("alert_digest", f"""
    with rev as ({_REVENUE}),
    hi as (select order_day, '[' || string_agg(cast(customer_id as varchar), ',' order by position) || ']' as hv
           from (select *, row_number() over (partition by order_day
                     order by daily_revenue desc, customer_id) as position
                 from rev where daily_revenue > 200000) where position <= 3 group by 1)
    select rev.order_day, cast(sum(cast(daily_revenue as decimal(18,2))) as double) as total_revenue,
           count(*) as customers, coalesce(min(hv), '[]') as high_value
    from rev left join hi on hi.order_day = rev.order_day group by 1""")
def alert_digest(t):
    return m.alert_digest(_revenue(t), 3, 200000)


@plan("throttle_alerts", """
    select task_key, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as bucket,
           min(ts) as ts, arg_min(error_id, ts) as error_id, count(*) - 1 as suppressed
    from errors_v group by 1, 2""")
def throttle_alerts(t):
    return m.throttle_alerts(t.errors_v, "task_key", "ts", "6 hours")


@plan("rolling_anomalies", """
    with w as (select user_id, ts, event_id, value, count(value) over f as n,
                      cast(sum(cast(value as decimal(18,4))) over f as double) as s,
                      cast(sum(cast(cast(value as decimal(18,4)) * cast(value as decimal(18,4))
                           as decimal(38,8))) over f as double) as q
               from events window f as (partition by user_id order by ts, event_id
                                        rows between 20 preceding and 1 preceding)),
    z as (select *, round(abs(value - s / n) / nullif(sqrt(greatest(q - s * (s / n), 0) / (n - 1)), 0), 6) as zscore
          from w where n = 20)
    select user_id, ts, event_id, value, zscore from z where zscore > 3""")
def rolling_anomalies(t):
    return m.rolling_anomalies(t.events, "user_id", ["ts", "event_id"], "value", 20, 3.0)


@plan("market_indicators", """
    select user_id, hour, total, round(avg(total) over f, 6) as moving_avg,
           (total - lag(total) over w) / nullif(lag(total) over w, 0) as lag_return,
           round(stddev_samp(total) over f, 4) as volatility
    from series_v window w as (partition by user_id order by hour),
        f as (partition by user_id order by hour rows between 4 preceding and current row)""")
def market_indicators(t):
    return m.market_indicators(t.series_v, "user_id", "hour", "total", 5)
