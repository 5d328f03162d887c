"""Streams, checked against the same question asked of the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..session import materialise, scratch_path
from ..streaming import jobs as j
from ..streaming.runner import StreamTables, open_stream, run_append, run_complete, run_updates
from .commerce import _metrics
from .registry import plan
from .runs import CLASSIFIED, FIX_COLUMNS, flat_plan


def _live(t) -> StreamTables:
    return StreamTables(t.spark, t.folder)


_WINDOW_COLUMNS = """event_type, count(*) as events,
    cast(sum(cast(value as decimal(18,9))) as double) as total, max(value) as largest"""


@plan("stream_tumbling", f"""
    select date_trunc('hour', ts)::timestamp as window_start,
           date_trunc('hour', ts)::timestamp + interval 1 hour as window_end, {_WINDOW_COLUMNS}
    from events group by 1, 2, event_type""")
def stream_tumbling(t):
    return run_updates(j.stream_tumbling(_live(t).events, "1 hour", "2 hours"), j.WINDOW_KEYS, "tumbling")


@plan("stream_sliding", f"""
    with s as (select *, unnest([0, 1]) as back from events)
    select date_trunc('hour', ts)::timestamp - back * interval 1 hour as window_start,
           date_trunc('hour', ts)::timestamp - back * interval 1 hour + interval 2 hour as window_end,
           {_WINDOW_COLUMNS}
    from s group by 1, 2, event_type""")
def stream_sliding(t):
    return run_updates(j.stream_sliding(_live(t).events, "2 hours", "1 hour", "2 hours"), j.WINDOW_KEYS, "sliding")


@plan("stream_dedupe", "select event_id, ts, user_id, event_type, value from events")
def stream_dedupe(t):
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    live = _live(t)
    twice = live.events.select(*columns).unionAll(live.events.select(*columns))
    return run_append(j.stream_dedupe(twice, ["event_id"], "1 hour"), "dedupe")


_CHUNK = """case when ts < timestamp '2024-01-11' then 0 when ts < timestamp '2024-01-21' then 1 else 2 end"""
_ARRIVED = f"""
    arrived as (select event_id, {_CHUNK} as chunk,
        case when event_type = 'error' and ts >= timestamp '2024-01-11' then ts - interval 3 day
             when event_type = 'view' and ts >= timestamp '2024-01-11' then ts - interval 90 minute
             else ts end as ts from events)"""


@plan("stream_late_data", f"""with {_ARRIVED},
    tops as (select chunk, max(ts) as top from arrived group by 1),
    seen as (select a.chunk, max(b.top) as newest from tops a left join tops b on b.chunk < a.chunk group by 1),
    x as (select a.chunk, newest is not null and ts < newest as late,
                 newest is not null and date_trunc('hour', ts)::timestamp + interval 1 hour
                     <= date_trunc('millisecond', newest) - interval 2 hour as dropped
          from arrived a join seen s on s.chunk = a.chunk)
    select cast(chunk as int) as chunk, count(*) filter (where not late) as on_time,
           count(*) filter (where late and not dropped) as late_kept,
           count(*) filter (where dropped) as late_dropped
    from x group by 1""")
def stream_late_data(t):
    start = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    ts, after = F.col("ts"), F.col("ts") >= start(11)
    moved = (
        F.when((F.col("event_type") == "error") & after, ts - F.expr("interval 3 days"))
        .when((F.col("event_type") == "view") & after, ts - F.expr("interval 90 minutes"))
        .otherwise(ts)
    )
    rows = t.events.select("event_id", moved.alias("ts"), F.expr(_CHUNK.replace(
        "timestamp '", "timestamp_ntz '")).alias("chunk"))
    chunks = [rows.where(F.col("chunk") == i).drop("chunk") for i in range(3)]
    return j.stream_late_data(chunks, "1 hour", "2 hours")


_FEATURES = """
    f as (select user_id, cast(sum(cast(value as decimal(18,9))) as double) / count(*) as mean,
                 cast(count(*) filter (where event_type = 'error') as double) / count(*) as error_share,
                 stddev_samp(value) as deviation
          from events group by 1)"""


@plan("stream_fraud_alerts", f"""with {_FEATURES},
    s as (select event_id, user_id, ts, value,
                 round(1 / (1 + exp(-((value - mean) / mean + 2 * error_share - 2))), 9) as score
          from events join f using (user_id))
    select * from s where score > 0.8::double""")
def stream_fraud_alerts(t):
    # Written once: every micro-batch joins the finished table, not its aggregation.
    features = materialise(f.fraud_features(t.events).select("user_id", "mean", "error_share"), "features")
    return run_append(j.stream_fraud_alerts(_live(t).events, features), "fraud")


@plan("stream_sensor_anomalies", f"""with {_FEATURES},
    s as (select event_id, user_id, ts, value, round(abs(value - mean) / nullif(deviation, 0), 6) as zscore
          from events join f using (user_id))
    select *, case when zscore > 5 then 'maintenance' else 'watch' end as action from s where zscore > 2.5""")
def stream_sensor_anomalies(t):
    baseline = materialise(j.sensor_baseline(t.events), "baseline")
    return run_append(j.stream_sensor_anomalies(_live(t).events, baseline, 2.5), "sensors")


@plan("stream_classify_errors", f"with {CLASSIFIED} select {FIX_COLUMNS} from planned")
def stream_classify_errors(t):
    planned = flat_plan(j.stream_classify_errors(_live(t).errors_v))
    return run_append(planned, "errors")


@plan("stream_model_metrics", """
    select model, count(*) as requests,
           cast(sum(cast(latency_ms as decimal(18,9))) as double) / count(*) as avg_latency_ms,
           cast(count(*) filter (where success) as double) / count(*) as success_rate
    from llm_requests_v group by 1""")
def stream_model_metrics(t):
    return run_complete(j.stream_model_metrics(_live(t).llm_requests_v), "models")


@plan("stream_circuit_breaker", """
    with recursive c as (
        select dag_id || '/' || task_id as task, start_ts as ts, state = 'success' as ok,
               row_number() over (partition by dag_id, task_id order by start_ts, attempt_id) as rn
        from task_runs_v),
    w as (
        select task, rn, ts, false as is_open, case when ok then 0 else 1 end as straight, ts as since,
               0 as what from c where rn = 1
        union all
        select task, rn, ts,
               case when blocked then true when was_open then not ok else not ok and straight >= 1 end,
               case when blocked then straight when was_open or ok or straight >= 1 then 0 else straight + 1 end,
               case when not blocked and not ok and (was_open or straight >= 1) then ts else since end,
               case when blocked then 0 when was_open then case when ok then 2 else 3 end
                    when not ok and straight >= 1 then 1 else 0 end
        from (select c.task, c.rn, c.ts, c.ok, w.is_open as was_open, w.straight, w.since,
                     w.is_open and c.ts < w.since + interval 6 hours as blocked
              from w join c on c.task = w.task and c.rn = w.rn + 1))
    select task, ts, 'open' as state from w where what in (1, 3)
    union all select task, ts, 'half_open' from w where what in (2, 3)
    union all select task, ts, 'closed' from w where what = 2""")
def stream_circuit_breaker(t):
    live = StreamTables(t.spark, t.folder, 512 << 20)
    runs = live.task_runs_v.withColumn("task", F.concat_ws("/", "dag_id", "task_id"))
    return j.stream_circuit_breaker(runs, "task", 2, 6 * 3600.0)


@plan("stream_upsert_metrics", """
    select customer_id, cast(sum(cast(total_amount as decimal(18,2))) as double) as lifetime_value,
           count(*) as order_count, max(order_date) as last_order from orders_v group by 1""")
def stream_upsert_metrics(t):
    inbox, target = scratch_path(t.spark, "orders-in"), scratch_path(t.spark, "metrics")
    state = scratch_path(t.spark, "upsert-state")
    orders = t.orders_v
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    date = F.col("order_date")
    chunks = [date < day("1998-01-01"), (date >= day("1998-01-01")) & (date < day("2001-06-01")),
              date >= day("2001-06-01")]
    out = None
    for n, rows in enumerate(chunks):
        orders.where(rows).write.parquet(f"{inbox}/chunk={n}")
        stream = open_stream(t.spark, f"{inbox}/chunk=*", orders.schema)
        out = j.stream_upsert_metrics(stream, target, _metrics, ["customer_id"], state)
    return out
