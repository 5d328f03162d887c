"""Alert tables and metrics gathered on the side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import money_sum
from ..functions.unnest import unnest
from .ordered import with_preceding


def threshold_alerts(task_runs: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """One row per attempt and exceeded limit; a value at the limit is no alert."""
    checks = [
        F.when(
            F.col(c).cast("double") > limit,
            F.struct(
                F.lit(c).alias("metric"),
                F.col(c).cast("double").alias("value"),
                F.lit(float(limit)).alias("threshold"),
            ),
        )
        for c, limit in limits.items()
    ]
    found = F.array_compact(F.array(*checks))
    return unnest(task_runs, ["attempt_id", "dag_id", "task_id"], found, "metric")


def observed_metrics(df: DataFrame, checks: Mapping[str, Column], name: str = "checks") -> DataFrame:
    """Metrics collected while ``df`` is read once; nothing is stored."""
    seen = Observation(name)
    spark = df.sparkSession
    observed = df.observe(seen, *[c.alias(k) for k, c in checks.items()])
    observed.write.format("noop").mode("overwrite").save()
    schema = df.agg(*[c.alias(k) for k, c in checks.items()]).schema
    return spark.createDataFrame([tuple(seen.get[k] for k in checks)], schema)


def sla_breaches(runs: DataFrame, sla_s: float = 14400, timeout_s: float = 7200) -> DataFrame:
    """Runs longer than the agreed time or the time-out."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / 1e6
    return (
        runs.withColumn("runtime_s", seconds)
        .where(F.col("runtime_s") > min(sla_s, timeout_s))
        .select(
            "run_id", "dag_id", "runtime_s",
            (F.col("runtime_s") > sla_s).alias("sla_missed"),
            (F.col("runtime_s") > timeout_s).alias("timed_out"),
        )
    )


def alert_digest(revenue: DataFrame, k: int, threshold: float) -> DataFrame:
    """Per day: totals and, as JSON, the top ``k`` customers above the threshold."""
    best = Window.partitionBy("order_day").orderBy(F.desc("daily_revenue"), "customer_id")
    high = (
        revenue.where(F.col("daily_revenue") > threshold)
        .withColumn("position", F.row_number().over(best))
        .where(F.col("position") <= k)
        .groupBy("order_day")
        .agg(F.sort_array(F.collect_list(F.struct("position", "customer_id"))).alias("_high"))
    )
    totals = revenue.groupBy("order_day").agg(
        money_sum("daily_revenue").alias("total_revenue"),
        F.count(F.lit(1)).alias("customers"),
    )
    payload = F.to_json(F.transform("_high", lambda h: h["customer_id"]))
    return totals.join(high, "order_day", "left").select(
        "order_day", "total_revenue", "customers", F.coalesce(payload, F.lit("[]")).alias("high_value")
    )


def throttle_alerts(alerts: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """The first alert per key and time bucket, and how many followed it."""
    return (
        alerts.groupBy(key, F.window(ts, window).alias("_w"))
        .agg(
            F.min(F.struct(ts, "error_id")).alias("_first"),
            (F.count(F.lit(1)) - 1).alias("suppressed"),
        )
        .select(
            key, F.col("_w.start").alias("bucket"), F.col(f"_first.{ts}").alias(ts),
            F.col("_first.error_id").alias("error_id"), "suppressed",
        )
    )


def rolling_anomalies(
    events: DataFrame, key: str, order: Sequence[str], value: str, n: int, z: float, **segmenting
) -> DataFrame:
    """Values more than ``z`` deviations from the mean of the ``n`` rows before them."""
    def columns(spec):
        frame = spec.rowsBetween(-n, -1)
        return {
            "_n": F.count(value).over(frame),
            "_mean": F.avg(value).over(frame),
            "_spread": F.stddev_samp(value).over(frame),
        }

    rows = with_preceding(events.select(key, *order, value), [key], order, n, columns, **segmenting)
    return (
        rows.where(F.col("_n") == n)
        .withColumn("zscore", F.round(F.try_divide(F.abs(F.col(value) - F.col("_mean")), F.col("_spread")), 6))
        .where(F.col("zscore") > z)
        .select(key, *order, value, "zscore")
    )


def market_indicators(ticks: DataFrame, key: str, time: str, value: str, n: int, **segmenting) -> DataFrame:
    """Moving average, change against the row before, and moving deviation, per key."""
    def columns(spec):
        frame = spec.rowsBetween(-(n - 1), 0)
        before = F.lag(value).over(spec)
        return {
            "moving_avg": F.round(F.avg(value).over(frame), 6),
            "lag_return": F.try_divide(F.col(value) - before, before),
            "_spread": F.stddev_samp(value).over(frame),
        }

    rows = with_preceding(ticks.select(key, time, value), [key], [time], n, columns, **segmenting)
    return rows.select(
        key, time, value, "moving_avg", "lag_return",
        F.round("_spread", 4).alias("volatility"),
    )
