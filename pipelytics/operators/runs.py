"""Workflow history: cost, metrics, bottlenecks, failures, trends, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import fine_mean, fine_sum, share
from ..functions.pricing import OTHER_GPU, RUN_CPU_RATE, RUN_GPU_RATES, lookup
from .ordered import row_numbers, with_preceding


def run_cost(task_runs: DataFrame) -> DataFrame:
    """Cost per run: hours times the GPU rate if a GPU is set, else a rate per core."""
    rate = F.when(
        F.col("gpu").isNotNull(), lookup(RUN_GPU_RATES, F.col("gpu"), OTHER_GPU)
    ).otherwise(F.lit(RUN_CPU_RATE) * F.coalesce("cpu", F.lit(1)))
    return task_runs.groupBy("run_id").agg(
        fine_sum(F.col("duration_s") / 3600 * rate).alias("cost")
    )


def run_metrics(runs: DataFrame, costs: DataFrame, last_n: int = 100) -> DataFrame:
    """Mean runtime, success rate and mean cost of each workflow's latest runs."""
    latest = Window.partitionBy("dag_id").orderBy(F.desc("start_ts"), F.desc("run_id"))
    recent = (
        runs.withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") <= last_n)
        .join(costs, "run_id", "left")
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts"))
    return recent.groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.try_divide(F.sum(micros).cast("double"), F.count(micros) * F.lit(1e6)).alias("avg_runtime_s"),
        share(F.col("state") == "success").alias("success_rate"),
        fine_mean("cost").alias("cost_per_run"),
    )


def resource_utilization(task_runs: DataFrame) -> DataFrame:
    """A map of mean and peak processor and memory use per workflow."""
    names = ["cpu_avg", "cpu_max", "mem_avg", "mem_max"]
    return task_runs.groupBy("dag_id").agg(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]),
            F.array(
                fine_mean("cpu_pct"), F.max("cpu_pct"), fine_mean("memory_mb"), F.max("memory_mb")
            ),
        ).alias("utilization")
    )


def bottlenecks(task_runs: DataFrame, k: int) -> DataFrame:
    """The ``k`` tasks with the largest share of their workflow's runtime."""
    per_task = task_runs.groupBy("dag_id", "task_id").agg(fine_sum("duration_s").alias("runtime_s"))
    totals = task_runs.groupBy("dag_id").agg(fine_sum("duration_s").alias("_total"))
    order = Window.partitionBy("dag_id").orderBy(F.desc("runtime_s"))
    return (
        per_task.withColumn("position", F.dense_rank().over(order))
        .where(F.col("position") <= k)
        .join(totals, "dag_id")
        .select(
            "dag_id", "task_id", "runtime_s", "position",
            F.try_divide("runtime_s", "_total").alias("runtime_share"),
        )
    )


def predict_failures(task_runs: DataFrame, n: int = 20, p: float = 0.2) -> DataFrame:
    """Tasks likely to fail, judged by their latest ``n`` attempts, most likely first."""
    latest = Window.partitionBy("dag_id", "task_id").orderBy(
        F.desc("start_ts"), F.desc("attempt_id")
    )
    prob = F.col("failure_probability")
    return (
        task_runs.select("dag_id", "task_id", "start_ts", "attempt_id", "state", "duration_s")
        .withColumn("_rn", F.row_number().over(latest))
        .where(F.col("_rn") <= n)
        .groupBy("dag_id", "task_id")
        .agg(
            share(F.col("state") == "failed").alias("failure_probability"),
            fine_mean("duration_s").alias("expected_time_s"),
        )
        .where(prob > p)
        .withColumn(
            "recommendation",
            F.when(prob >= 0.5, "pause and inspect").when(prob >= 0.3, "add retries").otherwise("watch"),
        )
        .orderBy(F.desc("failure_probability"), "dag_id", "task_id")
    )


def runtime_trend(task_runs: DataFrame, window: int = 5, **segmenting) -> DataFrame:
    """Previous runtime, rolling mean and the slope of runtime over run number, per task."""
    keys = ["dag_id", "task_id"]

    def columns(spec):
        frame = spec.rowsBetween(-(window - 1), 0)
        total = F.sum(F.col("duration_s").cast("decimal(38,9)")).over(frame).cast("double")
        return {
            "previous_s": F.lag("duration_s").over(spec),
            "rolling_mean_s": total / F.count("duration_s").over(frame),
        }

    slim = task_runs.select(*keys, "start_ts", "attempt_id", "duration_s")
    rows = with_preceding(slim, keys, ["start_ts", "attempt_id"], window - 1, columns, **segmenting)
    slopes = rows.groupBy(*keys).agg(
        F.round(F.regr_slope(F.col("duration_s"), F.col("rn").cast("double")), 6).alias("slope")
    )
    return rows.join(slopes, keys).withColumnRenamed("rn", "run_number")


def retry_schedule(
    attempts: DataFrame,
    factor: float = 2.0,
    max_retries: int = 3,
    jitter: bool = False,
    seed: int = 0,
    segments: int | None = None,
) -> DataFrame:
    """Attempt number (from 0), delay before the next try, total wait, and whether tries ran out.

    The total wait is a geometric sum, so it needs the attempt number only.
    With ``jitter`` a hash of the attempt scales its delay by 0.5 to 1.
    """
    numbered = row_numbers(attempts, ["call_key"], ["ts", "attempt_id"], "_rn", segments)
    n = (F.col("_rn") - 1).cast("bigint")
    exhausted = n >= max_retries
    # Waits stop growing once the retries are used up.
    steps = F.least(n + 1, F.lit(max_retries)).cast("double")
    waited = (
        steps * 1.0 if factor == 1 else (F.pow(F.lit(factor), steps) - 1) / F.lit(factor - 1)
    )
    delay = F.when(exhausted, 0.0).otherwise(F.pow(F.lit(factor), n.cast("double")))
    if jitter:
        spread = F.pmod(F.xxhash64("attempt_id", F.lit(seed)), F.lit(1000)) / 1000
        delay = delay * (F.lit(0.5) + spread * 0.5)
    return numbered.select(
        "call_key", "attempt_id", n.alias("attempt"), delay.alias("delay_s"),
        waited.alias("total_wait_s"), exhausted.alias("exhausted"),
    )
