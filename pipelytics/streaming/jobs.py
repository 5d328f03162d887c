"""Streaming queries. Each takes a stream and returns a stream, unless it must drive a sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import fine_mean, fine_sum, moment_like, share
from ..operators.breaker import CHANGES, fold_calls
from ..operators.recovery import fix_plan
from ..session import scratch_path
from ..sources.writers import fold_metrics, read_latest, upsert_customer_metrics
from .runner import open_stream, run_batches, with_event_time


#: What tells the rows of windowed metrics apart.
WINDOW_KEYS = ("window_start", "window_end", "event_type")


def _windowed(stream: DataFrame, window) -> DataFrame:
    return (
        stream.groupBy(window.alias("_w"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            fine_sum("value").alias("total"),
            F.max("value").alias("largest"),
        )
        .select(
            F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("_w.end").cast("timestamp_ntz").alias("window_end"),
            "event_type", "events", "total", "largest",
        )
    )


def stream_tumbling(stream: DataFrame, size: str, watermark: str) -> DataFrame:
    """Event metrics per type and fixed window."""
    return _windowed(with_event_time(stream, "ts", watermark), F.window("ts", size))


def stream_sliding(stream: DataFrame, size: str, slide: str, watermark: str) -> DataFrame:
    """Event metrics per type and overlapping window."""
    return _windowed(with_event_time(stream, "ts", watermark), F.window("ts", size, slide))


def stream_dedupe(stream: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """The first arrival of each key; repeats within the watermark are dropped."""
    once = with_event_time(stream, "ts", watermark).dropDuplicatesWithinWatermark(list(keys))
    return once.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_late_data(
    chunks: Sequence[DataFrame], size: str, watermark: str
) -> DataFrame:
    """Rows that were on time, late but counted, and too late, per chunk of arrivals.

    Chunks arrive one after the other, and the query resumes from its
    checkpoint for each, so the watermark is that of the chunks before. A row
    is late when an earlier chunk already held a newer one. What was counted
    is read off the windows the query keeps, not off a formula.
    """
    spark = chunks[0].sparkSession
    schema = chunks[0].schema
    inbox, outbox = scratch_path(spark, "late-in"), scratch_path(spark, "late-out")
    state = scratch_path(spark, "late-state")
    report, newest, counted = [], None, 0
    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{outbox}/batch={number}")
        numbers.append(number)

    for n, chunk in enumerate(chunks):
        chunk.write.parquet(f"{inbox}/chunk={n}")
        windows = (
            with_event_time(open_stream(spark, f"{inbox}/chunk=*", schema), "ts", watermark)
            .groupBy(F.window("ts", size).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("start"), "events")
        )
        run_batches(windows, "late", "update", keep, state)
        total = (
            spark.read.parquet(outbox)
            .groupBy("start")
            .agg(F.max_by("events", "batch").alias("events"))
            .agg(F.sum("events"))
            .first()[0]
        ) or 0
        arrived = spark.read.schema(schema).parquet(f"{inbox}/chunk={n}")
        is_late = F.lit(False) if newest is None else F.col("ts") < moment_like(newest, chunk, "ts")
        rows, late, top = arrived.agg(
            F.count(F.lit(1)), F.count_if(is_late), F.max("ts")
        ).first()
        dropped = rows - (total - counted)
        report.append((n, rows - late, late - dropped, dropped))
        counted, newest = total, top if newest is None else max(newest, top)
    return spark.createDataFrame(
        report, "chunk int, on_time bigint, late_kept bigint, late_dropped bigint"
    )


def stream_fraud_alerts(stream: DataFrame, features: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Events whose fraud score exceeds the threshold.

    The score is the logistic function of how far the value exceeds the user's
    mean (in means), plus twice the user's error share, less two.
    """
    lift = F.try_divide(F.col("value") - F.col("mean"), F.col("mean"))
    score = 1 / (1 + F.exp(-(lift + 2 * F.col("error_share") - 2)))
    return (
        stream.join(features.select("user_id", "mean", "error_share"), "user_id")
        .withColumn("score", F.round(score, 9))
        .where(F.col("score") > threshold)
        .select("event_id", "user_id", "ts", "value", "score")
    )


def sensor_baseline(events: DataFrame) -> DataFrame:
    """Mean and deviation per sensor, from history."""
    return events.groupBy("user_id").agg(
        fine_mean("value").alias("mean"), F.stddev_samp("value").alias("deviation")
    )


def stream_sensor_anomalies(stream: DataFrame, baseline: DataFrame, z: float) -> DataFrame:
    """Readings more than ``z`` deviations from the sensor's mean; far ones call for maintenance."""
    score = F.round(F.abs(F.col("value") - F.col("mean")) / F.nullif(F.col("deviation"), F.lit(0.0)), 6)
    return (
        stream.join(baseline, "user_id")
        .withColumn("zscore", score)
        .where(F.col("zscore") > z)
        .select(
            "event_id", "user_id", "ts", "value", "zscore",
            F.when(F.col("zscore") > 2 * z, "maintenance").otherwise("watch").alias("action"),
        )
    )


def stream_classify_errors(stream: DataFrame) -> DataFrame:
    """Kind and remedy of each error as it arrives."""
    return fix_plan(stream)


def stream_model_metrics(stream: DataFrame) -> DataFrame:
    """Requests, mean latency and success rate per model so far.

    A running mean needs only sums, which Spark combines within each task
    before they reach the state, so a busy model costs no more than a quiet one.
    """
    return stream.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        fine_mean("latency_ms").alias("avg_latency_ms"),
        share(F.col("success")).alias("success_rate"),
    )


def stream_circuit_breaker(
    stream: DataFrame, key: str, failures: int = 3, cooldown_s: float = 3600.0, checkpoint: str | None = None,
    out: str | None = None, chunk: int = 10_000,
) -> DataFrame:
    """Run to the end of the input and return the state changes of a breaker per task.

    Closed until ``failures`` straight failures, then open. While open, calls
    are ignored until ``cooldown_s`` has passed; the next call is a trial
    (half-open) that closes the breaker if it succeeds and opens it again if
    it fails. Calls of one micro-batch are put in time order first; calls
    without a time are left out.

    Chunks of a task's calls are summarised by many tasks (see
    ``operators.breaker``), so a busy task is split. Changes and the breakers'
    states are written per micro-batch below ``out``; a repeated batch rewrites
    its own from the states before it. A query that resumes from a checkpoint
    must keep writing to the same folder. Without any input the result is empty.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "breaker")
    calls = stream.select(
        F.col(key).cast("string").alias("task"), "attempt_id",
        F.unix_micros(F.col("start_ts").cast("timestamp")).alias("us"),
        F.coalesce(F.col("state") == "success", F.lit(False)).alias("ok"),
    ).where("us is not null")

    def replace(stored: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
        seen = updates.select(F.col("task").alias("_task"))
        return stored.join(seen, F.col("task").eqNullSafe(F.col("_task")), "left_anti").unionByName(updates)

    def fold(batch: DataFrame, number: int) -> None:
        before = read_latest(spark, f"{out}/states", before=number)
        changes, states = fold_calls(batch, before, failures, int(cooldown_s * 1_000_000), chunk)
        changes.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        upsert_customer_metrics(f"{out}/states", states, ["task"], number, replace)

    run_batches(calls, "breaker", "append", fold, checkpoint)
    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{out}/changes/batch=-1")
    return spark.read.schema(CHANGES).parquet(f"{out}/changes").select(
        "task", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "state"
    )


def stream_upsert_metrics(
    stream: DataFrame, target: str, metrics, keys: Sequence[str], checkpoint: str | None = None
) -> DataFrame:
    """Add the metrics of every micro-batch to a versioned table and return it.

    A batch holds some of a customer's orders, so its sums are added to the
    stored ones: where batches are cut does not show.

    The batch number is the version, so a repeated batch rewrites its own result.
    Before anything has arrived the table is empty.
    """

    def merge(batch: DataFrame, number: int) -> None:
        upsert_customer_metrics(target, metrics(batch), keys, number, fold_metrics)

    run_batches(stream, "upsert", "append", merge, checkpoint)
    stored = read_latest(stream.sparkSession, target)
    return metrics(stream.sparkSession.createDataFrame([], stream.schema)) if stored is None else stored
