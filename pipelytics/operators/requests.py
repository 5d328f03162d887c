"""Accounting over model requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests as q
from ..functions.exact import fine_sum, share
from .ordered import running_sums


def _key() -> Column:
    return q.cache_key(*[F.col(c) for c in ("prompt", "model", "max_tokens", "temperature")])


def cache_keys(requests: DataFrame) -> DataFrame:
    return requests.withColumn("cache_key", _key())


def llm_model_metrics(requests: DataFrame) -> DataFrame:
    """Totals, means, last measured speed, success rate, cache hits and errors per model.

    Summed per model and cache key first; a repeat of a key is a cache hit.
    """
    speed = q.tokens_per_second(F.col("tokens"), F.col("latency_ms"))
    at = F.when(speed.isNotNull(), F.struct("ts", "request_id"))
    per_key = (
        cache_keys(requests)
        .groupBy("model", "cache_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("latency_ms").cast("decimal(38,9)")).alias("latency"),
            F.sum("tokens").alias("tokens"),
            F.count_if("success").alias("good"),
            F.max_by(speed, at).alias("speed"),
            F.max(at).alias("at"),
        )
    )
    n = F.sum("n")
    return per_key.groupBy("model").agg(
        n.alias("requests"),
        F.sum("latency").cast("double").alias("total_latency_ms"),
        F.sum("tokens").alias("total_tokens"),
        F.try_divide(F.sum("latency").cast("double"), n).alias("avg_latency_ms"),
        F.max_by("speed", "at").alias("tokens_per_second"),
        F.try_divide(F.sum("good").cast("double"), n).alias("success_rate"),
        (n - F.count(F.lit(1))).alias("cache_hits"),
        (n - F.sum("good")).alias("errors"),
    )


def llm_batch_metrics(requests: DataFrame, batch: str = "batch") -> DataFrame:
    """Latency, tokens per second and success rate per batch; speed 0 when no time passed."""
    latency = fine_sum("latency_ms")
    return requests.groupBy(batch).agg(
        F.count(F.lit(1)).alias("requests"),
        latency.alias("total_latency_ms"),
        F.when(latency > 0, F.sum("tokens") / latency * 1000).otherwise(0.0).alias("throughput"),
        share(F.col("success")).alias("success_rate"),
    )


def running_model_metrics(requests: DataFrame, segments: int | None = None) -> DataFrame:
    """Requests so far, mean latency and success rate after each request of a model."""
    slim = requests.select("model", "ts", "request_id", "latency_ms", "success")
    run = running_sums(
        slim, ["model"], ["ts", "request_id"],
        {
            "n": F.lit(1).cast("bigint"),
            "latency": F.col("latency_ms").cast("decimal(38,9)"),
            "good": F.when(F.col("success"), 1).otherwise(0).cast("bigint"),
        },
        segments,
    )
    return run.select(
        "model", "request_id", F.col("n").alias("requests"),
        (F.col("latency").cast("double") / F.col("n")).alias("avg_latency_ms"),
        (F.col("good").cast("double") / F.col("n")).alias("success_rate"),
    )


def benchmark_speedups(benchmarks: DataFrame, baseline: str) -> DataFrame:
    """How many times faster and cheaper each model is than the baseline model."""
    base = benchmarks.where(F.col("model") == baseline)
    of_base = lambda c: base.agg(F.max(c).alias(c)).scalar()
    return benchmarks.select(
        "model",
        F.try_divide(of_base("avg_latency_ms"), F.col("avg_latency_ms")).alias("latency_ratio"),
        F.try_divide(of_base("cost_per_1k"), F.col("cost_per_1k")).alias("cost_ratio"),
    )
