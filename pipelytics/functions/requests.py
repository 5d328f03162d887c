"""Identity and speed of model requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(prompt: Column, model: Column, max_tokens: Column, temperature: Column) -> Column:
    """Digest of everything that determines an answer."""
    parts = [prompt, model, max_tokens.cast("string"), temperature.cast("string")]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]))


def tokens_per_second(tokens: Column, latency_ms: Column) -> Column:
    """Speed of a request; null when there is nothing to measure."""
    return F.when((latency_ms > 0) & (tokens > 0), tokens / latency_ms * 1000)
