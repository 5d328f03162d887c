"""Prices, reliability and risk of compute offers, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hourly price per core and per GB, reliability, and rank of each provider.
PROVIDERS = {
    "aws": {"cpu": 0.05, "memory": 0.01, "reliability": 0.95},
    "gcp": {"cpu": 0.04, "memory": 0.009, "reliability": 0.93},
    "azure": {"cpu": 0.055, "memory": 0.011, "reliability": 0.92},
    "coreweave": {"cpu": 0.03, "memory": 0.007, "reliability": 0.90},
}
OTHER_PROVIDER = {"cpu": 0.05, "memory": 0.01, "reliability": 0.85}
GPU_PRICES = {
    "aws": {"nvidia-tesla-t4": 0.526, "nvidia-tesla-v100": 2.48, "nvidia-a100": 4.10},
    "gcp": {"nvidia-tesla-t4": 0.35, "nvidia-tesla-v100": 2.20, "nvidia-a100": 3.67},
    "coreweave": {
        "nvidia-tesla-t4": 0.20,
        "nvidia-tesla-v100": 1.80,
        "nvidia-a100": 2.50,
        "nvidia-h100": 4.76,
    },
}
OTHER_GPU = 1.0
RUN_GPU_RATES = {"a100": 3.50, "v100": 2.20, "t4": 0.75}
RUN_CPU_RATE = 0.10
PRICE_FACTOR = {"spot": 0.3, "preemptible": 0.2}
INTERRUPTIBLE = ("spot", "preemptible")
INTERRUPTIBLE_RELIABILITY = 0.8
DEFAULT_CPU, DEFAULT_MEMORY, DEFAULT_RUNTIME = 2, "8Gi", 3600
RISK = {
    "interruptible": "Medium - Spot instance may be interrupted",
    "unreliable": "Medium - Lower reliability provider",
    "stable": "Low - Stable configuration",
}
STRATEGY = {
    "spot": "Spot instance optimization for maximum cost savings",
    "gpu": "GPU-specialized provider optimization",
    "other": "Multi-cloud cost optimization",
}


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    """Value of a small fixed table; a literal map costs no join."""
    if not table:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def memory_gb(memory: Column) -> Column:
    """Gigabytes of a size such as ``4Gi``, ``4G``, ``512Mi`` or ``8``; null if unreadable."""
    def number(suffix: int) -> Column:
        return F.substring(memory, F.lit(1), F.length(memory) - suffix).try_cast("double")

    return (
        F.when(memory.endswith("Gi"), number(2))
        .when(memory.endswith("G"), number(1))
        .when(memory.endswith("Mi"), number(2) / 1024)
        .otherwise(memory.try_cast("double"))
    )


def gpu_price(provider: Column, gpu: Column) -> Column:
    """Hourly price of a GPU at a provider; unlisted combinations have a flat price."""
    flat = {f"{p}/{g}": v for p, prices in GPU_PRICES.items() for g, v in prices.items()}
    return lookup(flat, F.concat_ws("/", provider, gpu), OTHER_GPU)


def base_price(provider: Column, cpu: Column, gb: Column, gpu: Column) -> Column:
    """On-demand price per hour."""
    rate = lambda part: lookup(
        {p: v[part] for p, v in PROVIDERS.items()}, provider, OTHER_PROVIDER[part]
    )
    machine = cpu * rate("cpu") + gb * rate("memory")
    wanted = gpu.isNotNull() & (gpu != "")
    return F.when(wanted, machine + gpu_price(provider, gpu)).otherwise(machine)


def hourly_price(
    provider: Column, instance_type: Column, cpu: Column, gb: Column, gpu: Column
) -> Column:
    full = base_price(provider, cpu, gb, gpu)
    return F.when(
        instance_type.isin(*PRICE_FACTOR), full * lookup(PRICE_FACTOR, instance_type, 1.0)
    ).otherwise(full)


def reliability(provider: Column, instance_type: Column) -> Column:
    base = lookup(
        {p: v["reliability"] for p, v in PROVIDERS.items()}, provider, OTHER_PROVIDER["reliability"]
    )
    return F.when(
        instance_type.isin(*INTERRUPTIBLE), base * INTERRUPTIBLE_RELIABILITY
    ).otherwise(base)


def risk_text(instance_type: Column, score: Column) -> Column:
    return (
        F.when(instance_type.isin(*INTERRUPTIBLE), RISK["interruptible"])
        .when(score < 0.9, RISK["unreliable"])
        .otherwise(RISK["stable"])
    )


def strategy_text(provider: Column, instance_type: Column) -> Column:
    return (
        F.when(instance_type == "spot", STRATEGY["spot"])
        .when(provider == "coreweave", STRATEGY["gpu"])
        .otherwise(STRATEGY["other"])
    )
