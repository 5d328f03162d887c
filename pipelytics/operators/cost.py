"""Offers of several providers for resource requirements, and spending plans.

A requirement has at most eight offers, so they are kept as an array inside its
row: quoting, filtering, scoring and choosing need no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as p
from ..functions.exact import money_sum
from ..functions.unnest import unnest
from .ordered import running_sums

INFINITE = float("inf")


def memory_to_gb(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("memory_gb", p.memory_gb(F.col(column)))


def _filled(requirements: DataFrame) -> DataFrame:
    """Add sizes with defaults, and the full hourly price at each provider.

    The prices are columns of their own, as several offers derive from each.
    """
    sized = requirements.select(
        "*",
        F.coalesce("cpu", F.lit(p.DEFAULT_CPU)).alias("_cpu"),
        p.memory_gb(F.coalesce("memory", F.lit(p.DEFAULT_MEMORY))).alias("_gb"),
        (F.coalesce("estimated_runtime", F.lit(p.DEFAULT_RUNTIME)) / 3600).alias("_hours"),
    )
    return sized.select(
        "*",
        *[
            p.base_price(F.lit(n), F.col("_cpu"), F.col("_gb"), F.col("gpu")).alias(f"_full_{n}")
            for n in p.PROVIDERS
        ],
    )


def _catalogue(multi_cloud: bool, spot: bool) -> list[tuple[str, str]]:
    """Providers and instance types on offer, in the order in which ties are resolved."""
    providers = [n for n in p.PROVIDERS if multi_cloud or n != "coreweave"]
    kinds = ["on_demand", "spot"] if spot else ["on_demand"]
    return [(provider, kind) for provider in providers for kind in kinds]


def _hourly(provider: str, kind: str) -> Column:
    full = F.col(f"_full_{provider}")
    return full * p.PRICE_FACTOR[kind] if kind in p.PRICE_FACTOR else full


def _offers(multi_cloud: bool, spot: bool, max_hourly: float) -> Column:
    """All offers for the current row."""
    offers = [
        F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(provider).alias("provider"),
            F.lit(kind).alias("instance_type"),
            _hourly(provider, kind).alias("hourly_cost"),
            (_hourly(provider, kind) * F.col("_hours")).alias("total_cost"),
            p.reliability(F.lit(provider), F.lit(kind)).alias("reliability"),
            F.lit(f"{provider}-us-west-2a").alias("zone"),
        )
        for ordinal, (provider, kind) in enumerate(_catalogue(multi_cloud, spot))
    ]
    return F.filter(
        F.array(*offers), lambda q: (q["hourly_cost"] > 0) & (q["hourly_cost"] <= max_hourly)
    )


def _cheapest(multi_cloud: bool, spot: bool, max_hourly: float) -> Column:
    """Lowest total cost among the offers for the current row; null without an offer."""
    prices = [_hourly(*offer) for offer in _catalogue(multi_cloud, spot)]
    return F.least(
        *[F.when((h > 0) & (h <= max_hourly), h * F.col("_hours")) for h in prices]
    )


def _viable(quotes: Column, max_total: float, min_reliability: float) -> Column:
    return F.filter(
        quotes, lambda q: (q["total_cost"] <= max_total) & (q["reliability"] >= min_reliability)
    )


def _with_cost_range(quoted: DataFrame) -> DataFrame:
    """Add the lowest and highest cost as one column, so each row finds them once."""
    costs = F.transform("quotes", lambda q: q["total_cost"])
    return quoted.withColumn(
        "_range", F.struct(F.array_min(costs).alias("low"), F.array_max(costs).alias("high"))
    )


def _scored(w: float) -> Column:
    """Offers with a score: cheap within their requirement, and reliable."""
    low, high = F.col("_range.low"), F.col("_range.high")
    return F.transform(
        "quotes",
        lambda q: F.struct(
            (
                F.lit(w) * (1.0 - (q["total_cost"] - low) / (high - low + 0.001))
                + F.lit(1 - w) * q["reliability"]
            ).alias("score"),
            (-q["ordinal"]).alias("rank_tie"),
            q["ordinal"].alias("ordinal"),
            q["provider"].alias("provider"),
            q["instance_type"].alias("instance_type"),
            q["hourly_cost"].alias("hourly_cost"),
            q["total_cost"].alias("total_cost"),
            q["reliability"].alias("reliability"),
        ),
    )


def gather_quotes(
    requirements: DataFrame,
    multi_cloud: bool = True,
    spot: bool = True,
    max_hourly: float = INFINITE,
) -> DataFrame:
    """One row per requirement and offer."""
    keep = ["req_id", "cpu", "memory", "gpu", "estimated_runtime"]
    return unnest(_filled(requirements), keep, _offers(multi_cloud, spot, max_hourly), "ordinal")


def filter_quotes(
    quotes: DataFrame,
    max_total: float = INFINITE,
    min_reliability: float = 0.0,
    max_hourly: float = INFINITE,
) -> DataFrame:
    return quotes.where(
        (F.col("hourly_cost") > 0)
        & (F.col("hourly_cost") <= max_hourly)
        & (F.col("total_cost") <= max_total)
        & (F.col("reliability") >= min_reliability)
    )


def gpu_rate_lookup(
    df: DataFrame, rates: Mapping[str, float], key: Column, default: float = p.OTHER_GPU
) -> DataFrame:
    """Add the rate of a small fixed table, or the default where the key is not listed."""
    return df.withColumn("gpu_rate", p.lookup(dict(rates), key, default))


def _baseline() -> Column:
    return F.col("_full_aws") * F.col("_hours")


def _savings(baseline: Column, cost: Column) -> Column:
    return F.greatest(F.lit(0.0), F.try_divide(baseline - cost, baseline) * 100)


def quote_vs_baseline(
    requirements: DataFrame, multi_cloud: bool = True, spot: bool = True
) -> DataFrame:
    """Savings of each offer against the on-demand price of the first provider."""
    quoted = unnest(
        _filled(requirements), ["req_id", _baseline().alias("baseline_cost")],
        _offers(multi_cloud, spot, INFINITE), "ordinal",
    )
    # greatest() skips nulls, so a zero baseline is handled apart.
    return quoted.withColumn(
        "savings_pct",
        F.when(
            F.col("baseline_cost") != 0, _savings(F.col("baseline_cost"), F.col("total_cost"))
        ),
    ).select("req_id", "provider", "instance_type", "total_cost", "baseline_cost", "savings_pct")


def score_quotes(
    requirements: DataFrame, w: float = 0.7, multi_cloud: bool = True, spot: bool = True
) -> DataFrame:
    quoted = _filled(requirements).select(
        "req_id", _offers(multi_cloud, spot, INFINITE).alias("quotes")
    )
    return unnest(_with_cost_range(quoted), ["req_id"], _scored(w), "ordinal").drop("rank_tie")


def optimize_resources(
    requirements: DataFrame,
    w: float = 0.7,
    max_total: float = INFINITE,
    min_reliability: float = 0.0,
    max_hourly: float = INFINITE,
    multi_cloud: bool = True,
    spot: bool = True,
) -> DataFrame:
    """The best offer, up to three fallbacks, savings, risk and strategy per requirement."""
    quoted = _filled(requirements).select(
        "req_id",
        _baseline().alias("baseline_cost"),
        _viable(_offers(multi_cloud, spot, max_hourly), max_total, min_reliability).alias("quotes"),
    )
    ranked = _with_cost_range(quoted).select(
        "req_id", "baseline_cost", F.sort_array(_scored(w), asc=False).alias("ranked")
    ).withColumn("best", F.get("ranked", F.lit(0)))
    best = lambda name: F.col(f"best.{name}")
    found = F.col("best").isNotNull()
    return ranked.select(
        "req_id",
        F.when(found, "ok").otherwise("infeasible").alias("status"),
        best("provider").alias("provider"),
        best("instance_type").alias("instance_type"),
        best("total_cost").alias("total_cost"),
        best("score").alias("score"),
        F.when(
            found & (F.col("baseline_cost") != 0),
            _savings(F.col("baseline_cost"), best("total_cost")),
        ).alias("savings_pct"),
        F.when(found, p.risk_text(best("instance_type"), best("reliability"))).alias("risk"),
        F.when(found, p.strategy_text(best("provider"), best("instance_type"))).alias("strategy"),
        F.transform(
            F.slice("ranked", 2, 3),
            lambda q: F.struct(q["provider"], q["instance_type"], q["total_cost"], q["score"]),
        ).alias("fallbacks"),
    )


def schedule_budget(
    tasks: DataFrame,
    budget: float,
    start_time: datetime,
    segments: int | None = None,
    max_hourly: float = INFINITE,
    multi_cloud: bool = True,
    spot: bool = True,
) -> DataFrame:
    """The tasks of each pool that fit its budget, cheapest first.

    Taking the cheapest affordable task again and again keeps exactly those
    tasks whose running cost stays within the budget, because every later task
    costs at least as much as the one that no longer fits. Costs are decimals,
    so the comparison with the budget is exact.
    """
    costs = _filled(tasks).select(
        "pool", "req_id",
        F.coalesce("estimated_runtime", F.lit(p.DEFAULT_RUNTIME)).alias("runtime"),
        _cheapest(multi_cloud, spot, max_hourly).cast("decimal(38,9)").alias("cost"),
    )
    # Tasks without an offer sort first and add nothing; they are dropped after the
    # sums, where the test reads a stored column instead of pricing them again.
    priced = F.col("cost").isNotNull()
    spent = running_sums(
        costs, ["pool"], ["cost", "req_id"],
        {"spent": F.col("cost"), "elapsed": F.when(priced, F.col("runtime"))}, segments,
    )
    within = F.col("spent") <= F.lit(str(budget)).cast("decimal(38,9)")
    return spent.where(priced & within).select(
        "pool", "req_id", F.col("cost").cast("double").alias("cost"), "runtime",
        F.col("spent").cast("double").alias("spent"),
        (
            F.lit(str(start_time)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("elapsed"))
        ).alias("completed_by"),
    )


def schedule_totals(scheduled: DataFrame) -> DataFrame:
    """Number of tasks, total cost and completion time per pool."""
    return scheduled.groupBy("pool").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.max("spent").alias("total_cost"),
        F.max("completed_by").alias("completion_time"),
    )


def provider_savings(workloads: DataFrame, unit_costs: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Cheapest against dearest provider per workload, and one row for the grand total.

    ``unit_costs`` gives per provider the hourly price of a machine and of each
    of its GPUs.
    """
    priced = workloads.select(
        "workload_id", "hours",
        F.array(
            *[
                F.struct((base + F.col("gpus") * per_gpu).alias("unit"), F.lit(i), F.lit(name).alias("provider"))
                for i, (name, (base, per_gpu)) in enumerate(unit_costs.items())
            ]
        ).alias("offers"),
    )
    low, high = F.array_min("offers"), F.array_max("offers")
    rows = priced.select(
        "workload_id",
        low["provider"].alias("provider"),
        (low["unit"] * F.col("hours")).alias("optimal_cost"),
        (high["unit"] * F.col("hours")).alias("baseline_cost"),
    )
    total = rows.agg(
        F.lit(None).cast("bigint").alias("workload_id"),
        F.lit("all").alias("provider"),
        money_sum("optimal_cost").alias("optimal_cost"),
        money_sum("baseline_cost").alias("baseline_cost"),
    )
    return rows.unionByName(total).withColumn(
        "savings_pct",
        F.try_divide(F.col("baseline_cost") - F.col("optimal_cost"), F.col("baseline_cost")) * 100,
    )


def spot_interruption_rate(history: DataFrame, keys: DataFrame, default: float = 0.3) -> DataFrame:
    """Share of interrupted events per provider, type and zone, or the default without history."""
    by = ["provider", "instance_type", "zone"]
    seen = history.groupBy(*by).agg(
        F.try_divide(
            F.count_if("interrupted").cast("double"), F.count(F.lit(1)).cast("double")
        ).alias("rate")
    )
    return keys.join(seen, by, "left").select(
        *by, F.coalesce("rate", F.lit(default)).alias("interruption_rate")
    )
