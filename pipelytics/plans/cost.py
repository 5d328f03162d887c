"""Provider offers, resource choice and budgets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import pricing as p
from ..operators import cost as c
from .registry import plan

START = datetime(2024, 1, 1)

# Hourly price of a machine and of one GPU, per provider.
UNIT_COSTS = {"aws": (150, 50), "gcp": (140, 45), "azure": (145, 48), "coreweave": (80, 25)}

_RATES = """
    rates as (select provider, cast(cpu as double) as cpu_rate, cast(mem as double) as mem_rate,
                     cast(rel as double) as rel, ordinal
        from (values ('aws', 0.05, 0.01, 0.95, 0), ('gcp', 0.04, 0.009, 0.93, 2),
                     ('azure', 0.055, 0.011, 0.92, 4), ('coreweave', 0.03, 0.007, 0.90, 6))
             as t(provider, cpu, mem, rel, ordinal)),
    gpus as (select provider, gpu, cast(price as double) as price
        from (values ('aws', 'nvidia-tesla-t4', 0.526), ('aws', 'nvidia-tesla-v100', 2.48),
                     ('aws', 'nvidia-a100', 4.10), ('gcp', 'nvidia-tesla-t4', 0.35),
                     ('gcp', 'nvidia-tesla-v100', 2.20), ('gcp', 'nvidia-a100', 3.67),
                     ('coreweave', 'nvidia-tesla-t4', 0.20), ('coreweave', 'nvidia-tesla-v100', 1.80),
                     ('coreweave', 'nvidia-a100', 2.50), ('coreweave', 'nvidia-h100', 4.76))
             as t(provider, gpu, price)),
    kinds as (select * from (values ('on_demand', 1.0::double, 1.0::double, 0),
                                    ('spot', 0.3::double, 0.8::double, 1))
              as t(instance_type, factor, rel_factor, step)),
    sized as (select *, case when memory like '%Gi' then cast(left(memory, length(memory) - 2) as double)
                             when memory like '%G' then cast(left(memory, length(memory) - 1) as double)
                             when memory like '%Mi' then cast(left(memory, length(memory) - 2) as double) / 1024
                             else cast(memory as double) end as gb,
                     estimated_runtime / 3600 as hours from requirements_v),
    priced as (select s.*, r.provider, r.rel, r.ordinal,
                      case when s.gpu is null then s.cpu * cpu_rate + gb * mem_rate
                           else s.cpu * cpu_rate + gb * mem_rate + coalesce(g.price, 1.0::double) end as full_price
               from sized s, rates r
               left join gpus g on g.provider = r.provider and g.gpu = s.gpu),
    quotes as (select req_id, pool, cpu, memory, gpu, estimated_runtime, hours, provider, instance_type,
                      ordinal + step as ordinal,
                      case when step = 1 then full_price * factor else full_price end as hourly_cost,
                      (case when step = 1 then full_price * factor else full_price end) * hours as total_cost,
                      case when step = 1 then rel * rel_factor else rel end as reliability
               from priced, kinds),
    baseline as (select req_id, full_price * hours as baseline_cost from priced where provider = 'aws')"""

_SCORED = f"""with {_RATES},
    viable as (select * from quotes where {{cond}}),
    lim as (select req_id, min(total_cost) as lo, max(total_cost) as hi from viable group by 1),
    scored as (select v.*, 0.7::double * (1.0::double - (total_cost - lo) / (hi - lo + 0.001::double))
                      + (1 - 0.7::double) * reliability as score
               from viable v join lim using (req_id))"""


@plan("memory_to_gb", f"with {_RATES} select req_id, memory, gb as memory_gb from sized")
def memory_to_gb(t):
    return c.memory_to_gb(t.requirements_v, "memory").select("req_id", "memory", "memory_gb")


@plan("gather_quotes", f"""with {_RATES}
    select req_id, cpu, memory, gpu, estimated_runtime, cast(ordinal as int) as ordinal, provider,
           instance_type, hourly_cost, total_cost, reliability, provider || '-us-west-2a' as zone
    from quotes where hourly_cost > 0""")
def gather_quotes(t):
    return c.gather_quotes(t.requirements_v)


@plan("filter_quotes", f"""with {_RATES}
    select req_id, provider, instance_type, hourly_cost, total_cost, reliability from quotes
    where hourly_cost > 0 and hourly_cost <= 4 and total_cost <= 2 and reliability >= 0.75::double""")
def filter_quotes(t):
    kept = c.filter_quotes(c.gather_quotes(t.requirements_v), 2.0, 0.75, 4.0)
    return kept.select(
        "req_id", "provider", "instance_type", "hourly_cost", "total_cost", "reliability"
    )


@plan("gpu_rate_lookup", f"""with {_RATES}
    select q.req_id, q.provider, q.gpu, coalesce(g.price, 1.0::double) as gpu_rate
    from quotes q left join gpus g on g.provider = q.provider and g.gpu = q.gpu
    where q.instance_type = 'on_demand' and q.gpu is not null""")
def gpu_rate_lookup(t):
    offers = c.gather_quotes(t.requirements_v, spot=False).where("gpu is not null")
    listed = {f"{n}/{g}": v for n, prices in p.GPU_PRICES.items() for g, v in prices.items()}
    priced = c.gpu_rate_lookup(offers, listed, F.concat_ws("/", "provider", "gpu"))
    return priced.select("req_id", "provider", "gpu", "gpu_rate")


@plan("quote_vs_baseline", f"""with {_RATES}
    select req_id, provider, instance_type, total_cost, baseline_cost,
           case when baseline_cost <> 0
                then greatest(0, (baseline_cost - total_cost) / baseline_cost * 100) end as savings_pct
    from quotes join baseline using (req_id)""")
def quote_vs_baseline(t):
    return c.quote_vs_baseline(t.requirements_v)


@plan("provider_savings", """
    with w as (select req_id, req_id % 5 as gpus, 1 + cast(floor(estimated_runtime / 600) as bigint) as hours
               from requirements_v),
    u as (select req_id, provider, ordinal, (base + gpus * per_gpu) * hours as cost from w,
          (values ('aws', 150, 50, 0), ('gcp', 140, 45, 1), ('azure', 145, 48, 2), ('coreweave', 80, 25, 3))
          as t(provider, base, per_gpu, ordinal)),
    r as (select req_id, arg_min(provider, cost * 10 + ordinal) as provider, min(cost) as lo, max(cost) as hi
          from u group by 1)
    select req_id as workload_id, provider, cast(lo as double) as optimal_cost,
           cast(hi as double) as baseline_cost, cast(hi - lo as double) / hi * 100 as savings_pct from r
    union all
    select null, 'all', cast(sum(lo) as double), cast(sum(hi) as double),
           cast(sum(hi) - sum(lo) as double) / cast(sum(hi) as double) * 100 from r""")
def provider_savings(t):
    workloads = t.requirements_v.select(
        F.col("req_id").alias("workload_id"),
        (F.col("req_id") % 5).alias("gpus"),
        (1 + F.floor(F.col("estimated_runtime") / 600)).cast("double").alias("hours"),
    )
    return c.provider_savings(workloads, UNIT_COSTS)


_ALL_OFFERS = """
    with o as (select q.req_id, q.cpu, q.gb, q.gpu, x.provider, k.instance_type
        from (select *, case when memory like '%Gi' then cast(left(memory, length(memory) - 2) as double)
                             when memory like '%G' then cast(left(memory, length(memory) - 1) as double)
                             when memory like '%Mi' then cast(left(memory, length(memory) - 2) as double) / 1024
                             else cast(memory as double) end as gb from requirements_v) q,
        (values ('aws'), ('gcp'), ('azure'), ('coreweave'), ('onprem')) x(provider),
        (values ('on_demand'), ('spot'), ('reserved'), ('preemptible')) k(instance_type))"""


def _all_offers(t):
    """Requirements with every provider and every instance type, also the never quoted ones."""
    return (
        c.memory_to_gb(t.requirements_v, "memory")
        .select(
            "req_id", "cpu", F.col("memory_gb").alias("gb"), "gpu",
            F.explode(F.array(*[F.lit(x) for x in (*p.PROVIDERS, "onprem")])).alias("provider"),
        )
        .withColumn(
            "instance_type",
            F.explode(F.array(*[F.lit(x) for x in ("on_demand", "spot", "reserved", "preemptible")])),
        )
    )


@plan("hourly_price", _ALL_OFFERS + """,
    r as (select o.*, case provider when 'gcp' then 0.04::double when 'azure' then 0.055::double
                 when 'coreweave' then 0.03::double else 0.05::double end as c,
             case provider when 'gcp' then 0.009::double when 'azure' then 0.011::double
                 when 'coreweave' then 0.007::double else 0.01::double end as m,
             case provider || '/' || coalesce(gpu, '')
                 when 'aws/nvidia-tesla-t4' then 0.526::double when 'aws/nvidia-tesla-v100' then 2.48::double
                 when 'aws/nvidia-a100' then 4.1::double when 'gcp/nvidia-tesla-t4' then 0.35::double
                 when 'gcp/nvidia-tesla-v100' then 2.2::double when 'gcp/nvidia-a100' then 3.67::double
                 when 'coreweave/nvidia-tesla-t4' then 0.2::double
                 when 'coreweave/nvidia-tesla-v100' then 1.8::double
                 when 'coreweave/nvidia-a100' then 2.5::double
                 when 'coreweave/nvidia-h100' then 4.76::double else 1.0::double end as g from o),
    b as (select *, case when gpu is null then cpu * c + gb * m else cpu * c + gb * m + g end as full_price from r)
    select req_id, provider, instance_type,
           case instance_type when 'spot' then full_price * 0.3::double
                when 'preemptible' then full_price * 0.2::double else full_price end as hourly_cost from b""")
def hourly_price(t):
    price = p.hourly_price(*[F.col(x) for x in ("provider", "instance_type", "cpu", "gb", "gpu")])
    return _all_offers(t).select("req_id", "provider", "instance_type", price.alias("hourly_cost"))


_RELIABILITY = """case provider when 'aws' then 0.95::double when 'gcp' then 0.93::double
    when 'azure' then 0.92::double when 'coreweave' then 0.9::double else 0.85::double end
    * case when instance_type in ('spot', 'preemptible') then 0.8::double else 1.0::double end"""


@plan("reliability_score", _ALL_OFFERS + f"""
    select req_id, provider, instance_type, {_RELIABILITY} as reliability from o""")
def reliability_score(t):
    score = p.reliability(F.col("provider"), F.col("instance_type"))
    return _all_offers(t).select("req_id", "provider", "instance_type", score.alias("reliability"))


@plan("quote_risk_labels", _ALL_OFFERS + f"""
    select req_id, provider, instance_type,
           case when instance_type in ('spot', 'preemptible') then 'Medium - Spot instance may be interrupted'
                when {_RELIABILITY} < 0.9::double then 'Medium - Lower reliability provider'
                else 'Low - Stable configuration' end as risk,
           case when instance_type = 'spot' then 'Spot instance optimization for maximum cost savings'
                when provider = 'coreweave' then 'GPU-specialized provider optimization'
                else 'Multi-cloud cost optimization' end as strategy from o""")
def quote_risk_labels(t):
    provider, kind = F.col("provider"), F.col("instance_type")
    return _all_offers(t).select(
        "req_id", "provider", "instance_type",
        p.risk_text(kind, p.reliability(provider, kind)).alias("risk"),
        p.strategy_text(provider, kind).alias("strategy"),
    )


@plan("score_quotes", _SCORED.format(cond="hourly_cost > 0") + """
    select req_id, score, cast(ordinal as int) as ordinal, provider, instance_type, hourly_cost,
           total_cost, reliability from scored""")
def score_quotes(t):
    return c.score_quotes(t.requirements_v)


@plan("optimize_resources", _SCORED.format(
    cond="hourly_cost > 0 and hourly_cost <= 3 and total_cost <= 1.5 and reliability >= 0.75::double") + """,
    ranked as (select *, row_number() over (partition by req_id order by score desc, ordinal) as rn from scored),
    best as (select * from ranked where rn = 1),
    fall as (select req_id, string_agg(provider || ':' || instance_type, ',' order by rn) as fallbacks
             from ranked where rn between 2 and 4 group by 1)
    select r.req_id, case when b.req_id is null then 'infeasible' else 'ok' end as status, b.provider,
           b.instance_type, b.total_cost, b.score,
           case when baseline_cost <> 0 and b.req_id is not null
                then greatest(0, (baseline_cost - b.total_cost) / baseline_cost * 100) end as savings_pct,
           case when b.req_id is null then null
                when b.instance_type = 'spot' then 'Medium - Spot instance may be interrupted'
                when b.reliability < 0.9::double then 'Medium - Lower reliability provider'
                else 'Low - Stable configuration' end as risk,
           case when b.req_id is null then null
                when b.instance_type = 'spot' then 'Spot instance optimization for maximum cost savings'
                when b.provider = 'coreweave' then 'GPU-specialized provider optimization'
                else 'Multi-cloud cost optimization' end as strategy,
           coalesce(f.fallbacks, '') as fallbacks
    from requirements_v r join baseline using (req_id) left join best b using (req_id)
    left join fall f using (req_id)""")
def optimize_resources(t):
    best = c.optimize_resources(t.requirements_v, 0.7, 1.5, 0.75, 3.0)
    names = F.transform("fallbacks", lambda q: F.concat_ws(":", q["provider"], q["instance_type"]))
    return best.withColumn("fallbacks", F.array_join(names, ","))


_BUDGET = f"""with {_RATES},
    cheap as (select pool, req_id, estimated_runtime as runtime,
                     cast(min(total_cost) as decimal(18,9)) as cost
              from quotes where hourly_cost > 0 group by 1, 2, 3),
    run as (select *, sum(cost) over w as spent, sum(runtime) over w as elapsed from cheap
            window w as (partition by pool order by cost, req_id rows unbounded preceding)),
    fit as (select pool, req_id, cast(cost as double) as cost, runtime, cast(spent as double) as spent,
                   timestamp '2024-01-01 00:00:00' + to_seconds(cast(elapsed as bigint)) as completed_by
            from run where spent <= 2.5)"""


@plan("schedule_budget", f"{_BUDGET} select * from fit")
def schedule_budget(t):
    return c.schedule_budget(t.requirements_v, 2.5, START)


@plan("schedule_budget_totals", f"""{_BUDGET}
    select pool, count(*) as tasks, max(spent) as total_cost, max(completed_by) as completion_time
    from fit group by pool""")
def schedule_budget_totals(t):
    return c.schedule_totals(c.schedule_budget(t.requirements_v, 2.5, START))


@plan("spot_interruption_rate", """
    select k.provider, k.instance_type, k.zone, coalesce(rate, 0.3::double) as interruption_rate
    from spot_keys_v k left join (
        select provider, instance_type, zone, avg(case when interrupted then 1.0::double else 0 end) as rate
        from spot_history_v group by 1, 2, 3) h
    on k.provider = h.provider and k.instance_type = h.instance_type and k.zone = h.zone""")
def spot_interruption_rate(t):
    return c.spot_interruption_rate(t.spot_history_v, t.spot_keys_v)
