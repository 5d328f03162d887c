"""Hand-computed offers, ties, infeasible requirements, and budgets against a greedy loop."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipelytics.operators import cost as c

START = datetime(2024, 1, 1)
REQ = "req_id long, pool long, cpu int, memory string, gpu string, estimated_runtime long"


def req(spark, *rows):
    return spark.createDataFrame(list(rows), REQ)


def test_memory_units(spark):
    sizes = ["2Gi", "4G", "512Mi", "8", "x", "Gi", None]
    df = spark.createDataFrame([(s,) for s in sizes], "m string")
    got = [r["memory_gb"] for r in c.memory_to_gb(df, "m").collect()]
    assert got == [2.0, 4.0, 0.5, 8.0, None, None, None]


def test_eight_offers_by_hand(spark):
    got = c.gather_quotes(req(spark, (1, 0, 4, "8Gi", None, 7200))).orderBy("ordinal").collect()
    base = {"aws": 0.28, "gcp": 0.232, "azure": 0.308, "coreweave": 0.176}
    assert [(q.provider, q.instance_type) for q in got] == [
        (p, k) for p in base for k in ("on_demand", "spot")
    ]
    for q in got:
        hourly = base[q.provider] * (0.3 if q.instance_type == "spot" else 1)
        assert q.hourly_cost == pytest.approx(hourly)
        assert q.total_cost == pytest.approx(2 * hourly)


def test_defaults_and_unlisted_gpu(spark):
    got = c.gather_quotes(req(spark, (1, 0, None, None, "unlisted", None)), spot=False).collect()
    prices = {q.provider: q.total_cost for q in got}
    assert prices["aws"] == pytest.approx(2 * 0.05 + 8 * 0.01 + 1.0)
    assert prices["azure"] == pytest.approx(2 * 0.055 + 8 * 0.011 + 1.0)


def test_switches(spark):
    r = req(spark, (1, 0, 4, "8Gi", None, 3600))
    assert c.gather_quotes(r, multi_cloud=False, spot=False).count() == 3
    assert c.gather_quotes(r, max_hourly=0.2).count() == 5
    assert c.gather_quotes(req(spark, (1, 0, 0, "0", None, 3600))).count() == 0


def test_equal_scores_keep_offer_order(spark):
    best = c.optimize_resources(req(spark, (1, 0, 4, "8Gi", None, 0)), w=1.0).first()
    # No runtime costs nothing anywhere, so all scores are equal.
    assert (best.provider, best.instance_type) == ("aws", "on_demand")
    assert [(f.provider, f.instance_type) for f in best.fallbacks] == [
        ("aws", "spot"), ("gcp", "on_demand"), ("gcp", "spot"),
    ]
    assert best.savings_pct is None


def test_infeasible_requirement_is_kept(spark):
    r = req(spark, (1, 0, 4, "8Gi", None, 3600), (2, 0, 4, "bad", None, 3600))
    got = {x.req_id: x for x in c.optimize_resources(r, min_reliability=0.99).collect()}
    assert got[1].status == got[2].status == "infeasible"
    assert got[1].provider is None and got[1].fallbacks == []


def test_best_offer_by_hand(spark):
    best = c.optimize_resources(req(spark, (1, 0, 4, "8Gi", None, 3600))).first()
    costs = {("coreweave", "spot"): 0.0528}
    assert (best.provider, best.instance_type) == ("coreweave", "spot")
    assert best.total_cost == pytest.approx(costs[("coreweave", "spot")])
    assert best.score == pytest.approx(0.7 * 1.0 + 0.3 * 0.72)
    assert best.savings_pct == pytest.approx((0.28 - 0.0528) / 0.28 * 100)
    assert best.risk.startswith("Medium") and best.strategy.startswith("Spot")


def greedy(costs, budget):
    left, kept = budget, []
    for cost, key in sorted(costs):
        if cost <= left:
            kept.append(key)
            left -= cost
    return sorted(kept)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(1, 6), st.integers(0, 5)), min_size=1, max_size=30),
    st.integers(0, 40),
)
def test_budget_equals_greedy(spark, tasks, tenths):
    rows = [(i, 0, cpu, "0", None, 600 * step) for i, (cpu, step) in enumerate(tasks)]
    budget = Decimal(tenths) / 1000
    costs = c._filled(req(spark, *rows)).select(
        "req_id", F.array_min(F.transform(c._offers(True, True, c.INFINITE), lambda q: q["total_cost"]))
        .cast("decimal(18,9)").alias("cost"),
    ).collect()
    want = greedy([(r.cost, r.req_id) for r in costs if r.cost is not None], budget)
    got = c.schedule_budget(req(spark, *rows), budget, START, segments=3)
    assert sorted(r.req_id for r in got.collect()) == want


def test_budget_met_exactly_and_missed(spark):
    # The cheapest offer of a core is 0.009 an hour.
    rows = [(i, 0, 1, "0", None, 3600) for i in range(4)]
    met = c.schedule_budget(req(spark, *rows), 0.018, START).orderBy("req_id").collect()
    assert [(r.req_id, r.completed_by) for r in met] == [
        (0, START + timedelta(hours=1)), (1, START + timedelta(hours=2)),
    ]
    assert c.schedule_budget(req(spark, *rows), 0.008, START).count() == 0


def test_no_history_uses_default(spark, rows):
    h = spark.createDataFrame(
        [("aws", "spot", "a", True), ("aws", "spot", "a", False)],
        "provider string, instance_type string, zone string, interrupted boolean",
    )
    keys = spark.createDataFrame(
        [("aws", "spot", "a"), ("gcp", "spot", "a")], "provider string, instance_type string, zone string"
    )
    assert rows(c.spot_interruption_rate(h, keys)) == [
        ("aws", "spot", "a", 0.5), ("gcp", "spot", "a", 0.3)
    ]
