"""Chains in graphs of every shape, against a search of all paths."""

import random

import pytest

from pipelytics.operators import graph as g


def longest(tasks, edges):
    up = {t: [u for a, u in edges if a == t] for t in tasks}

    def depth(t, seen):
        if t in seen:
            return 0
        if t not in up or not up[t]:
            return 1
        return 1 + max(depth(u, seen | {t}) for u in up[t])

    return max(depth(t, frozenset()) for t in tasks)


GRAPHS = {
    "single": (["a"], []),
    "diamond": (["a", "b", "c", "d"], [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]),
    "self": (["a", "b"], [("a", "a"), ("b", "a")]),
    "loop": (["a", "b"], [("a", "b"), ("b", "a")]),
    "behind_loop": (["a", "b", "c", "d"], [("a", "b"), ("b", "a"), ("c", "b"), ("a", "d")]),
    "unknown": (["a", "b"], [("b", "a"), ("a", "nowhere")]),
    "unknown_in_loop": (["a", "b"], [("a", "b"), ("b", "a"), ("a", "nowhere")]),
    "two_loops": (list("abcd"), [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")]),
    "repeated_edge": (["a", "b"], [("b", "a"), ("b", "a")]),
    "stray_edge": (["a"], [("zz", "a")]),
}


def frames(spark, graphs):
    tasks = [(k, t) for k, (ts, _) in graphs.items() for t in ts]
    edges = [(k, a, u) for k, (_, es) in graphs.items() for a, u in es]
    return (
        spark.createDataFrame(tasks, "dag_id string, task_id string"),
        spark.createDataFrame(edges, "dag_id string, task_id string, upstream_id string"),
    )


def test_shapes(spark):
    got = dict(tuple(r) for r in g.critical_path(*frames(spark, GRAPHS)).collect())
    assert got == {k: longest(*v) for k, v in GRAPHS.items()}


def test_random_graphs(spark):
    rng = random.Random(5)
    graphs = {}
    for i in range(60):
        names = [f"t{j}" for j in range(rng.randint(1, 6))]
        edges = [
            (rng.choice(names), rng.choice([*names, "ghost"])) for _ in range(rng.randint(0, 9))
        ]
        graphs[f"g{i}"] = (names, edges)
    got = dict(tuple(r) for r in g.critical_path(*frames(spark, graphs)).collect())
    assert got == {k: longest(*v) for k, v in graphs.items()}


def test_deep_chain(spark):
    n = 14
    graph = {"deep": ([f"t{i}" for i in range(n)], [(f"t{i}", f"t{i-1}") for i in range(1, n)])}
    assert g.critical_path(*frames(spark, graph)).first().critical_path == n


def test_long_chain_in_few_rounds(spark, monkeypatch):
    n, rounds = 2000, []
    kept = g.materialise
    monkeypatch.setattr(g, "materialise", lambda df, name: rounds.append(name) or kept(df, name))
    graph = {"chain": ([f"t{i}" for i in range(n)], [(f"t{i}", f"t{i-1}") for i in range(1, n)])}
    assert g.critical_path(*frames(spark, graph)).first().critical_path == n
    assert rounds.count("walks") == 12 and rounds.count("ends") == 11


def test_ladder_and_tasks_behind_a_cycle(spark, monkeypatch):
    """Two chains with rungs, and a cycle of three with long chains before and behind it."""
    n = 40
    ladder = [(f"{a}{i}", f"{b}{i-1}") for i in range(1, n) for a in "xy" for b in "xy"]
    tail = [("a0", "b"), ("b", "c"), ("c", "a0"), ("c", "d0")] + [(f"d{i}", f"d{i+1}") for i in range(50)] + [("e", "a0"), ("f", "e")]
    names = {t for pair in tail for t in pair}
    graphs = {"ladder": ([f"{a}{i}" for i in range(n) for a in "xy"], ladder), "cycle": (sorted(names), tail)}
    sets = []
    kept = g.materialise
    monkeypatch.setattr(g, "materialise", lambda df, name: sets.append(kept(df, name)) or sets[-1] if name == "paths" else kept(df, name))
    got = dict(tuple(r) for r in g.critical_path(*frames(spark, graphs)).collect())
    # f, e, a0, b, c, and d0 to d50.
    assert got == {"ladder": n, "cycle": 5 + 51}
    assert sum(s.count() for s in sets) <= 3 * 2 + 3 * 2 and len(sets) == 3


def test_no_edges_at_all(spark):
    tasks, edges = frames(spark, GRAPHS)
    got = g.critical_path(tasks, edges.limit(0)).collect()
    assert {r.critical_path for r in got} == {1} and len(got) == len(GRAPHS)


@pytest.fixture(scope="module")
def flow(spark):
    data = [
        ("d", 0, "a", ["x", "y"], None), ("d", 1, "b", ["z"], ["x", "y"]), ("d", 2, "c", None, ["z", "c_out"]),
        ("e", 0, "a", ["z"], ["z"]),
    ]
    return spark.createDataFrame(
        data, "dag_id string, pos int, task_id string, outputs array<string>, inputs array<string>"
    )


def test_flow_edges_are_distinct_and_forward(flow, rows):
    assert rows(g.dataflow_edges(flow)) == [("d", "b", "a"), ("d", "c", "b")]


def test_shared_items(flow, rows):
    assert rows(g.shared_items(flow)) == [("d", "x"), ("d", "y"), ("d", "z"), ("e", "z")]


def test_profile_and_cost_by_hand(spark):
    df = spark.createDataFrame(
        [("d", 1, 2, None), ("d", 2, 4, ["x"]), ("d", 3, 8, [])],
        "dag_id string, cpu int, memory_gb int, inputs array<string>",
    )
    p = g.plan_profile(df).first()
    assert (p.runtime_minutes, p.total_cpu, p.total_memory_gb, p.parallelizable_tasks, p.complexity_score) == (
        15, 6, 14, 2, 60
    )
    c = g.plan_cost(df).first()
    # (6 * 0.10 + 14 * 0.02) * 0.5 = 0.44
    assert (c.cost_per_run, c.monthly_cost, c.compute, c.storage, c.network) == (0.44, 13.2, 0.31, 0.09, 0.04)


def test_items_expand_to_edges(spark):
    import random

    from pipelytics.operators import graph as g

    rng = random.Random(4)
    pick = lambda: rng.choice([None, [], rng.choices("abcdef", k=rng.randint(1, 4))])
    tasks = [(rng.randint(0, 4), f"t{i}", rng.randint(0, 30), pick(), pick()) for i in range(300)]
    # One item that every task of a workflow produces and uses: linear in the tasks, not in their pairs.
    tasks += [(9, f"t{i}", i, ["hot"], ["hot"]) for i in range(200)]
    schema = "dag_id int, task_id string, pos int, inputs array<string>, outputs array<string>"
    df = spark.createDataFrame(tasks, schema)
    items = g.dataflow_items(df)
    assert items.where("dag_id = 9").count() == 398
    edges = lambda e: sorted(map(tuple, e.collect()))
    assert edges(g.expand_items(items)) == edges(g.dataflow_edges(df))
    assert g.dataflow_items(df.limit(0)).count() == 0
