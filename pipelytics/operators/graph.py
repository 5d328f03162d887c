"""Task graphs: many workflows in one table of tasks and one of edges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges other than from a task to itself."""
    return edges.where(F.col("task_id") != F.col("upstream_id"))


def _items(tasks: DataFrame, column: str, *keep: str) -> DataFrame:
    return tasks.select("dag_id", *keep, F.explode(column).alias("item"))


def dataflow_edges(tasks: DataFrame) -> DataFrame:
    """An edge from an earlier task to each later one that uses what it produces.

    Joined on workflow and item, so a large workflow spreads over its items.
    """
    made = _items(tasks, "outputs", "task_id", "pos").selectExpr(
        "dag_id", "item", "task_id as upstream_id", "pos as upstream_pos"
    )
    used = _items(tasks, "inputs", "task_id", "pos")
    return (
        used.join(made, ["dag_id", "item"])
        .where("upstream_pos < pos")
        .select("dag_id", "task_id", "upstream_id")
        .distinct()
    )


def dataflow_items(tasks: DataFrame) -> DataFrame:
    """The edges of ``dataflow_edges`` by way of their items, so that size is linear in what tasks list.

    A row ties a task to an item that it produces or uses, where that makes an
    edge at all. A task that uses an item waits for every task that produces it
    at a smaller ``pos``; ``expand_items`` writes these edges out. The bounds of
    an item are combined before the shuffle, so one that most tasks share is one row.
    """
    both = (
        _items(tasks, "outputs", "task_id", "pos").withColumn("role", F.lit("produces"))
        .unionByName(_items(tasks, "inputs", "task_id", "pos").withColumn("role", F.lit("uses")))
    )
    made, used = F.col("role") == "produces", F.col("role") == "uses"
    bounds = both.groupBy("dag_id", "item").agg(
        F.min(F.when(made, F.col("pos"))).alias("_first"), F.max(F.when(used, F.col("pos"))).alias("_last")
    )
    tied = both.join(bounds.where("_first < _last"), ["dag_id", "item"])
    tied = tied.where((made & (F.col("pos") < F.col("_last"))) | (used & (F.col("pos") > F.col("_first"))))
    return tied.select("dag_id", "item", "task_id", "pos", "role").distinct()


def expand_items(items: DataFrame) -> DataFrame:
    """The edges that ``dataflow_items`` stands for; as many as there are dependencies."""
    made = items.where("role = 'produces'").selectExpr("dag_id", "item", "task_id as upstream_id", "pos as _made")
    used = items.where("role = 'uses'").drop("role")
    return used.join(made, ["dag_id", "item"]).where("_made < pos").select("dag_id", "task_id", "upstream_id").distinct()


def shared_items(tasks: DataFrame) -> DataFrame:
    """Items of a workflow that some task produces and some task uses."""
    return _items(tasks, "outputs").intersect(_items(tasks, "inputs"))


def plan_profile(tasks: DataFrame) -> DataFrame:
    """Runtime estimate, resource totals, root tasks and complexity per workflow."""
    n, cpu = F.count(F.lit(1)), F.sum("cpu")
    return tasks.groupBy("dag_id").agg(
        (n * 5).alias("runtime_minutes"),
        cpu.alias("total_cpu"),
        F.sum("memory_gb").alias("total_memory_gb"),
        F.count_if(F.coalesce(F.size("inputs"), F.lit(0)) <= 0).alias("parallelizable_tasks"),
        (n * 10 + cpu * 5).alias("complexity_score"),
    )


def plan_cost(tasks: DataFrame) -> DataFrame:
    """Cost per run and month, and its split, at fixed prices and half an hour per task.

    Decimal throughout, so that cents round the same way on every run.
    """
    term = (F.col("cpu") * F.lit(Decimal("0.10")) + F.col("memory_gb") * F.lit(Decimal("0.02"))) * F.lit(
        Decimal("0.5")
    )
    parts = {"cost_per_run": "1", "monthly_cost": "30", "compute": "0.7", "storage": "0.2", "network": "0.1"}
    return (
        tasks.groupBy("dag_id")
        .agg(F.sum(term.cast("decimal(18,3)")).cast("decimal(24,3)").alias("_cost"))
        .select(
            "dag_id",
            *[
                F.round(F.col("_cost") * F.lit(Decimal(f)), 2).cast("double").alias(n)
                for n, f in parts.items()
            ],
        )
    )


def critical_path(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of tasks on the longest chain of each workflow, without a repeated task.

    An upstream id that names no task counts as one more link. Pairs of tasks that
    a walk of 1, 2, 4, 8 ... links joins are found by joining those of half the
    length; then the longest walk is put together from the longest pieces down, so a
    chain of n tasks takes about 2 log n rounds. A walk with more links than there are tasks
    shows a cycle. Only tasks on cycles are searched path by path, which can be
    exponential in the size of a cycle, as the longest chain without repetition
    is; every way through a cycle then stands in the graph as a chain of its own.
    """
    nodes = tasks.select("dag_id", "task_id").distinct()
    links = clean_edges(edges).select("dag_id", "task_id", "upstream_id").distinct()
    links = links.join(nodes, ["dag_id", "task_id"], "left_semi")
    links = materialise(links.select("dag_id", F.col("task_id").alias("at"), F.col("upstream_id").alias("to")), "links")
    walks, core = _walks(links)
    if core is None:
        return _longest(nodes.select("dag_id", F.col("task_id").alias("at")), walks)
    looped = core.select("dag_id").distinct()
    plain = nodes.join(looped, "dag_id", "left_anti").select("dag_id", F.col("task_id").alias("at"))
    unrolled = _unrolled(links.join(looped, "dag_id", "left_semi"), core)
    again, rest = _walks(unrolled)
    assert rest is None, "ways through cycles are chains"
    starts = unrolled.select("dag_id", "at").distinct()
    return _longest(plain, walks).unionByName(_longest(starts, again))


def _walks(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Pairs joined by walks of 1, 2, 4 ... links, as long as there are any; and the core of workflows with cycles.

    The core is what a walk of more links than tasks both leaves and enters: tasks on
    cycles and between them. Workflows with a core are dropped from the longer walks.
    """
    limits = links.groupBy("dag_id").agg(F.count_distinct("at").alias("limit"))
    walks, core, length = [links.join(limits, "dag_id")], None, 1
    walks[0] = materialise(walks[0], "walks")
    while True:
        length *= 2
        on = walks[-1].select("dag_id", F.col("at").alias("to"), F.col("to").alias("end"))
        longer = walks[-1].join(on, ["dag_id", "to"]).select("dag_id", "at", F.col("end").alias("to"), "limit").distinct()
        longer = materialise(longer, "walks")
        over = F.col("limit") < length
        n, beyond = longer.agg(F.count(F.lit(1)), F.count_if(over)).first()
        if beyond:
            looped = longer.where(over)
            both = looped.select("dag_id", "at").intersect(looped.select("dag_id", F.col("to").alias("at")))
            both = materialise(both, "core")
            core = both if core is None else core.unionByName(both)
            longer = longer.where(~over)
        if n == beyond:
            return walks, core
        walks.append(longer)


def _longest(starts: DataFrame, walks: list[DataFrame]) -> DataFrame:
    """Tasks on the longest walk of each workflow: the longest piece that continues what is there, then shorter ones.

    ``here`` holds where all walks of the length found so far end.
    """
    here, found = starts, starts.select("dag_id", F.lit(1).cast("bigint").alias("n")).distinct()
    for k in range(len(walks) - 1, -1, -1):
        on = here.join(walks[k], ["dag_id", "at"]).select("dag_id", F.col("to").alias("at")).distinct()
        on = materialise(on, "ends")
        going = on.select("dag_id").distinct()
        found = found.unionByName(going.select("dag_id", F.lit(1 << k).cast("bigint").alias("n")))
        here = on.unionByName(here.join(going, "dag_id", "left_anti"))
    return found.groupBy("dag_id").agg(F.sum("n").alias("critical_path"))


def _cycles(inner: DataFrame) -> DataFrame:
    """``dag_id, at, cycle``: the tasks that reach each other, named by the least of them."""
    reach = materialise(inner, "reach")
    size = reach.count()
    while True:
        on = reach.select("dag_id", F.col("at").alias("to"), F.col("to").alias("end"))
        more = reach.join(on, ["dag_id", "to"]).select("dag_id", "at", F.col("end").alias("to"))
        reach = materialise(reach.unionByName(more).distinct(), "reach")
        grown = reach.count()
        if grown == size:
            break
        size = grown
    back = reach.select("dag_id", F.col("to").alias("at"), F.col("at").alias("to"))
    mutual = reach.join(back, ["dag_id", "at", "to"], "left_semi")
    return materialise(mutual.groupBy("dag_id", "at").agg(F.min("to").alias("cycle")), "cycles")


def _ways(within: DataFrame, members: DataFrame) -> DataFrame:
    """``dag_id, first, last, n``: tasks on the longest chain without repetition between any two tasks of a cycle.

    Of a chain only its ends and the set of its tasks matter, so chains that
    differ in order alone are followed once.
    """
    paths = members.select("dag_id", F.col("at").alias("first"), F.col("at"), F.array("at").alias("path"))
    ways = paths.select("dag_id", "first", F.col("at").alias("last"), F.lit(1).alias("n"))
    while True:
        grown = paths.join(within, ["dag_id", "at"]).where(~F.array_contains("path", F.col("to")))
        paths = materialise(
            grown.select(
                "dag_id", "first", F.col("to").alias("at"), F.array_sort(F.concat("path", F.array("to"))).alias("path")
            ).distinct(),
            "paths",
        )
        if paths.isEmpty():
            return materialise(ways, "ways")
        found = paths.select("dag_id", "first", F.col("at").alias("last"), F.size("path").alias("n"))
        ways = ways.unionByName(found).groupBy("dag_id", "first", "last").agg(F.max("n").alias("n"))


def _unrolled(links: DataFrame, core: DataFrame) -> DataFrame:
    """Links of the same chains without cycles: each way through a cycle is a chain, entered and left at its ends.

    A node is ``(first, last, i)``: the i-th of a way, or a task by itself with i = 0.
    """
    ends = core.select("dag_id", F.col("at").alias("to"))
    inner = links.join(core, ["dag_id", "at"], "left_semi").join(ends, ["dag_id", "to"], "left_semi").select("dag_id", "at", "to")
    cycles = _cycles(inner)
    cycle_of = cycles.select("dag_id", F.col("at").alias("to"), F.col("cycle").alias("next_cycle"))
    marked = links.join(cycles, ["dag_id", "at"], "left").join(cycle_of, ["dag_id", "to"], "left")
    same = F.coalesce(F.col("cycle") == F.col("next_cycle"), F.lit(False))
    marked = materialise(marked.select("dag_id", "at", "to", same.alias("same")), "marked")
    ways = _ways(marked.where("same").select("dag_id", "at", "to"), cycles)
    node = lambda first, last, i: F.struct(first.alias("first"), last.alias("last"), i.cast("int").alias("i"))
    first, last, n = F.col("first"), F.col("last"), F.col("n")
    chains = ways.where("n > 1").select("dag_id", "first", "last", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    chains = chains.select("dag_id", node(first, last, F.col("k")).alias("at"), node(first, last, F.col("k") + 1).alias("to"))
    tails = ways.select("dag_id", F.col("last").alias("at"), node(first, last, n).alias("tail"))
    heads = ways.select("dag_id", F.col("first").alias("to"), node(first, last, F.lit(1)).alias("head"))
    alone = lambda c: node(F.col(c), F.col(c), F.lit(0))
    outer = marked.where("not same").join(tails, ["dag_id", "at"], "left").join(heads, ["dag_id", "to"], "left")
    outer = outer.select("dag_id", F.coalesce("tail", alone("at")).alias("at"), F.coalesce("head", alone("to")).alias("to"))
    return materialise(chains.unionByName(outer), "unrolled")
