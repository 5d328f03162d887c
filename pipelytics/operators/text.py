"""From free-text descriptions to typed, linked steps.

A description is one row, and everything derived from it is computed inside
that row as arrays, so no operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.unnest import unnest


def split_steps(descriptions: DataFrame) -> DataFrame:
    return unnest(descriptions, ["doc_id"], x.steps(F.col("text")), "idx")


def classify_steps(steps: DataFrame) -> DataFrame:
    return steps.withColumn("step_type", x.step_type(F.col("step")))


def extract_entities(steps: DataFrame) -> DataFrame:
    low = F.lower("step")
    database = x.first_found(low, x.DATABASES)
    return steps.select(
        "*",
        x.table_name(F.col("step")).alias("table_name"),
        database.alias("database_type"),
        x.first_found(low, x.FILE_FORMATS).alias("file_format"),
        x.connection_id(database).alias("connection_id"),
    )


def step_ids(steps: DataFrame) -> DataFrame:
    return steps.withColumn("step_id", x.step_id(F.col("step"), F.col("idx")))


def _described() -> Column:
    """The steps of ``text`` with what decides on their dependencies."""
    return F.transform(
        x.steps(F.col("text")),
        lambda s: F.struct(
            s["idx"].alias("idx"),
            x.step_id(s["step"], s["idx"]).alias("step_id"),
            x.table_name(s["step"]).isNotNull().alias("names_table"),
            x.has_any(F.lower(s["step"]), x.CONSUMING_WORDS).alias("consumes"),
            x.has_any(F.lower(s["step"]), x.NOTIFYING_WORDS).alias("notifies"),
        ),
    )


def step_dependencies(descriptions: DataFrame) -> DataFrame:
    """Each step with the ids of the earlier steps it waits for.

    A step that processes or checks waits for every earlier step that names a
    table; a step that notifies waits for every earlier step.
    """
    linked = F.transform(
        "_steps",
        lambda s: F.struct(
            s["idx"].alias("idx"),
            s["step_id"].alias("step_id"),
            F.transform(
                F.filter(
                    "_steps",
                    lambda e: (e["idx"] < s["idx"])
                    & (s["notifies"] | (s["consumes"] & e["names_table"])),
                ),
                lambda e: e["step_id"],
            ).alias("depends_on"),
        ),
    )
    stepped = descriptions.select("doc_id", _described().alias("_steps"))
    return unnest(stepped, ["doc_id"], linked, "idx")


def step_waits(descriptions: DataFrame) -> DataFrame:
    """The dependencies of ``step_dependencies`` as one rule per step, so that size is linear in the steps.

    ``waits_for`` is ``all`` earlier steps of the description, its earlier
    ``tables`` (steps whose ``names_table`` is true), or ``none``.
    """
    rules = F.transform(
        "_steps",
        lambda s: F.struct(
            s["idx"].alias("idx"), s["step_id"].alias("step_id"), s["names_table"].alias("names_table"),
            F.when(s["notifies"], "all").when(s["consumes"], "tables").otherwise("none").alias("waits_for"),
        ),
    )
    return unnest(descriptions.select("doc_id", _described().alias("_steps")), ["doc_id"], rules, "idx")


def _with_words(descriptions: DataFrame) -> DataFrame:
    """Add the words of each text as a column, split once for all stages."""
    words = x.spaced_words(F.lower("text"))
    return descriptions.select("doc_id", "text", words.alias("_words"))


def _stages_named(stages) -> Column:
    """The given stages, in order, whose words occur."""
    return F.array_compact(
        F.array(*[F.when(F.arrays_overlap("_words", x.literals(k)), s) for s, k in stages])
    )


def keyword_stages(descriptions: DataFrame) -> DataFrame:
    """A chain from ``init`` over the stages named in the text to ``done``."""
    stage = lambda name: F.struct(
        F.lit(f"{name}_data").alias("task"),
        F.lit("python" if name in x.PYTHON_STAGES else "postgresql").alias("operator"),
    )
    marker = lambda name: F.array(
        F.struct(F.lit(name).alias("task"), F.lit("dummy").alias("operator"))
    )
    found = _stages_named([(stage(n), words) for n, words in x.STAGES.items()])
    chained = F.transform(
        "_chain",
        lambda s, i: F.struct(
            i.alias("pos"), s["task"].alias("task"), s["operator"].alias("operator"),
            F.coalesce(F.get("_chain", i - 1)["task"], F.lit("none")).alias("depends_on"),
        ),
    )
    stages = _with_words(descriptions).select(
        "doc_id", F.concat(marker("init"), found, marker("done")).alias("_chain")
    )
    return unnest(stages, ["doc_id"], chained, "pos")


def stage_fallback(descriptions: DataFrame) -> DataFrame:
    """Numbered tasks for the stage groups named in the text, or one generic task."""
    stages = [
        (F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(text).alias("description")), words)
        for name, kind, text, words in x.FALLBACK_STAGES
    ]
    numbered = F.transform(
        _stages_named(stages),
        lambda s, i: F.struct(
            F.concat_ws("_", s["name"], (i + 1).cast("string")).alias("name"),
            s["type"].alias("type"), s["description"].alias("description"),
        ),
    )
    generic = F.array(
        F.struct(
            F.lit("execute_pipeline").alias("name"), F.lit("generic").alias("type"),
            F.col("text").alias("description"),
        )
    )
    staged = _with_words(descriptions).select("doc_id", "text", numbered.alias("_found"))
    tasks = F.when(F.size("_found") > 0, F.col("_found")).otherwise(generic)
    return unnest(staged, ["doc_id"], tasks, "name")


def default_tasks(descriptions: DataFrame) -> DataFrame:
    """A fixed chain for data work or model work, else a single task with the text itself."""
    def entry(task, text, upstream):
        return F.struct(
            F.lit(task).alias("task_id"), F.lit(x.DEFAULT_OPERATOR).alias("operator"),
            text.alias("description"), F.lit(upstream).cast("string").alias("upstream"),
        )

    def linked(tasks):
        before = [None, *[t for t, _ in tasks]]
        return F.array(*[entry(t, F.lit(d), before[i]) for i, (t, d) in enumerate(tasks)])

    low = F.lower("text")
    tasks = (
        F.when(x.has_any(low, x.DATA_WORDS), linked(x.DATA_CHAIN))
        .when(x.has_any(low, x.MODEL_WORDS), linked(x.MODEL_CHAIN))
        .otherwise(F.array(entry("execute_task", F.col("text"), None)))
    )
    return unnest(descriptions, ["doc_id"], tasks, "task_id")


def operator_and_resources(tasks: DataFrame) -> DataFrame:
    """Operator name and resource estimate for a task type."""
    low = F.lower("task_type")
    operator = (
        F.when(x.has_any(low, ("bash", "shell")), "BashOperator")
        .when(x.has_any(low, ("http", "api")), "SimpleHttpOperator")
        .when(low.contains("sql"), "SqlOperator")
        .otherwise(x.DEFAULT_OPERATOR)
    )
    heavy = x.has_any(low, ("train", "model", "gpu"))
    medium = x.has_any(low, ("etl", "process"))
    return tasks.select(
        "*",
        operator.alias("operator"),
        F.when(heavy, 4).when(medium, 2).otherwise(1).alias("est_cpu"),
        F.when(heavy, "16Gi").when(medium, "8Gi").otherwise("2Gi").alias("est_memory"),
        F.when(heavy, 1).otherwise(0).alias("est_gpu"),
        F.when(heavy, "nvidia-tesla-t4").alias("est_gpu_type"),
    )


def slug_ids(descriptions: DataFrame, as_of: date) -> DataFrame:
    """The first four telling words and a date, joined by underscores."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(x.WORD), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*x.STOP_WORDS))
    slug = F.concat(
        F.array_join(F.slice(telling, 1, 4), "_"), F.lit("_" + as_of.strftime("%Y%m%d"))
    )
    return descriptions.select("doc_id", slug.alias("slug"))


def token_estimate(texts: DataFrame, column: str = "text") -> DataFrame:
    words = x.word_count(F.col(column))
    return texts.withColumn("words", words).withColumn(
        "tokens", F.col("words") * F.lit(x.TOKENS_PER_WORD)
    )


def route_prompts(prompts: DataFrame, available: Sequence[str]) -> DataFrame:
    return prompts.withColumn("routed_to", x.route(F.col("prompt"), list(available)))


def recommend_model(tasks: DataFrame, available: Sequence[str]) -> DataFrame:
    return tasks.withColumn("recommended", x.recommended(F.col("task_type"), list(available)))
