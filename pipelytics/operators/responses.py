"""Workflow answers of language models, one answer per row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses as r


def strip_fences(responses: DataFrame) -> DataFrame:
    return responses.select("response_id", r.without_fences(F.col("text")).alias("body"))


def repair_json(responses: DataFrame) -> DataFrame:
    """Parse each answer, after repairs if needed; ``parse_mode`` tells which it took."""
    body, fixed = F.col("body"), F.col("_fixed")
    # One column per step, so that no text is parsed or repaired twice.
    steps = (
        strip_fences(responses)
        .withColumn("_valid", r.is_json(body))
        .withColumn("_fixed", F.when(~F.col("_valid"), r.repaired(body)))
        .withColumn(
            "parse_mode",
            F.when(F.col("_valid"), "valid").when(r.is_json(fixed), "repaired").otherwise("failed"),
        )
    )
    text = F.when(F.col("parse_mode") != "failed", F.coalesce(fixed, body))
    return steps.select("response_id", "body", "parse_mode", r.as_workflow(text).alias("workflow"))


def _with_guess(df: DataFrame, wanted=None) -> DataFrame:
    """Add ``_guess``, the tasks read by pattern: triples, else blocks, else a fixed chain.

    Each step is a column that is only filled where the steps before found nothing.
    """
    body = F.col("body") if wanted is None else F.when(wanted, F.col("body"))
    return (
        df.withColumn("_body", body)
        .withColumn("_triples", r.task_triples(F.col("_body")))
        .withColumn("_blocks", F.when(F.size("_triples") <= 0, r.task_blocks(F.col("_body"))))
        .withColumn(
            "_guess",
            F.when(F.size("_triples") > 0, F.col("_triples"))
            .when(F.size("_blocks") > 0, F.transform("_blocks", r.loose_task))
            .otherwise(r.default_tasks(F.col("_body"))),
        )
    )


def extract_workflow_fields(responses: DataFrame) -> DataFrame:
    """Fields and tasks read by pattern alone, with defaults for what is missing."""
    return _with_guess(strip_fences(responses)).select(
        "response_id",
        *[r.found_field(F.col("body"), n).alias(n) for n in r.FIELD_PATTERNS],
        F.col("_guess").alias("tasks"),
    )


def chain_missing_dependencies(workflows: DataFrame) -> DataFrame:
    """Link each task without upstream to the task before it."""
    return workflows.withColumn("tasks", r.chained(F.col("tasks")))


def parse_workflows(responses: DataFrame) -> DataFrame:
    """One workflow per answer: parsed, repaired, read by pattern, or defaulted."""
    ok = F.col("parse_mode") != "failed"
    parsed = _with_guess(repair_json(responses), ~ok)
    mode = (
        F.when(ok, F.col("parse_mode")).when(F.size("_guess") > 0, "regex").otherwise("default")
    )
    return parsed.select(
        "response_id",
        mode.alias("parse_mode"),
        *[
            F.when(ok, F.col(f"workflow.{n}")).otherwise(r.found_field(F.col("body"), n)).alias(n)
            for n in r.FIELD_PATTERNS
        ],
        F.when(ok, F.col("workflow.tasks")).otherwise(r.chained(F.col("_guess"))).alias("tasks"),
    )
