"""Error logs: classification, remedies, and how well remedies work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recovery as r
from ..functions.exact import share


def classify_errors(errors: DataFrame) -> DataFrame:
    return errors.withColumn("error_type", r.error_type(F.col("error_class"), F.col("message")))


def missing_modules(errors: DataFrame) -> DataFrame:
    return errors.withColumn("module", r.missing_module(F.col("message")))


def fix_plan(errors: DataFrame) -> DataFrame:
    """Add the kind of each error and the fields of its remedy."""
    return (
        classify_errors(errors)
        .withColumn(
            "_plan",
            r.fix_plan(F.col("error_type"), F.col("message"), F.col("memory"), F.col("cpu")),
        )
        .select("*", "_plan.*")
        .drop("_plan")
    )


def scale_resources(errors: DataFrame) -> DataFrame:
    return errors.withColumn("new_memory", r.grown_memory(F.col("memory"))).withColumn(
        "new_cpu", r.grown_cpu(F.col("cpu"))
    )


def fix_success_rate(attempts: DataFrame) -> DataFrame:
    """Share of attempts that worked per kind; failed attempts count as attempts."""
    return attempts.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("successes"),
        share(F.col("success")).alias("success_rate"),
    )


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Count and unattended share per kind, and over all errors (kind ``all``)."""
    return (
        fix_plan(errors)
        .rollup("error_type")
        .agg(
            F.count(F.lit(1)).alias("errors"),
            share(F.col("auto_fixable")).alias("auto_fixable_share"),
            F.grouping("error_type").alias("_all"),
        )
        .select(
            F.when(F.col("_all") == 1, "all").otherwise(F.col("error_type")).alias("error_type"),
            "errors", "auto_fixable_share",
        )
    )
