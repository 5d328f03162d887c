"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exact import moment_like


def long_form(row: DataFrame, ids: Sequence[str], values: Mapping[str, Column], name: str, value: str):
    """One output row per named value of a wide row."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()]
    )
    return row.select(*ids, F.inline(pairs))


def negative_amounts(orders: DataFrame) -> DataFrame:
    """Orders whose amount is zero or less."""
    return orders.where("total_amount <= 0")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def validation_report(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Counts of bad rows and an overall status: unknown customers fail the data.

    A customer listed twice is known once, and an order without customer is an
    order of an unknown one. Orders are first reduced to one row per id, customer and sign of the amount,
    which serves all three checks from one scan and one shuffle.
    """
    known = customers.select("customer_id").distinct().withColumn("known", F.lit(1))
    per_order = (
        orders.groupBy("order_id", "customer_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("total_amount") <= 0).alias("negatives"),
        )
        .join(known, "customer_id", "left")
        .groupBy("order_id")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("negatives").alias("negatives"),
            F.sum(F.when(F.col("known").isNull(), F.col("rows")).otherwise(0)).alias("orphans"),
        )
    )
    totals = per_order.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negative_orders"),
        F.coalesce(F.sum("orphans"), F.lit(0)).alias("invalid_customers"),
        F.count_if(F.col("rows") > 1).alias("duplicates"),
    )
    return totals.withColumn(
        "status",
        F.when(F.col("invalid_customers") > 0, "failed")
        .when((F.col("negative_orders") > 0) | (F.col("duplicates") > 0), "warning")
        .otherwise("success"),
    )


def rule_engine(df: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Failed rows, their ratio and the verdict for each ``(name, predicate, max ratio)``.

    A predicate that is null counts as failed. All rules share one pass.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if(~F.coalesce(F.expr(pred), F.lit(False))).alias(f"_r{i}")
            for i, (_, pred, _) in enumerate(rules)
        ],
    )
    ratio = lambda i: F.try_divide(F.col(f"_r{i}"), F.col("_rows"))
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.col(f"_r{i}").alias("failed_rows"),
                        ratio(i).alias("failed_ratio"),
                        (F.coalesce(ratio(i), F.lit(0.0)) <= limit).alias("passed"),
                    )
                    for i, (name, _, limit) in enumerate(rules)
                ]
            )
        )
    )


def quarantine(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """All rows, each with the names of the rules it breaks; empty means good."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.expr(pred), F.lit(False)), F.lit(name))
                for name, pred in rules
            ]
        )
    )
    return df.withColumn("violations", broken)


def freshness(
    df: DataFrame, group: str, ts: str, as_of: datetime, max_age_seconds: int
) -> DataFrame:
    """Newest row per group, its age in whole seconds, and whether it is too old."""
    newest = df.groupBy(group).agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), moment_like(as_of, df, ts))
    return newest.select(
        group, "newest", age.alias("age_seconds"), (age > max_age_seconds).alias("stale")
    )


def readiness_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Whether each table has at least one row; one row is read, not the table."""
    checks = [
        df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ready")).select(
            F.lit(name).alias("table_name"), "ready"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, checks)


def null_counts(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return long_form(wide, [], {c: F.col(c) for c in df.columns}, "column_name", "nulls")


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(
        *[F.min(c).cast("double").alias(f"min_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in columns],
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"min_{c}").alias("min_value"),
            F.col(f"max_{c}").alias("max_value"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*pairs)))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(F.col(column).alias("category"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "category")
    )


def feature_stats(df: DataFrame) -> DataFrame:
    """Row count, column count and the number of missing cells."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("feature_count"),
        missing.alias("missing_values"),
    )


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population deviation, largest and smallest value per column.

    Sums of doubles, at any scale; the order in which tasks add up may show in
    the last digits.
    """
    wide = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in columns],
        *[F.min(c).cast("double").alias(f"min_{c}") for c in columns],
    )

    def entry(c):
        return F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"mean_{c}").alias("mean"),
            F.col(f"std_{c}").alias("std"),
            F.col(f"max_{c}").alias("max"),
            F.col(f"min_{c}").alias("min"),
        )

    return wide.select(F.inline(F.array(*[entry(c) for c in columns])))


def distinct_profile(df: DataFrame, columns: Sequence[str], rsd: float = 0.05) -> DataFrame:
    """Exact and approximate distinct counts, and surplus copies, per column.

    Values are counted per column first (combined before the shuffle), so a
    value that fills most rows moves as one row per task.
    """
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        )
    )
    values = cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("copies"))
    present = F.col("value").isNotNull()
    return values.groupBy("column_name").agg(
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(present, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
        F.approx_count_distinct("value", rsd).alias("approx_distinct"),
    )


def type_profile(df: DataFrame) -> DataFrame:
    """Column name, logical type and number of filled rows."""
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("logical_type"),
                        F.col(f.name).alias("filled_rows"),
                    )
                    for i, f in enumerate(df.schema)
                ]
            )
        )
    )


def _schema_rows(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    schema = T.StructType(
        [T.StructField("column_name", T.StringType()), T.StructField("logical_type", T.StringType())]
    )
    return df.sparkSession.createDataFrame(list(fields), schema)


def schema_diff(df: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns that are missing, extra or of another type than expected."""
    have = _schema_rows(df, [(f.name, f.dataType.simpleString()) for f in df.schema])
    want = _schema_rows(df, expected)
    lost = want.exceptAll(have).withColumnRenamed("logical_type", "expected_type")
    found = have.exceptAll(want).withColumnRenamed("logical_type", "found_type")
    return lost.join(found, "column_name", "full").withColumn(
        "change",
        F.when(F.col("found_type").isNull(), "missing")
        .when(F.col("expected_type").isNull(), "extra")
        .otherwise("retyped"),
    )


def convert_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed columns, and the names of columns whose text did not convert."""
    typed = {c: F.col(c).try_cast(t) for c, t in types.items()}
    rejects = F.array_compact(
        F.array(
            *[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in typed.items()]
        )
    )
    rest = [F.col(c) for c in df.columns if c not in typed]
    return df.select(*rest, *[v.alias(c) for c, v in typed.items()], rejects.alias("_rejects"))


def dedupe_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; ``order`` lists what makes a row newer, most important first.

    An aggregate rather than a window: each task keeps one row per key before
    the shuffle, so many copies of one key cost nothing to move.
    """
    row = F.struct(*df.columns)
    newest = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return newest.select("_row.*")
