"""Writing tables: append, versioned upsert, partitioned rewrite."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import money_sum


def append_customer_analytics(revenue: DataFrame, path: str) -> DataFrame:
    """Append daily revenue rows and read the table back."""
    revenue.write.mode("append").parquet(path)
    return revenue.sparkSession.read.schema(revenue.schema).parquet(path)


def merge_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows with matching keys replaced, and unmatched updates added.

    An update without a value leaves the stored one in place. Keys must be
    unique in ``updates``; ``quality.dedupe_latest`` makes them so.
    """
    rest = [c for c in target.columns if c not in keys]
    right = updates.select(
        *[F.col(k).alias(f"_u_{k}") for k in keys], *[F.col(c).alias(f"_u_{c}") for c in rest]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_u_{k}")) for k in keys])
    return target.join(right, same, "full").select(
        *[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) for c in target.columns]
    )


_COMMITTED = "_COMMITTED"


def _commit(spark: SparkSession, folder: str) -> None:
    """Mark a version as complete, with a file of our own: Spark's marker can be switched off."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, _COMMITTED)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()


def _versions(spark: SparkSession, path: str, committed: bool = True) -> list[int]:
    """Versions of a table, oldest first; with ``committed`` only the complete ones."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(entry.getPath(), _COMMITTED)
        if name.startswith("version=") and (not committed or fs.exists(done)):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest completed version (older than ``before``), or None."""
    versions = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def upsert_customer_metrics(
    path: str, updates: DataFrame, keys: Sequence[str], version: int | None = None, merge=merge_rows
) -> DataFrame:
    """Merge updates into a versioned table and return the new content.

    ``merge`` combines stored rows with updates; by default updates replace.

    Every call writes a new version folder, never the one being read. A
    version given by the caller (a micro-batch number) makes a repeat of the
    same call rewrite the same version from the same predecessor. If that
    is gone, the complete version, which holds the call's result, stays as it is.
    """
    spark = updates.sparkSession
    complete = _versions(spark, path)
    if version is None:
        version = max(complete, default=-1) + 1
    if not complete and set(_versions(spark, path, committed=False)) - {version}:
        raise ValueError(f"{path} holds versions, but none is marked as complete")
    current = read_latest(spark, path, before=version)
    if current is None and version in complete:
        return spark.read.parquet(f"{path}/version={version}")
    merged = updates if current is None else merge(current, updates, keys)
    merged.write.mode("overwrite").parquet(f"{path}/version={version}")
    _commit(spark, f"{path}/version={version}")
    return spark.read.schema(merged.schema).parquet(f"{path}/version={version}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` complete versions of a table; the versions removed."""
    gone = _versions(spark, path)[: -max(1, keep)]
    for version in gone:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return gone


def fold_metrics(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored customer metrics with those of more orders added: sums add up, the last order is the later one."""
    both = target.unionByName(updates)
    return both.groupBy(*keys).agg(
        money_sum("lifetime_value").alias("lifetime_value"),
        F.sum("order_count").alias("order_count"),
        F.max("last_order").alias("last_order"),
    )


def daily_summary(revenue: DataFrame) -> DataFrame:
    """Rows, revenue and customers per day of a daily revenue table."""
    return revenue.groupBy("order_day").agg(
        F.count(F.lit(1)).alias("inserted_rows"),
        money_sum("daily_revenue").alias("total_revenue"),
        F.count_distinct("customer_id").alias("customers"),
    )


def write_partitioned(df: DataFrame, path: str, by: str, codec: str = "zstd") -> None:
    """Write one folder per value of ``by``; only the folders present in ``df`` are replaced.

    Rows of a value are brought together to avoid a file per task and value; a
    value with most of the rows is split again by adaptive execution.
    """
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec)
        .partitionBy(by)
        .parquet(path)
    )
