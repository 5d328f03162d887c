"""Opening table streams and running them until the input is used up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from ..views import TABLES, Tables


class StreamTables(Tables):
    """Stored tables as file streams, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str, batch_bytes: int = 16 << 30):
        super().__init__(spark, folder)
        self.batch_bytes = batch_bytes

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
            # As a pattern, the path may be a single file as well as a folder.
            return open_stream(self.spark, f"{self.folder}/{{{name}}}.parquet", schema, self.batch_bytes)
        return super().__getattr__(name)


def open_stream(
    spark: SparkSession, path: str, schema: StructType, batch_bytes: int = 16 << 30
) -> DataFrame:
    """A stream over a parquet file or folder; ``batch_bytes`` bounds every micro-batch."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Zone-less times as instants, which watermarks need, and the watermark itself."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_append(
    df: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None
) -> DataFrame:
    """Run to the end of the input into a parquet folder, and read that folder.

    A query that resumes from a checkpoint must keep writing to the same folder.
    """
    spark = df.sparkSession
    out = out or scratch_path(spark, name)
    query = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(
    df: DataFrame, name: str, mode: str, handle: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
) -> None:
    """Run to the end of the input, passing every micro-batch to ``handle``."""
    query = (
        df.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch_path(df.sparkSession, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_complete(df: DataFrame, name: str) -> DataFrame:
    """Run an aggregation to the end of the input and return its final table; without any input, an empty one.

    Every micro-batch rewrites its own folder, so a repeated batch does no harm. The
    whole table is written each time: for a few groups only, see ``run_updates``.
    """
    spark = df.sparkSession
    out = scratch_path(spark, name)
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)

    run_batches(df, name, "complete", keep)
    if not seen:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{out}/batch={max(seen)}")


def run_updates(
    df: DataFrame, keys: Sequence[str], name: str, checkpoint: str | None = None, out: str | None = None
) -> DataFrame:
    """Run a windowed aggregation to the end of the input and return the newest version of each of its rows.

    A micro-batch writes the rows that it has changed, as their next version, into a
    folder of its own, which a repeated batch rewrites. Spark drops the state of
    windows that the watermark has passed; windows still open at the end are in the
    result as they stand. A query that resumes from a checkpoint must keep writing to
    the same folder. Without any input the result is empty.
    """
    spark = df.sparkSession
    out = out or scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(df, name, "update", keep, checkpoint)
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    versions = spark.read.schema(f"{_ddl(df)}, batch bigint").parquet(out)
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("row"))
    return newest.select("row.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
