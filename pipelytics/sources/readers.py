"""Reading tables and bringing feeds to one shape."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("csv", "json", "parquet", "orc", "avro")


def read_table(
    spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None, **options
) -> DataFrame:
    """Read one table; text formats need a schema, since guessing it costs a scan."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt}")
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs an explicit schema")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except Exception as e:
        if fmt == "avro" and "avro" in str(e).lower():
            raise RuntimeError("avro needs the spark-avro package on the class path") from e
        raise


def union_sources(
    feeds: Sequence[tuple[DataFrame, Mapping[str, str], Mapping[str, str], str]],
) -> DataFrame:
    """Rename, cast and tag each ``(frame, renames, casts, name)``, then stack them by name."""

    def shaped(df, renames, casts, name):
        cols = []
        for c in df.columns:
            target = renames.get(c, c)
            col = F.col(c)
            cols.append((col.cast(casts[target]) if target in casts else col).alias(target))
        return df.select(*cols, F.lit(name).alias("source"))

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [shaped(*f) for f in feeds]
    )


def incremental_load(df: DataFrame, column: str, high_water_mark) -> DataFrame:
    """Rows past the mark; the filter is on the bare column, so it reaches the scan."""
    return df.where(F.col(column) > F.lit(str(high_water_mark)).cast(df.schema[column].dataType))


def next_mark(df: DataFrame, column: str, high_water_mark) -> DataFrame:
    """The next mark: the largest new value, or the old mark when nothing is new."""
    old = F.lit(str(high_water_mark)).cast(df.schema[column].dataType)
    return incremental_load(df, column, high_water_mark).agg(
        F.coalesce(F.max(column), old).alias("next_mark"), F.count(F.lit(1)).alias("new_rows")
    )


def schema_evolution_read(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a parquet dataset; columns absent from old files are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


#: Schemes of paths that Arrow's file systems open, and the longest content that Spark's binary source holds in a row.
_OPENED = {"file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss"}
_LONGEST = 2**31 - 1


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checksums of whole files, read in pieces of 8 MB."""
    for batch in batches:
        found = []
        for path in batch["path"]:
            local = re.match(r"file:/+(.*)", path, re.S)
            system, place = (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while piece := stream.read(8 << 20):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)


def file_manifest(spark: SparkSession, path: str, glob: str = "*", whole: int = 256 << 20) -> DataFrame:
    """Name, size and checksum of every file, of any size.

    Files of up to ``whole`` bytes are hashed by Spark as one value, longer ones
    in pieces by tasks. Paths that only Spark can open are hashed as one value
    up to its limit of 2 GB, and refused beyond.

    A scan passes over empty files, so they are added from the listing that
    Spark holds for the folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    # The listing quotes paths and writes an empty host; the scan does neither.
    paths = [(re.sub(r"^(\w+):///", r"\1:/", unquote(p)),) for p in files.inputFiles()]
    if {p.split(":")[0] for (p,) in paths} - _OPENED:
        whole = _LONGEST
    size = F.col("length")
    scanned = files.where(size <= whole).select(name, size.alias("bytes"), F.sha2("content", 256).alias("sha256"))
    # Without the content the scan reads no file, so the limit of a row does not matter.
    pieces = files.where(size > whole).select("path", "length").mapInPandas(
        _hash_files, "path string, length bigint, sha256 string"
    )
    listed = spark.createDataFrame(paths, "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select(
        name, F.lit(0).cast("bigint").alias("bytes"),
        F.sha2(F.lit("").cast("binary"), 256).alias("sha256"),
    )
    return scanned.unionAll(pieces.select(name, size.alias("bytes"), "sha256")).unionAll(empty)
