"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Arrow types of the columns that operators add.
ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
}
#: What separates words: the ASCII white space, and nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``taken`` has them (in any case)."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def fold(key: str, n: int) -> Column:
    """The fold of a row: CRC-32 of its key as text, modulo ``n``. A null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def cuts(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``budget`` bytes; a larger row stands alone."""
    upto = np.cumsum(sizes)
    low, base = 0, 0
    while low < len(sizes):
        high = max(int(np.searchsorted(upto, base + budget, side="right")), low + 1)
        yield low, high
        low, base = high, int(upto[high - 1])


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    added: Sequence[tuple[str, str]],
    build: Callable[[], Callable[..., Sequence]],
    budget: int = 3_000_000,
) -> DataFrame:
    """Append columns that Python makes from the text columns ``inputs``, a few megabytes at a time.

    ``build`` runs once per task and returns a function from lists (one per
    input) to one sequence per added column. Columns of ``df`` that carry the
    name of an added one are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    names = {name.lower() for name, _ in added}
    own = [f for f in df.schema.fields if f.name.lower() not in names]
    held = [f.name for f in own]
    wanted = list(dict.fromkeys([*held, *inputs]))
    source = df.select(*[F.col(f"`{c}`") for c in wanted])
    del spark
    schema = StructType(
        [StructField(f.name, f.dataType, True) for f in own]
        + [StructField(name, _parse_datatype_string(kind)) for name, kind in added]
    )
    kinds = [ARROW[kind] for _, kind in added]
    out_names = [*held, *[name for name, _ in added]]
    to_arrow_schema(schema)  # fails here, not in a task, if a type has no Arrow form

    def run(batches):
        make = build()
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for name in inputs:
                lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0)
                sizes += lengths.to_numpy(zero_copy_only=False)
            for low, high in cuts(sizes, budget):
                part = batch.slice(low, high - low)
                made = make(*[part.column(name).to_pylist() for name in inputs])
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in held]
                    + [x if isinstance(x, pa.Array) else pa.array(x, type=kind) for x, kind in zip(made, kinds, strict=True)],
                    names=out_names,
                )

    return source.mapInArrow(run, schema)
