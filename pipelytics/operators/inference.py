"""Applying a batch callable to text columns, with failures kept as rows.

``open_model`` is called once per task and returns a function from a list of
texts to a list of answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from .requests import cache_keys

Model = Callable[[list[str]], list[str]]


def _answer(model: Model, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """Answers and errors; if a batch fails, its rows are tried one by one."""
    try:
        return [(a, None) for a in model(texts)]
    except Exception as e:  # noqa: BLE001
        if len(texts) == 1:
            return [(None, str(e))]
        return [_answer(model, [t])[0] for t in texts]


def batch_infer(
    df: DataFrame, key: str, column: str, open_model: Callable[[], Model], batch: int = 256
) -> DataFrame:
    """Answer, success flag, error text and word count for every row of a text column."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        for part in parts:
            for start in range(0, len(part), batch):
                rows = part.iloc[start : start + batch]
                out = _answer(model, rows[column].tolist())
                yield pd.DataFrame(
                    {
                        key: rows[key].to_numpy(),
                        "answer": [a for a, _ in out],
                        "success": [e is None for _, e in out],
                        "error": [e for _, e in out],
                        "tokens": [len(a.split()) if a else 0 for a, _ in out],
                    }
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(
        run, f"{key} {kind}, answer string, success boolean, error string, tokens bigint"
    )


def cache_dedupe_infer(
    requests: DataFrame, open_model: Callable[[], Model], batch: int = 256
) -> DataFrame:
    """Answer each distinct cache key once, hand the answer to all its requests.

    All but the earliest request of a key are marked as cached. The distinct
    keys are found by an aggregate, so repeats are dropped before they move.
    """
    keyed = cache_keys(requests).select("request_id", "ts", "cache_key", "prompt")
    firsts = keyed.groupBy("cache_key").agg(
        F.min(F.struct("ts", "request_id")).alias("_first"), F.any_value("prompt").alias("prompt")
    )
    answers = batch_infer(firsts, "cache_key", "prompt", open_model, batch)
    first_ids = firsts.select("cache_key", F.col("_first.request_id").alias("_first_id"))
    per_key = answers.join(first_ids, "cache_key")
    # Both sides of the join back are unequal: one row per key on the right, and
    # hot keys on the left, which adaptive execution splits.
    return keyed.join(per_key, "cache_key").select(
        "request_id", "cache_key", "answer", "success",
        (F.col("request_id") != F.col("_first_id")).alias("cached"),
    )


def retrying_map(
    df: DataFrame, key: str, column: str, fn: Callable[[str, int], object], max_retries: int = 3
) -> DataFrame:
    """Call ``fn(value, attempt)`` until it succeeds or the retries are used up; one row per call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            log = []
            for k, value in zip(part[key], part[column]):
                for attempt in range(max_retries + 1):
                    try:
                        log.append((k, attempt, True, str(fn(value, attempt)), None))
                        break
                    except Exception as e:  # noqa: BLE001
                        log.append((k, attempt, False, None, str(e)))
            yield pd.DataFrame(log, columns=[key, "attempt", "success", "result", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(
        run, f"{key} {kind}, attempt int, success boolean, result string, error string"
    )


def split_steps_function(key: str, kind: str):
    """A table function that splits the ``text`` of a table's rows into numbered sentences, a batch of rows at a time.

    Arrow table functions state their columns beforehand, so one is made per name and type of the key.
    """

    @arrow_udtf(returnType=f"`{key}` {kind}, idx int, step string")
    class SplitSteps:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            texts = pc.fill_null(rows.column("text").cast(pa.large_string()), "")
            parts = pc.split_pattern_regex(texts, "[.;][ \t\n\v\f\r]+")
            row = pc.list_parent_indices(parts)
            steps = pc.utf8_trim(pc.list_flatten(parts), " \t\n\v\f\r")
            starts = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
            idx = np.arange(len(steps)) - starts[np.asarray(row)]
            found = pa.table({
                key: rows.column(key).take(row), "idx": pa.array(idx, pa.int32()), "step": steps.cast(pa.string())
            })
            yield found.filter(pc.not_equal(found["step"], ""))

    return SplitSteps


def steps_udtf(descriptions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The numbered steps of each description, by the table function ``split_steps_tf``; without a text there are none.

    The table is its argument, so that whole Arrow batches reach it, and tasks stay as they are.
    """
    spark = descriptions.sparkSession
    kind = descriptions.schema[key].dataType.simpleString()
    spark.udtf.register("split_steps_tf", split_steps_function(key, kind))
    rows = descriptions.select(key, "text")
    return spark.sql("select * from split_steps_tf(table(select * from {rows}))", rows=rows)
