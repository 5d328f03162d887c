"""A corpus pipeline of the text operators: each stage reads what the one before it kept.

``run`` applies the stages to ``documents``; every stage's result is written as
Parquet to the shared folder and read again. All stages but the last return the
columns of ``documents``. The first two stages look at texts only, so their
models and links do not depend on other columns. SQL cannot express the
models, fingerprints, rounding and merges of the stages, hence no
``ORACLE_SQL``. ``tests/llm`` check columns, counts of groups, round trips,
empty inputs and clashing column names; which rows ``run`` gives is not held
against another version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelytics.llm import bpe, mixing, pii, simhash, toxicity
from pipelytics.llm.common import fresh
from pipelytics.llm.queries import RANKS, toxicity_model
from pipelytics.session import materialise

ORACLE_SQL = None
#: Copies of a row that one task writes at a time.
RUN = 10_000


def _own(docs: DataFrame) -> list:
    """The columns of ``docs`` as they are, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.5. Null and empty texts have no toxic words and stay."""
    model = toxicity_model(spark, docs, sf_dir)
    points, toxic = fresh(docs.columns, "_score", "_toxic")
    scored = toxicity.score(docs, model, out=points, predicted=toxic)
    return scored.where((F.col(toxic) == 0) | (F.coalesce(F.length("text"), F.lit(0)) == 0)).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least ``doc_id``.

    Rows that share the least ``doc_id`` are told apart by a hash of the row;
    of equal rows one stays. A group without any ``doc_id`` keeps the row with the least hash.
    """
    row, least, held, n = fresh(docs.columns, "_row", "_id", "_hash", "_n")
    named = docs.withColumn(row, F.xxhash64(*_own(docs)))
    keys = F.struct(F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    groups = simhash.near_duplicates(named.select(keys.alias("_key"), F.col("text").alias("_text")), "_key", "_text")
    kept = materialise(
        groups.where(F.col("_key") == F.col("component_id")).groupBy("_key").agg(F.count(F.lit(1)).alias(n)), "kept"
    ).select(F.col("_key.doc_id").alias(least), F.col("_key.row").alias(held), n)
    # One row per kept document: it grows with the input, so it is never broadcast.
    joined = named.join(kept.hint("merge"), (F.col(row) == F.col(held)) & F.col("doc_id").eqNullSafe(F.col(least)))
    once = joined.where(F.col(n) == 1).select(*_own(docs))
    return once.unionByName(joined.where(F.col(n) > 1).select(*_own(docs)).dropDuplicates())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; ``n_chars`` follows the new text."""
    field = pii.train(pii.training_texts(docs))
    masked = pii.mask(docs, field)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it does not take go."""
    row, key, copies, rows, copy = fresh(docs.columns, "_row", "_key", "_copies", "_rows", "_copy")
    named = docs.withColumn(row, F.xxhash64(*_own(docs)))
    sized = materialise(
        named.select(F.col(row).alias("_key"), "source", mixing.word_count(F.col("text")).alias("size")), "sizes"
    )
    mixed = mixing.mix(sized, key="_key")
    # Equal rows are interchangeable: their copies add up, and are dealt out evenly.
    per_row = materialise(
        mixed.groupBy(F.col("_key").alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)), "copies"
    )
    joined = named.join(per_row.where(F.col(copies) > 0).hint("merge"), F.col(row) == F.col(key))
    single = joined.where(F.col(rows) == 1).select(
        *_own(docs), F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(copy)
    )
    # The copies of a row that repeats are unbounded: runs of them are dealt over the tasks before they are written out.
    merged = joined.where(F.col(rows) > 1).select(*_own(docs), copies).dropDuplicates()
    runs = merged.select(
        *_own(docs), F.col(copies), F.explode(F.sequence(F.lit(0), (F.col(copies) - 1), F.lit(RUN))).alias(copy)
    )
    length = F.least(F.lit(RUN), F.col(copies) - F.col(copy)).cast("int")
    dealt = runs.repartition(*_own(docs), F.col(copy))
    several = dealt.select(*_own(docs), F.explode(F.array_repeat(F.lit(0), length)).alias(key))
    return single.select(*_own(docs)).unionByName(several.select(*_own(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as packed little-endian unsigned 32-bit numbers, checked by decoding them."""
    coded = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    text = F.coalesce(F.col("text"), F.lit(""))
    return coded.select(
        "doc_id", "source", "n_tokens", "ids", (F.col("decoded") == text.cast("binary")).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
