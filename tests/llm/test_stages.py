"""Stages and models on odd input: clashing names, repeated keys, very long numbers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pipelytics.llm import pii, toxicity
from pipelytics.llm.common import fresh

FOLDER = "/root/testdata/sf0.001"
CLASHING = ["_score", "_toxic", "_row", "_n", "_id", "_hash", "_key", "_copies", "_rows", "_copy", "masked", "_masked", "SIZE"]


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "personal_data", "mixing"])
def test_clashing_names_keep_their_values(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(f"kept {i}"))
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
    assert got.columns == docs.columns
    rows = got.select(*[F.col(f"`{c}`") for c in CLASHING]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"kept {i}" for i in range(len(CLASHING)))]


def test_mixing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "RUN", 7)
    docs = spark.createDataFrame(
        [(1, "same words here", "en", "a", 15)] * 100 + [(2, "other words there", "en", "b", 17)] * 3,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, FOLDER).groupBy("doc_id").count().collect()
    # 103 documents of 3 words weigh 463.5 words; source b may have twice its 9 words, the rest of 445 goes to a.
    assert {r.doc_id: r["count"] for r in got} == {1: pytest.approx(148, abs=2), 2: 6}


def test_sample_of_repeated_keys_and_bytes(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(300)] + [(k, "x" * 100) for k in range(2, 50)], "doc_id long, text string")
    labels = spark.range(1, 50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert toxicity.training_rows(docs, labels).count() == 49
    assert toxicity.training_rows(docs, labels, most_bytes=1000).count() == 10
    assert toxicity.training_rows(docs, labels, most_chars=50).select("_k").distinct().count() == 1


def test_fit_in_a_task_is_the_same_fit(spark):
    rows = [(i, "idiot you" if i % 2 else "good day", i % 2) for i in range(20)]
    sample = spark.createDataFrame(rows, "_k long, _t string, _y int").repartition(3)
    there = toxicity.train_in_task(sample, epochs=20)
    here = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], epochs=20)
    assert (there.weights == here.weights).all() and there.bias == here.bias
    none = toxicity.train_in_task(sample.limit(0))
    assert none.bias == toxicity.train([], []).bias and not none.weights.any()


def test_long_runs_of_digits():
    for zeros in (5_000, 1_000_000):
        text = "0" * zeros + ".1.2.3"
        assert pii.base_spans(text) == [("ip", 0, len(text))]
        assert pii.base_spans("9" * zeros + ".1.2.3") == []


def test_fresh_names():
    assert fresh(["a", "_B"], "x", "b", "_b", "x") == ["x", "b", "__b", "_x"]
