"""Order of the error kinds, module names, remedies, limits."""

import pytest
from pyspark.sql import functions as F

from pipelytics.operators import monitor as m
from pipelytics.operators import recovery as r

CASES = [
    ("ImportError", "anything", "import_error"),
    ("ModuleNotFoundError", "out of memory", "import_error"),
    ("ValueError", "No Module Named x", "import_error"),
    ("MemoryError", "connection lost", "memory_error"),
    ("X", "Out of memory during timeout", "memory_error"),
    ("X", "connection timeout: permission denied", "connection_error"),
    ("X", "Access denied to resource", "permission_error"),
    ("X", "rate limit exceeded for data", "resource_error"),
    ("ConnectionError", "Failed to connect to database", "data_error"),
    ("X", "wrong format", "data_error"),
    ("X", "boom", "unknown"),
    (None, "boom", "unknown"),
    ("MemoryError", None, "memory_error"),
]


@pytest.fixture(scope="module")
def errors(spark):
    data = [(i, *c[:2], "2Gi", 3) for i, c in enumerate(CASES)]
    return spark.createDataFrame(
        data, "error_id int, error_class string, message string, memory string, cpu int"
    )


def test_first_kind_wins(errors):
    got = [x.error_type for x in r.classify_errors(errors).orderBy("error_id").collect()]
    assert got == [c[2] for c in CASES]


@pytest.mark.parametrize("message,module", [
    ("No module named 'a.b.c'", "a"),
    ("No module named a.b c", "a"),
    ("ImportError: cannot import name 'x' from y", "x"),
    ("cannot import name 'x'", None),
    ("No module named '.rel'", None),
    ("", None),
])
def test_module_names(spark, message, module):
    df = spark.createDataFrame([(message,)], "message string")
    assert r.missing_modules(df).first().module == module


@pytest.mark.parametrize("memory,cpu,want", [
    ("2Gi", 1, ("4Gi", 2)), ("4G", 4, ("8G", 8)), ("512Mi", 6, ("8Gi", 8)), ("8", 8, ("8Gi", 8)),
    (None, None, ("4Gi", 2)),
])
def test_more_resources(spark, memory, cpu, want):
    df = spark.createDataFrame([(memory, cpu)], "memory string, cpu int")
    got = r.scale_resources(df).first()
    assert (got.new_memory, got.new_cpu) == want


def test_remedies(spark):
    data = [
        ("X", "No module named 'pandas.core'"), ("ImportError", "bad path"), ("MemoryError", ""),
        ("X", "timeout"), ("X", "permission denied"), ("X", "resource"), ("X", "data"), ("X", "boom"),
    ]
    df = spark.createDataFrame(
        [(i, *d, "4G", 5) for i, d in enumerate(data)],
        "error_id int, error_class string, message string, memory string, cpu int",
    )
    got = r.fix_plan(df).orderBy("error_id").collect()
    assert [x.confidence for x in got] == [0.9, 0.5, 0.8, 0.7, 0.6, 0.7, 0.1, 0.1]
    assert [x.auto_fixable for x in got] == [True, False, True, True, False, True, False, False]
    assert got[0].fix_command == "pip install pandas"
    assert got[2].adjustment == {"memory": "8G"} and got[5].adjustment == {"cpu": "8"}
    assert got[6].suggested_fix == got[7].suggested_fix == "Manual intervention required"


def test_failed_attempts_count(spark):
    df = spark.createDataFrame([("a", True), ("a", False)], "error_type string, success boolean")
    assert r.fix_success_rate(df).first().success_rate == 0.5


def test_value_at_the_limit_is_no_alert(spark):
    df = spark.createDataFrame(
        [(1, "d", "t", 10.0, 5), (2, "d", "t", 10.5, None)],
        "attempt_id int, dag_id string, task_id string, duration_s double, cpu int",
    )
    got = m.threshold_alerts(df, {"duration_s": 10, "cpu": 5}).collect()
    assert [(x.attempt_id, x.metric, x.value) for x in got] == [(2, "duration_s", 10.5)]


def test_observed_matches_a_second_pass(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 4 == 0, F.col("id")))
    checks = {"n": F.count(F.lit(1)), "nulls": F.count_if(F.col("x").isNull()), "s": F.sum("x")}
    assert m.observed_metrics(df, checks).first() == df.agg(*[c.alias(k) for k, c in checks.items()]).first()


def test_planted_jump_is_found(spark):
    data = [("s", i, i, 10.0 + (i % 3)) for i in range(40)] + [("s", 40, 40, 99.0)]
    df = spark.createDataFrame(data, "key string, ts long, event_id long, value double")
    got = m.rolling_anomalies(df, "key", ["ts", "event_id"], "value", 20, 3.0, block=20, segments=3)
    assert [x.event_id for x in got.collect()] == [40]
