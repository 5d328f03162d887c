"""Reading, writing, quality checks, history and inference on small tables."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pipelytics import session
from pipelytics.operators import commerce as c
from pipelytics.operators import inference as i
from pipelytics.operators import quality as q
from pipelytics.operators import requests as m
from pipelytics.operators import runs as h
from pipelytics.session import scratch_path
from pipelytics.sources import readers as r
from pipelytics.sources import writers as w

ORDERS = "order_id long, customer_id long, order_date timestamp_ntz, total_amount double, status string"


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), ORDERS)


def test_lookback_includes_its_first_moment(spark):
    df = orders(spark, (1, 1, datetime(2024, 1, 1), 1.0, "completed"), (2, 1, datetime(2023, 12, 31, 23), 1.0, "completed"))
    assert [x.order_id for x in c.filter_lookback(df, "order_date", datetime(2024, 1, 31), 30).collect()] == [1]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = c.filter_lookback(df, "o_orderdate", datetime(2001, 8, 1), 30).select("o_orderkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed
    assert plan.split("ReadSchema: ")[1].split(">")[0] == "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz"


def test_tied_customers_rank_by_id(spark):
    df = orders(spark, *[(n, n, datetime(2024, 1, 1), 5.0, "completed") for n in (3, 1, 2)])
    cust = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "customer_id long, segment string")
    assert [x.customer_id for x in c.top_customers(df, cust, 2).orderBy("position").collect()] == [1, 2]


@pytest.mark.parametrize("rows,status", [
    ([(1, 1, None, 1.0, "s")], "success"),
    ([(1, 1, None, 0.0, "s")], "warning"),
    ([(1, 1, None, 1.0, "s"), (1, 1, None, 1.0, "s")], "warning"),
    ([(1, 9, None, 1.0, "s")], "failed"),
    ([], "success"),
])
def test_validation_status(spark, rows, status):
    cust = spark.createDataFrame([(1,)], "customer_id long")
    assert q.validation_report(orders(spark, *rows), cust).first().status == status


def test_rules_count_null_as_failed(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    got = q.rule_engine(df, [("pos", "x > 0", 0.5), ("any", "true", 0.0)]).collect()
    assert [(g.rule, g.failed_rows, g.passed) for g in got] == [("pos", 2, False), ("any", 0, True)]
    assert [g.passed for g in q.rule_engine(df.limit(0), [("pos", "x > 0", 0.5)]).collect()] == [True]


def test_good_rows_have_no_violations(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert [x.violations for x in q.quarantine(df, [("a", "x > 0"), ("b", "x < 5")]).collect()] == [[], ["a", "b"]]


def test_conversions_name_the_failures(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2"), ("z", "3.5")], "a string, b string")
    got = q.convert_types(df, {"a": "int", "b": "double"}).collect()
    assert [(g.a, g.b, g._rejects) for g in got] == [(1, None, ["b"]), (None, 2.0, []), (None, 3.5, ["a"])]


def test_latest_row_wins_with_full_order(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, 1, "d")], "k int, t int, v string")
    assert rows(q.dedupe_latest(df, ["k"], ["t", "v"])) == [(1, 7, "c"), (2, 1, "d")]


def test_schema_changes(spark, rows):
    df = spark.createDataFrame([(1, "a", 2.0)], "x int, y string, z double")
    got = q.schema_diff(df, [("x", "int"), ("y", "int"), ("w", "date")])
    assert rows(got.select("column_name", "change")) == [("w", "missing"), ("y", "retyped"), ("z", "extra")]


def test_empty_tables(spark):
    none = orders(spark, (1, 1, None, 1.0, "s")).where("false")
    assert c.daily_revenue(none, datetime(2024, 1, 1), 30).count() == 0
    assert w.daily_summary(c.daily_revenue(none, datetime(2024, 1, 1), 30)).count() == 0
    assert [n.nulls for n in q.null_counts(none).collect()] == [0] * 5
    s = q.summary_stats(none, ["total_amount"]).first()
    assert (s.mean, s.std, s.max) == (None, None, None)


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    s = q.summary_stats(df, ["x"]).first()
    assert (s.mean, s.std) == (None, None)
    assert q.null_counts(df).first().nulls == 2


def test_feeds_of_different_width(spark, rows):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([("2",)], "key string")
    got = r.union_sources([(a, {}, {"id": "bigint"}, "a"), (b, {"key": "id"}, {"id": "bigint"}, "b")])
    assert rows(got) == [(1, "x", "a"), (2, None, "b")]


def test_mark_stays_when_nothing_is_new(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assert tuple(r.next_mark(df, "id", 5).first()) == (5, 0)
    assert tuple(r.next_mark(df, "id", 1).first()) == (2, 1)


def test_manifest_matches_the_files(spark, tmp_path, rows):
    files = {"a 1%.bin": b"abc", "b.bin": b"", "c+ü.bin": b"", "d.bin": bytes(9), "e.txt": b"no"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = [
        (n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if n.endswith("bin")
    ]
    assert rows(r.file_manifest(spark, str(tmp_path), "*.bin")) == sorted(want, key=repr)
    assert rows(r.file_manifest(spark, str(tmp_path), "*.bin", whole=1)) == sorted(want, key=repr)


def test_manifest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    import hashlib

    # A sparse file: it takes no room on the disk.
    size = 2**31 + 5
    with open(tmp_path / "long name é%20.bin", "wb") as out:
        out.truncate(size)
    digest = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(zeros[: size % (1 << 20)])
    got = [tuple(x) for x in r.file_manifest(spark, str(tmp_path)).collect()]
    assert got == [("long name é%20.bin", size, digest.hexdigest())]


def test_formats_are_checked(spark):
    with pytest.raises(ValueError, match="format"):
        r.read_table(spark, "/tmp/x", "xls")
    with pytest.raises(ValueError, match="schema"):
        r.read_table(spark, "/tmp/x", "csv")
    with pytest.raises(RuntimeError, match="avro"):
        r.read_table(spark, "/tmp", "avro", "x int")


def test_other_partitions_survive_a_rewrite(spark, rows):
    path = scratch_path(spark, "parts")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
    w.write_partitioned(df, path, "p")
    w.write_partitioned(df.where("p = 'a'").withColumn("x", F.lit(9)), path, "p", "snappy")
    assert rows(spark.read.schema(df.schema).parquet(path)) == [(2, "b"), (9, "a")]


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Fake())
    assert session.scratch_root(spark)


def test_clearing_removes_only_own_steps(tmp_path):
    class Recorder:
        deleted = []

        def __init__(self, path=None):
            self.path = path

        def getFileSystem(self, conf):
            return self

        def delete(self, path, recursive):
            self.deleted.append((path.path, recursive))

    class Spark:
        class conf:
            get = staticmethod(lambda *a: "hdfs://shared/")

        class sparkContext:
            applicationId = "app-1"

        class _jsc:
            hadoopConfiguration = staticmethod(lambda: None)

        class _jvm:
            class org:
                class apache:
                    class hadoop:
                        class fs:
                            Path = Recorder

    session.clear_scratch(Spark)
    assert Recorder.deleted == [("hdfs://shared/pipelytics/app-1", True)]


def test_run_cost_by_hand(spark):
    df = spark.createDataFrame(
        [("r", 3600.0, "a100", 4), ("r", 7200.0, "odd", 4), ("r", 1800.0, None, 4), ("r", 3600.0, None, None)],
        "run_id string, duration_s double, gpu string, cpu int",
    )
    assert h.run_cost(df).first().cost == pytest.approx(3.5 + 2.0 + 0.2 + 0.1)


def test_waits_by_hand(spark):
    df = spark.createDataFrame([(n, n, "k") for n in range(5)], "attempt_id int, ts long, call_key string")
    got = h.retry_schedule(df, 3.0, 3, segments=2).orderBy("attempt").collect()
    assert [g.delay_s for g in got] == [1.0, 3.0, 9.0, 0.0, 0.0]
    assert [g.total_wait_s for g in got] == [1.0, 4.0, 13.0, 13.0, 13.0]
    assert [g.exhausted for g in got] == [False, False, False, True, True]
    for g in h.retry_schedule(df, 3.0, 3, jitter=True).where("not exhausted").collect():
        assert 0.5 <= g.delay_s / 3.0**g.attempt <= 1.0


def test_running_metrics_follow_the_recurrence(spark):
    import random

    rng = random.Random(1)
    data = [("m", n, n, rng.random() * 100, rng.random() < 0.7) for n in range(50)]
    df = spark.createDataFrame(data, "model string, ts long, request_id long, latency_ms double, success boolean")
    mean = rate = 0.0
    for n, row in enumerate(m.running_model_metrics(df, 4).orderBy("requests").collect(), start=1):
        mean = (mean * (n - 1) + data[n - 1][3]) / n
        rate = (rate * (n - 1) + data[n - 1][4]) / n
        assert (row.avg_latency_ms, row.success_rate) == (pytest.approx(mean), pytest.approx(rate))


def test_speed_ignores_empty_requests(spark):
    data = [("m", 1, 1, 100.0, 10, True), ("m", 2, 2, 0.0, 10, True), ("m", 3, 3, 50.0, 0, False)]
    df = spark.createDataFrame(
        [(*d, "p", 1, 0.1) for d in data],
        "model string, ts long, request_id long, latency_ms double, tokens long, success boolean, "
        "prompt string, max_tokens int, temperature double",
    )
    got = m.llm_model_metrics(df).first()
    assert (got.tokens_per_second, got.cache_hits, got.errors) == (100.0, 2, 1)


def test_a_bad_row_does_not_spoil_its_batch(spark):
    def opened():
        def model(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [t * 2 for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c d")], "id int, t string").coalesce(1)
    got = {x.id: (x.answer, x.success, x.error, x.tokens) for x in i.batch_infer(df, "id", "t", opened, 3).collect()}
    assert got == {1: ("aa", True, None, 1), 2: (None, False, "no", 0), 3: ("c dc d", True, None, 3)}
    assert i.batch_infer(df.limit(0), "id", "t", opened).count() == 0


def test_retries_stop_at_the_limit(spark):
    def fail(value, attempt):
        if attempt < int(value):
            raise RuntimeError("x")
        return attempt

    df = spark.createDataFrame([(1, "0"), (2, "2"), (3, "9")], "id int, v string")
    got = i.retrying_map(df, "id", "v", fail, 2).groupBy("id").agg(F.count("*").alias("n"), F.max("success").alias("ok"))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 1, True), (2, 3, True), (3, 3, False)]
