"""Streams give the same answer whatever the arrival, and repeats do no harm."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pipelytics.session import scratch_path
from pipelytics.sources.writers import read_latest
from pipelytics.streaming import jobs as j
from pipelytics.streaming.runner import open_stream, run_append, run_complete, run_updates

T0 = datetime(2024, 1, 1)
CALLS = "attempt_id long, task string, start_ts timestamp_ntz, state string"


def breaker(calls, failures, cooldown_s):
    """The plain state machine, one task at a time."""
    out = []
    for task in {c[1] for c in calls}:
        is_open, straight, since = False, 0, None
        for _, _, ts, state in sorted((c for c in calls if c[1] == task), key=lambda c: (c[2], c[0])):
            ok = state == "success"
            if is_open and ts < since + timedelta(seconds=cooldown_s):
                continue
            if is_open:
                out.append((task, ts, "half_open"))
                is_open, straight, since = not ok, 0, ts
                out.append((task, ts, "closed" if ok else "open"))
                continue
            straight = 0 if ok else straight + 1
            if straight == failures:
                is_open, straight, since = True, 0, ts
                out.append((task, ts, "open"))
    return sorted(out)


@pytest.fixture(scope="module")
def calls():
    import random

    rng = random.Random(2)
    return [
        (i, f"t{rng.randint(0, 2)}", T0 + timedelta(minutes=7 * i), rng.choice(["success", "failed", "failed"]))
        for i in range(120)
    ]


@pytest.mark.parametrize("cuts,chunk", [(1, 10_000), (4, 10_000), (3, 7), (20, 2)])
def test_breaker_does_not_depend_on_batches_or_chunks(spark, calls, cuts, chunk):
    inbox = scratch_path(spark, "calls")
    state, out = scratch_path(spark, "calls-state"), scratch_path(spark, "calls-out")
    per = len(calls) // cuts
    steps = range(cuts) if cuts < 10 else [range(cuts)]
    for step in steps:
        for n in [step] if cuts < 10 else step:
            spark.createDataFrame(calls[n * per:(n + 1) * per][::-1], CALLS).write.mode("append").parquet(f"{inbox}/n={n}")
        stream = open_stream(spark, f"{inbox}/n=*", spark.createDataFrame([], CALLS).schema)
        got = j.stream_circuit_breaker(stream, "task", 3, 3600, state, out, chunk)
    assert sorted(tuple(r) for r in got.collect()) == breaker(calls, 3, 3600)


def test_breaker_without_calls_and_with_odd_ones(spark):
    inbox = scratch_path(spark, "calls")
    schema = spark.createDataFrame([], CALLS).schema
    spark.createDataFrame([], CALLS).write.parquet(f"{inbox}/n=0")
    assert j.stream_circuit_breaker(open_stream(spark, f"{inbox}/n=*", schema), "task").count() == 0
    rows = [(1, None, T0, None), (2, None, T0, None), (3, None, None, "success"), (3, "a", T0, "success")]
    spark.createDataFrame(rows, CALLS).write.mode("overwrite").parquet(f"{inbox}/n=0")
    got = j.stream_circuit_breaker(open_stream(spark, f"{inbox}/n=*", schema), "task", 2)
    assert [tuple(r) for r in got.collect()] == [(None, T0, "open")]


def test_chunks_compose_to_the_state_machine():
    import random
    from types import SimpleNamespace

    from pipelytics.operators.breaker import Chunk, leave

    rng = random.Random(8)
    for _ in range(1500):
        n, failures, cooldown = rng.randint(1, 40), rng.randint(1, 4), rng.choice([0, 1, 3, 9, 50])
        share, minute = rng.random(), 0
        calls = []
        for i in range(n):
            minute += rng.choice([0, 1, 1, 2, 5])
            calls.append((i, "t", T0 + timedelta(seconds=minute), "success" if rng.random() < share else "failed"))
        us = [round((c[2] - T0).total_seconds()) * 1_000_000 for c in calls]
        state, got, low = (False, 0, 0), [], 0
        while low < n:
            high = low + rng.randint(1, 9)
            chunk = Chunk(us[low:high], [c[3] == "success" for c in calls[low:high]], failures, cooldown * 1_000_000)
            got += [("t", T0 + timedelta(microseconds=u), to) for u, to in chunk.changes(state)]
            state = leave(SimpleNamespace(**chunk.summary()), state, cooldown * 1_000_000)
            low = high
        assert sorted(got) == breaker(calls, failures, cooldown)


def test_late_rows_by_hand(spark):
    def chunk(*minutes):
        return spark.createDataFrame([(i, T0 + timedelta(minutes=m)) for i, m in enumerate(minutes)], "event_id int, ts timestamp_ntz")

    got = j.stream_late_data([chunk(5, 65, 300), chunk(310, 290, 20, 170, 185), chunk(299, 10)], "1 hour", "2 hours")
    # After the first chunk the watermark is 180 minutes: windows up to 180 are closed.
    assert [tuple(r) for r in got.orderBy("chunk").collect()] == [(0, 3, 0, 0), (1, 1, 2, 2), (2, 0, 1, 1)]


def test_repeated_batch_rewrites_its_version(spark):
    from pipelytics.sources.writers import upsert_customer_metrics

    path = scratch_path(spark, "versions")
    frame = lambda *r: spark.createDataFrame(list(r), "customer_id int, total double")
    upsert_customer_metrics(path, frame((1, 1.0), (2, 2.0)), ["customer_id"], version=0)
    for _ in range(2):
        upsert_customer_metrics(path, frame((2, 5.0), (3, None)), ["customer_id"], version=1)
    got = sorted(tuple(r) for r in read_latest(spark, path).collect())
    assert got == [(1, 1.0), (2, 5.0), (3, None)]
    assert read_latest(spark, path, before=1).count() == 2


def test_unfinished_version_is_ignored(spark):
    from pipelytics.sources.writers import upsert_customer_metrics

    path = scratch_path(spark, "versions")
    df = spark.createDataFrame([(1, 1.0)], "customer_id int, total double")
    upsert_customer_metrics(path, df, ["customer_id"])
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=7")
    assert read_latest(spark, path).count() == 1
    assert upsert_customer_metrics(path, df, ["customer_id"]).count() == 1
    assert read_latest(spark, path, before=8).select(F.input_file_name().alias("f")).first().f.count("version=1")


def test_dedupe_across_batches(spark):
    inbox, state, out = (scratch_path(spark, f"dup-{x}") for x in ("in", "state", "out"))
    schema = "event_id int, ts timestamp_ntz"
    for n, ids in enumerate([[1, 2, 2], [2, 3]]):
        rows = [(i, T0 + timedelta(minutes=i)) for i in ids]
        spark.createDataFrame(rows, schema).write.parquet(f"{inbox}/n={n}")
        stream = open_stream(spark, f"{inbox}/n=*", spark.createDataFrame([], schema).schema)
        got = run_append(j.stream_dedupe(stream, ["event_id"], "1 hour"), "dup", state, out)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3]


EVENTS = "event_id int, ts timestamp_ntz, event_type string, value double"


@pytest.mark.parametrize("sliding", [False, True])
def test_windows_over_several_batches(spark, sliding):
    """Versions add up over batches, open windows are there at the end, closed ones take no late rows."""
    inbox, state, out = (scratch_path(spark, f"win-{x}") for x in ("in", "state", "out"))
    empty = spark.createDataFrame([], EVENTS)
    at = lambda m: T0 + timedelta(minutes=m)
    chunks = [[(1, at(5), "a", 1.0), (2, at(50), "a", 2.0)], [(3, at(55), "a", 4.0), (4, at(400), "b", 8.0)], [(5, at(10), "a", 16.0), (6, at(410), "b", 32.0)]]
    for n, rows in enumerate(chunks):
        spark.createDataFrame(rows, EVENTS).write.parquet(f"{inbox}/n={n}")
        stream = open_stream(spark, f"{inbox}/n=*", empty.schema)
        windows = j.stream_sliding(stream, "2 hours", "1 hour", "2 hours") if sliding else j.stream_tumbling(stream, "1 hour", "2 hours")
        got = run_updates(windows, j.WINDOW_KEYS, "win", state, out)
    found = sorted((r.window_start, r.event_type, r.events, r.total, r.largest) for r in got.collect())
    # The row at minute 10 comes after the watermark has passed 280 minutes.
    first, last = [(at(0), "a", 3, 7.0, 4.0)], [(at(360), "b", 2, 40.0, 32.0)]
    if sliding:
        first, last = [(at(-60), "a", 3, 7.0, 4.0), *first], [(at(300), "b", 2, 40.0, 32.0), *last]
    assert found == first + last


def test_repeated_batch_of_windows(spark):
    inbox, out = scratch_path(spark, "again-in"), scratch_path(spark, "again-out")
    spark.createDataFrame([(1, T0, "a", 1.0), (2, T0, "a", 2.0)], EVENTS).write.parquet(f"{inbox}/n=0")
    for _ in range(2):  # a new checkpoint each time, so the same batch is written again
        stream = open_stream(spark, f"{inbox}/n=*", spark.createDataFrame([], EVENTS).schema)
        got = run_updates(j.stream_tumbling(stream, "1 hour", "2 hours"), j.WINDOW_KEYS, "again", None, out)
    assert [(r.events, r.total) for r in got.collect()] == [(2, 3.0)]


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    events = open_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], EVENTS).schema)
    assert run_updates(j.stream_tumbling(events, "1 hour", "2 hours"), j.WINDOW_KEYS, "none").count() == 0
    requests = open_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], "model string, latency_ms double, success boolean").schema)
    empty = run_complete(j.stream_model_metrics(requests), "none")
    assert empty.count() == 0 and empty.columns == ["model", "requests", "avg_latency_ms", "success_rate"]
    orders = open_stream(spark, str(tmp_path / "none"), spark.createDataFrame([], "customer_id int, x double").schema)
    sums = lambda df: df.groupBy("customer_id").agg(F.sum("x").alias("lifetime_value"))
    got = j.stream_upsert_metrics(orders, scratch_path(spark, "none"), sums, ["customer_id"])
    assert got.count() == 0 and got.columns == ["customer_id", "lifetime_value"]


def test_repeated_batch_without_predecessor(spark):
    from pipelytics.sources.writers import drop_versions, upsert_customer_metrics

    path = scratch_path(spark, "kept")
    frame = lambda *r: spark.createDataFrame(list(r), "customer_id int, total double")
    for version in range(3):
        upsert_customer_metrics(path, frame((version, 1.0)), ["customer_id"], version=version)
    assert drop_versions(spark, path, keep=1) == [0, 1]
    upsert_customer_metrics(path, frame((2, 1.0)), ["customer_id"], version=2)
    assert sorted(r.customer_id for r in read_latest(spark, path).collect()) == [0, 1, 2]
