"""Features, splits, metrics, models and numeric summaries, against numpy or by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelytics.operators import features as f
from pipelytics.operators import learning as l
from pipelytics.operators import metrics as m
from pipelytics.operators import numeric as n


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} double")


def test_bins_at_the_edges(spark):
    df = column(spark, [0.0, 2.0, 2.0001, 5.0, 10.0, None])
    got = [r.band for r in f.equal_width_bins(df, "x").orderBy("id").collect()]
    assert got == ["Poor", "Poor", "Fair", "Good", "Excellent", None]


def test_bins_of_a_constant(spark):
    assert {r.band for r in f.equal_width_bins(column(spark, [7.0, 7.0]), "x").collect()} == {"Good"}


def test_scaling(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    df = column(spark, values).withColumn("c", F.lit(3.0))
    got = f.standard_scale(df, ["x", "c"]).orderBy("id").collect()
    x = np.array(values)
    assert [r.x for r in got] == pytest.approx(list((x - x.mean()) / x.std()))
    assert {r.c for r in got} == {0.0}


def test_high_values_are_strictly_above(spark):
    df = column(spark, [1.0, 2.0, 3.0, 4.0, 5.0, None])
    got = [r.high_value for r in f.high_value_flag(df, "x", 0.75).orderBy("id").collect()]
    assert got == [0, 0, 0, 0, 1, 0]


def test_ratios_guard_zero(spark):
    df = spark.createDataFrame(
        [(10.0, 0.0, 5.0, 1.0, -1.0)],
        "income double, age double, credit_score double, account_balance double, transaction_count double",
    )
    got = f.ratio_features(df).first()
    assert got.income_age_ratio is None and got.balance_transaction_ratio is None
    assert got.credit_income_ratio == 500.0


def test_split_keeps_class_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(1).alias("y"))
    split = f.stratified_split(df, "y", "id", 0.2, 1, segments=5)
    sizes = {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert sizes == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = f.stratified_split(df.repartition(7), "y", "id", 0.2, 1, segments=2)
    assert split.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).isEmpty()


def test_drift_is_zero_for_same_data_and_grows(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    b = a.select((F.col("x") * 0.5).alias("x"))
    assert f.feature_drift(a, a, ["x"]).first().psi == 0
    assert f.feature_drift(a, b, ["x"]).first().psi > 1
    assert f.feature_drift(a, a.limit(0), ["x"]).first().psi > 1


def test_report_by_hand(spark):
    df = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("b", "d")], "label string, prediction string"
    )
    got = {r["class"]: r for r in m.classification_report(df).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (1.0, 0.5, 2)
    assert got["b"].precision == pytest.approx(1 / 3) and got["b"].recall == 0.5
    assert (got["c"].precision, got["c"].recall, got["c"].f1) == (0.0, 0.0, 0.0)
    assert (got["d"].precision, got["d"].support) == (0.0, 0)
    assert {r.accuracy for r in got.values()} == {0.4}


def test_auc_with_ties(spark):
    data = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)]
    df = spark.createDataFrame(data, "score double, label int")
    pairs = [(p > q) + 0.5 * (p == q) for p, y in data if y for q, z in data if not z]
    assert m.roc_auc(df, 3).first().auc == pytest.approx(np.mean(pairs), abs=1e-9)
    assert m.roc_auc(df.where("label = 1"), 3).first().auc is None


def test_best_model_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("y", 0, 0.9), ("z", 2, 0.1)], "model string, ordinal int, f1 double")
    assert m.select_best_model(df).first().best_model == "y"


def test_variants_by_hand(spark):
    data = [("A", i < 10) for i in range(100)] + [("B", i < 20) for i in range(100)]
    got = {r.variant: r for r in m.ab_test(spark.createDataFrame(data, "variant string, converted boolean")).collect()}
    assert got["B"].lift == 1.0 and got["A"].z == 0.0
    assert got["B"].z == pytest.approx(0.1 / np.sqrt(0.15 * 0.85 * 0.02))


def test_percentile_like_numpy(spark):
    x = np.random.default_rng(0).integers(0, 50, 501).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    got = m.latency_percentiles(df, "k", "v", 0.95, 4).first()
    assert got.p95_ms == pytest.approx(np.percentile(x, 95)) and got.mean_ms == pytest.approx(x.mean())


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(1).normal(size=(120, 6)).astype("float32")
    df = spark.createDataFrame(
        [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)],
        "vec_id long, embedding array<float>, label int",
    ).repartition(5)
    return x.astype("float64"), df


def test_singular_values(vectors):
    x, df = vectors
    got = [r.singular_value for r in n.svd_summary(df, 4).orderBy("position").collect()]
    assert got == pytest.approx(list(np.linalg.svd(x, compute_uv=False)[:4]), rel=1e-7)


def test_products(vectors, monkeypatch):
    x, df = vectors
    want = x[::2].T @ x[::2]
    for r in n.gram_matrix(df, "label").where("label = 0").collect():
        assert r.product == pytest.approx(want[r.i - 1, r.j - 1], abs=1e-6)


def test_small_singular_values_keep_their_digits(spark):
    """Products of columns would lose a value of 1e-9 of the largest; a stack of two factors at a time must not."""
    rng = np.random.default_rng(5)
    left, _ = np.linalg.qr(rng.normal(size=(300, 5)))
    right, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    want = [1.0, 1e-3, 1e-6, 1e-8, 1e-9]
    x = left @ np.diag(want) @ right.T
    df = spark.createDataFrame([([float(v) for v in row],) for row in x] + [(None,)], "embedding array<double>").repartition(13)
    for stack in (64_000_000, 1):
        got = [r.singular_value for r in n.svd_summary(df, 5, stack_bytes=stack).orderBy("position").collect()]
        assert got == pytest.approx(want, rel=1e-6)


def test_singular_values_of_few_or_no_rows(spark):
    one = spark.createDataFrame([([3.0, 4.0],)], "embedding array<double>")
    assert [r.singular_value for r in n.svd_summary(one, 5).collect()] == pytest.approx([5.0])
    assert n.svd_summary(one.limit(0), 5).count() == 0


def test_products_of_large_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(i, [3e4, 1.0], 0) for i in range(12)], schema)
    got = {(r.i, r.j): r.product for r in n.gram_matrix(df.coalesce(1), "label").collect()}
    assert got == {(1, 1): 12 * 9e8, (1, 2): 12 * 3e4, (2, 2): 12.0}
    rows = [(i, [1e6 + i, 1e9, 0.1 * i, 1e12], i % 2) for i in range(40)] + [(99, None, 0)]
    for held in (256_000_000, 1):
        for r in n.gram_matrix(spark.createDataFrame(rows, schema).repartition(3), "label", held_bytes=held).collect():
            own = [v for _, v, label in rows if label == r.label and v]
            assert r.product == pytest.approx(math.fsum(v[r.i - 1] * v[r.j - 1] for v in own), rel=1e-14)
    endless = spark.createDataFrame([(1, [float("inf")], 0)], schema)
    with pytest.raises(Exception, match="must be finite"):
        n.gram_matrix(endless, "label").collect()


def test_products_of_wide_vectors(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(60, 300)), 6)
    df = spark.createDataFrame([(i, [float(v) for v in row], None) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = n.gram_matrix(df, "label", tile_bytes=200_000).toPandas()
    assert len(got) == 300 * 301 // 2 and got["label"].isna().all()
    want = x.T @ x
    assert np.abs(got["product"].to_numpy() - want[got["i"] - 1, got["j"] - 1]).max() < 1e-7


def test_spectrum(spark):
    data = [("a", t, float(t % 4)) for t in range(100, 132) if t != 110]
    got = n.series_spectrum(spark.createDataFrame(data, "k string, t long, v double"), "k", "t", "v").first()
    full = np.array([0.0 if t == 110 else t % 4 for t in range(100, 132)])
    size = np.abs(np.fft.fft(full))
    assert (got.points, got.max) == (32, pytest.approx(size.max()))
    assert (got.mean, got.std) == (pytest.approx(size.mean()), pytest.approx(size.std()))


def test_long_series_in_blocks(spark):
    """Lengths that are prime, powers of two and odd; gaps; a null key; short keys beside long ones."""
    rng = np.random.default_rng(8)
    data = []
    for name, low, length in (("prime", -7, 97), ("power", 100, 128), (None, 5, 75), ("short", 3, 9), ("long", 0, 5000)):
        held = np.unique(np.concatenate([[0, length - 1], rng.integers(0, length, length // 2)]))
        data += [(name, int(low + t), float(rng.normal() * 10)) for t in held]
    df = spark.createDataFrame(data, "k string, t long, v double").repartition(3)
    whole = {r.k: r for r in n.series_spectrum(df, "k", "t", "v").collect()}
    blocks = {r.k: r for r in n.series_spectrum(df, "k", "t", "v", longest=64).collect()}
    assert whole.keys() == blocks.keys() and len(whole) == 5
    for k, r in whole.items():
        for c in ("points", "mean", "std", "max", "min"):
            assert blocks[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), (k, c)


def test_planted_outliers_score_highest(spark):
    rng = np.random.default_rng(3)
    # Fewer rows than a sample holds, so every tree sees the outliers.
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    data += [(9000, 9.0, 9.0), (9001, -8.0, 7.0)]
    df = spark.createDataFrame(data, "id int, a double, b double").repartition(4)
    got = l.isolation_forest(df, "id", ["a", "b"], trees=30)
    assert got.count() == len(data)
    top = [r.id for r in got.orderBy(F.desc("anomaly")).limit(2).collect()]
    assert sorted(top) == [9000, 9001]
    assert 0 < got.agg(F.min("anomaly")).first()[0] < got.agg(F.max("anomaly")).first()[0] < 1


def test_forest_samples_large_tables(spark):
    df = spark.range(20000).select("id", F.rand(3).alias("a"), (F.col("id") % 17).cast("double").alias("b"))
    df = df.unionAll(spark.createDataFrame([(-1, 50.0, 90.0)], "id long, a double, b double"))
    got = l.isolation_forest(df, "id", ["a", "b"], trees=20, sample=64)
    assert got.count() == 20001
    far = got.where("id = -1").first().anomaly
    assert far >= got.agg(F.percentile("anomaly", 0.99)).first()[0]


def test_sentiment_by_hand(spark):
    docs = spark.createDataFrame([(1, "Good, good bad!"), (2, "none"), (3, "")], "doc_id int, text string")
    lex = spark.createDataFrame([("good", 1), ("bad", -1)], "word string, polarity int")
    got = {r.doc_id: (r.hits, r.sentiment) for r in f.sentiment_score(docs, lex).collect()}
    assert got == {1: (3, pytest.approx(1 / 3)), 2: (0, None), 3: (0, None)}
