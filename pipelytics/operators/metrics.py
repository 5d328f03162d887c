"""Quality of predictions, over time and between variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import fine_mean, share
from .ordered import exact_quantiles, running_sums


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, and the overall accuracy.

    Predictions shrink to counts per pair of classes before anything else. An
    empty denominator gives 0.
    """
    pairs = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    n, none = F.col("n"), F.lit(0).cast("bigint")
    right = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)

    def side(name, support, chosen, hit):
        return F.struct(
            F.col(name).alias("class"), support.alias("support"), chosen.alias("chosen"), hit.alias("hit")
        )

    sides = F.array(side("label", n, none, right), side("prediction", none, n, none))
    per_class = pairs.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = F.col("precision"), F.col("recall")
    accuracy = pairs.agg(ratio(F.sum(right), F.sum("n"))).scalar()
    return (
        per_class.withColumn("precision", ratio(F.col("hit"), F.col("chosen")))
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
        .select("class", "precision", "recall", "f1", "support", accuracy.alias("accuracy"))
    )


def roc_auc(predictions: DataFrame, segments: int | None = None) -> DataFrame:
    """Area under the ROC curve; tied scores count half.

    Works on counts per distinct score. Products are decimals, as the number of
    pairs exceeds a long on large tables.
    """
    big = "decimal(38,0)"
    per_score = predictions.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    run = running_sums(per_score, [], ["score"], {"neg_upto": F.col("neg")}, segments)
    doubled = (2 * F.col("neg_upto") - F.col("neg")).cast("decimal(19,0)")
    return run.agg(
        F.sum((F.col("pos").cast("decimal(18,0)") * doubled).cast(big)).alias("u2"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    ).select(
        "positives", "negatives",
        F.round(
            F.try_divide(
                F.col("u2").cast("double"),
                F.lit(2.0) * F.col("positives") * F.col("negatives").cast("double"),
            ),
            9,
        ).alias("auc"),
    )


def select_best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest F1; the one listed first wins a tie."""
    order = F.struct("f1", -F.col("ordinal"))
    return metrics.agg(
        F.max_by("model", order).alias("best_model"), F.max("f1").alias("best_f1"),
        F.count(F.lit(1)).alias("models"),
    )


def binary_metrics(predictions: DataFrame, by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 per model."""
    hit, guess, real = F.col("label") == F.col("prediction"), F.col("prediction") == 1, F.col("label") == 1
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        predictions.groupBy(by)
        .agg(
            share(hit).alias("accuracy"),
            F.count_if(guess & real).cast("double").alias("_tp"),
            F.count_if(guess).cast("double").alias("_chosen"),
            F.count_if(real).cast("double").alias("_real"),
        )
        .withColumn("precision", ratio(F.col("_tp"), F.col("_chosen")))
        .withColumn("recall", ratio(F.col("_tp"), F.col("_real")))
        .withColumn("f1", ratio(2 * F.col("_tp"), F.col("_chosen") + F.col("_real")))
        .drop("_tp", "_chosen", "_real")
    )


def deploy_gate(metrics: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Models whose accuracy exceeds the threshold."""
    return metrics.where(F.col("accuracy") > threshold)


def accuracy_monitor(
    predictions: DataFrame, window: str = "1 day", alert: float = 0.85, retrain: float = 0.80
) -> DataFrame:
    """Accuracy per time window, with the action it calls for."""
    accuracy = F.col("accuracy")
    return (
        predictions.groupBy(F.window("ts", window).alias("_w"))
        .agg(F.count(F.lit(1)).alias("rows"), share(F.col("label") == F.col("prediction")).alias("accuracy"))
        .select(
            F.col("_w.start").alias("window_start"), "rows", "accuracy",
            F.when(accuracy < retrain, "retrain").when(accuracy < alert, "alert").otherwise("ok").alias("action"),
        )
    )


def ab_test(events: DataFrame, control: str = "A") -> DataFrame:
    """Conversion rate per variant, lift and two-proportion z score against the control."""
    per = events.groupBy("variant").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if("converted").cast("double").alias("x")
    )
    base = per.where(F.col("variant") == control).agg(F.struct(F.max("n").alias("n"), F.max("x").alias("x"))).scalar()
    rate, base_rate = F.col("x") / F.col("n"), base["x"] / base["n"]
    pooled = (F.col("x") + base["x"]) / (F.col("n") + base["n"])
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / base["n"]))
    return per.select(
        "variant", F.col("n").cast("bigint").alias("n"), rate.alias("rate"),
        F.round(F.try_divide(rate - base_rate, base_rate), 9).alias("lift"),
        F.round(F.try_divide(rate - base_rate, spread), 9).alias("z"),
    )


def metric_correlation(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.corr(x, y), 6).alias("correlation"))


def latency_percentiles(
    df: DataFrame, by: str, column: str, p: float = 0.95, segments: int | None = None
) -> DataFrame:
    """Mean and an interpolated percentile per group."""
    means = df.groupBy(F.col(by).alias("_by")).agg(fine_mean(column).alias("mean_ms"))
    high = exact_quantiles(df, [by], column, {f"p{int(p * 100)}_ms": p}, segments)
    return means.join(high, F.col("_by").eqNullSafe(F.col(by))).drop("_by")
