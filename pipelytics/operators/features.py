"""Feature engineering, splits and drift.

Column statistics enter as scalar subqueries: one aggregate, whose single row
is handed to every task, never a window over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import fine_mean, fine_sum, share
from ..functions.unnest import unnest
from .ordered import exact_quantiles, running_sums

# Labels of the credit score bands, lowest first.
BANDS = ("Poor", "Fair", "Good", "Very Good", "Excellent")
FLOOR = 1e-6


def ratio_features(df: DataFrame) -> DataFrame:
    """Income by age, credit score by income, balance by transactions; null on a zero divisor."""
    return df.select(
        "*",
        F.try_divide("income", "age").alias("income_age_ratio"),
        (F.try_divide("credit_score", "income") * 1000).alias("credit_income_ratio"),
        F.try_divide(F.col("account_balance"), F.col("transaction_count") + 1).alias(
            "balance_transaction_ratio"
        ),
    )


def high_value_flag(df: DataFrame, column: str, q: float = 0.8, segments: int | None = None) -> DataFrame:
    """1 where the value exceeds the interpolated quantile of the column, else 0."""
    limit = exact_quantiles(df, [], column, {"q": q}, segments).scalar()
    return df.withColumn(
        "high_value", F.coalesce((F.col(column) > limit).cast("int"), F.lit(0))
    )


def _extent(df: DataFrame, column: str) -> tuple[Column, Column]:
    s = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    return s["lo"], s["hi"]


def equal_width_bins(df: DataFrame, column: str, labels: Sequence[str] = BANDS) -> DataFrame:
    """Bands of equal width, closed on the right; the minimum belongs to the first.

    A constant column lands in the middle band.
    """
    low, high = _extent(df, column)
    n = len(labels)
    width = (high - low) / n
    number = (
        F.when(width == 0, (n + 1) // 2)
        .otherwise(F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(F.try_divide(F.col(column) - low, width)))))
        .cast("int")
    )
    number = F.when(F.col(column).isNotNull(), number)
    return df.withColumn("band_no", number).withColumn(
        "band", F.get(F.array(*[F.lit(x) for x in labels]), F.col("band_no") - 1)
    )


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns shifted to mean 0 and scaled by the population deviation; a constant becomes 0."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    scaled = {
        c: (F.col(c) - stats[f"m_{c}"])
        / F.when(stats[f"s_{c}"] == 0, F.lit(1.0)).otherwise(stats[f"s_{c}"])
        for c in columns
    }
    return df.withColumns(scaled)


def fraud_features(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        fine_sum("value").alias("total"),
        fine_mean("value").alias("mean"),
        F.max("value").alias("largest"),
        share(F.col("event_type") == "error").alias("error_share"),
    )


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42,
    segments: int | None = None,
) -> DataFrame:
    """Mark the same share of every class as test rows, picked by a hash of id and seed.

    ``place`` is the row's place within its class in hash order, from 1.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    placed = running_sums(
        df.withColumn("_h", digest), [label], ["_h", key],
        {"place": F.lit(1).cast("bigint")}, segments, totals=True,
    )
    test_rows = F.floor(F.col("place_total") * F.lit(test_share))
    return placed.withColumn("is_test", F.col("place") <= test_rows).drop("_h", "place_total")


def feature_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10
) -> DataFrame:
    """Population stability index per column.

    Bins are spanned by the reference; values below and above its range, and
    nulls, have bins of their own, so a shift away from a constant shows too.
    """
    extent = reference.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns],
            *[F.max(c).alias(f"hi_{c}") for c in columns],
        )
    ).scalar()

    def binned(df: DataFrame, side: int) -> DataFrame:
        def bin_of(c):
            low, high = extent[f"lo_{c}"], extent[f"hi_{c}"]
            place = F.coalesce(F.floor(F.try_divide(F.col(c) - low, high - low) * bins), F.lit(0))
            return (
                F.when(F.col(c).isNull(), F.lit(-2))
                .when(F.col(c) < low, F.lit(-1))
                .when(F.col(c) > high, F.lit(bins))
                .otherwise(F.least(F.lit(bins - 1), place))
            )

        found = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in columns])
        return unnest(df, [], found, "feature").withColumn("side", F.lit(side))

    counts = (
        binned(reference, 0)
        .unionAll(binned(current, 1))
        .groupBy("feature", "bin")
        .agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    )
    totals = counts.groupBy("feature").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    p = F.greatest(F.col("p") / F.col("np"), F.lit(FLOOR))
    q = F.greatest(F.coalesce(F.try_divide("q", "nq"), F.lit(0.0)), F.lit(FLOOR))
    return (
        counts.join(totals, "feature")
        .groupBy("feature")
        .agg(F.round(F.sum((p - q) * F.ln(p / q)), 6).alias("psi"))
    )


def sentiment_score(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Share of positive minus share of negative words among the listed words of a document.

    Spark sends the lexicon to every task if its measured size allows, and else
    joins by word.
    """
    # The outer form keeps the optimizer from splitting every text twice.
    words = documents.select(
        "doc_id", F.explode_outer(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    )
    found = words.join(lexicon, "word").withColumn("n", F.lit(1))
    scored = found.groupBy("doc_id").agg(
        F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("polarity")).alias("balance")
    )
    return documents.select("doc_id").join(scored, "doc_id", "left").select(
        "doc_id",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        (F.col("balance").cast("double") / F.col("hits")).alias("sentiment"),
    )
