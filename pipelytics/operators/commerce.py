"""Customer and order analytics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import money_sum, moment_like


def filter_lookback(df: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    """Rows not older than ``days`` days before ``as_of``."""
    return df.where(F.col(column) >= moment_like(as_of - timedelta(days=days), df, column))


def filter_status(df: DataFrame, status: str = "completed") -> DataFrame:
    return df.where(F.col("status") == status)


def extract_orders(
    customers: DataFrame, orders: DataFrame, items: DataFrame, as_of: datetime, days: int
) -> DataFrame:
    """Recent completed orders with their customer and lines, newest first.

    Order and product settle equal dates, which also lets the sort spread a day
    with many orders over several tasks.
    """
    recent = filter_status(filter_lookback(orders, "order_date", as_of, days))
    return (
        recent.join(customers.select("customer_id", "name", "segment"), "customer_id")
        .join(items.select("order_id", "product_id", "quantity", "unit_price"), "order_id")
        .select(
            "customer_id", "name", "segment", "order_id", "order_date", "total_amount",
            "product_id", "quantity", "unit_price",
        )
        .orderBy(F.desc("order_date"), "order_id", "product_id")
    )


def orphan_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of unknown customers."""
    return orders.join(customers.select("customer_id"), "customer_id", "left_anti")


def valid_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with a positive amount and a known customer."""
    return orders.where("total_amount > 0").join(
        customers.select("customer_id"), "customer_id", "left_semi"
    )


def daily_revenue(orders: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Revenue, order count and mean order value per customer and day."""
    recent = filter_status(filter_lookback(orders, "order_date", as_of, days))
    return (
        recent.groupBy("customer_id", F.to_date("order_date").alias("order_day"))
        .agg(
            money_sum("total_amount").alias("daily_revenue"),
            F.count(F.lit(1)).alias("order_count"),
            F.try_divide(money_sum("total_amount"), F.count("total_amount")).alias(
                "avg_order_value"
            ),
        )
        .orderBy(F.desc("daily_revenue"), "customer_id", "order_day")
    )


def customer_lifetime_value(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        money_sum("total_amount").alias("lifetime_value"),
        F.count(F.lit(1)).alias("order_count"),
        F.try_divide(money_sum("total_amount"), F.count("total_amount")).alias("avg_order_value"),
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
        F.datediff(F.max("order_date"), F.min("order_date")).cast("bigint").alias("tenure_days"),
    )


def top_customers(
    orders: DataFrame, customers: DataFrame, k: int, by: str = "segment"
) -> DataFrame:
    """The ``k`` customers with the most revenue of each group; the lower id wins a tie."""
    revenue = orders.groupBy("customer_id").agg(money_sum("total_amount").alias("revenue"))
    order = Window.partitionBy(by).orderBy(F.desc("revenue"), "customer_id")
    return (
        revenue.join(customers.select("customer_id", by), "customer_id")
        .withColumn("position", F.rank().over(order))
        .where(F.col("position") <= k)
    )


def top_revenue_days(revenue: DataFrame, k: int) -> DataFrame:
    return revenue.orderBy(F.desc("daily_revenue"), "customer_id", "order_day").limit(k)


def sales_report(
    orders: DataFrame, customers: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Revenue by region and segment, with subtotals and a grand total.

    Amounts are summed per customer before the joins, so what moves is one row
    per customer rather than one per order.
    """
    per_customer = orders.groupBy("customer_id").agg(
        F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("amount"),
        F.count(F.lit(1)).alias("orders"),
    )
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nation_key"), F.col("r_name").alias("region")
    )
    return (
        per_customer.join(customers.select("customer_id", "segment", "nation_key"), "customer_id")
        .join(places, "nation_key")
        .rollup("region", "segment")
        .agg(
            F.sum("amount").cast("double").alias("revenue"),
            F.sum("orders").alias("orders"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )
