"""Aggregations. Every one combines on the map side, so a hot key shrinks before it moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.functions import (
    days_between,
    line_amount,
    mean,
    mean_of_cents,
    money,
    money_of_cents,
    price_cents,
)


def order_totals(lines: DataFrame) -> DataFrame:
    """Order total and order time per (order_id, customer_id).

    The time depends on the order, so ``min`` equals any row's value and is stable.
    """
    return lines.groupBy("order_id", "customer_id").agg(
        F.sum(line_amount()).alias("order_total"),
        F.min("order_purchase_timestamp").alias("order_time"),
    )


def customer_totals(totals: DataFrame) -> DataFrame:
    """Per-customer order count, spend, average order value and order date range."""
    per_customer = totals.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("order_total").alias("spent"),
        F.count("order_total").alias("priced_orders"),
        F.to_date(F.min("order_time")).alias("first_order_date"),
        F.to_date(F.max("order_time")).alias("last_order_date"),
    )
    return per_customer.select(
        "customer_id",
        "total_orders",
        money(F.col("spent")).alias("total_spent"),
        mean(F.col("spent"), F.col("priced_orders")).alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        days_between("last_order_date", "first_order_date").alias("customer_lifetime_days"),
    )


def category_counts(details: DataFrame) -> DataFrame:
    """Lines per (customer, category); the null category is a group of its own."""
    return details.groupBy("customer_id", "product_category_name").agg(
        F.count(F.lit(1)).alias("category_orders")
    )


def product_totals(items: DataFrame) -> DataFrame:
    """Quantity, revenue, average price and distinct orders per product.

    The exact distinct count first groups by (product_id, order_id), which spreads a
    hot product over the cluster.
    """
    per_product = items.groupBy("product_id").agg(
        F.sum("order_item_id").alias("total_quantity_sold"),
        F.sum(price_cents()).alias("cents"),
        F.count("price").alias("priced_lines"),
        F.count_distinct("order_id").alias("total_orders"),
    )
    return per_product.select(
        "product_id",
        "total_quantity_sold",
        money_of_cents(F.col("cents")).alias("total_revenue"),
        mean_of_cents(F.col("cents"), F.col("priced_lines")).alias("avg_price"),
        "total_orders",
    )


def distinct_per(df: DataFrame, key: str | Column, column: str, name: str) -> DataFrame:
    """Exact distinct count of ``column`` per key."""
    return df.groupBy(key).agg(F.count_distinct(column).alias(name))


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
