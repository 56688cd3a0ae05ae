"""Filters and joins over orders, order items and products.

Joins carry no hints. Spark broadcasts a side only when its size is below
``spark.sql.autoBroadcastJoinThreshold``; beyond it the join is a sort-merge join whose
hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIVERED = "delivered"


def delivered(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Orders in the delivered status; case matters and a null status does not pass."""
    return orders.filter(F.col("order_status") == status)


def rows_with_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def order_lines(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item of the given orders; orders without items drop out."""
    return orders.join(items, "order_id")


def line_details(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their product's columns; a line of an unknown product drops out."""
    return lines.join(products, "product_id")


def items_of(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Items whose order is among ``orders``, each once."""
    return items.join(orders.select("order_id"), "order_id", "left_semi")


def with_product(aggregates: DataFrame, products: DataFrame) -> DataFrame:
    """Attach the category to per-product aggregates."""
    return aggregates.join(products.select("product_id", "product_category_name"), "product_id")


def with_favorite(metrics: DataFrame, favorites: DataFrame) -> DataFrame:
    """Attach the favorite category; customers without one keep a null."""
    return metrics.join(favorites, "customer_id", "left")
