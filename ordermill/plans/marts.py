"""The three marts, planned for one scan per table and the fewest shuffles.

Each is a pure function of frames. The results equal the plain compositions of the
operators (tests hold them to that); only the plan differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.functions import (
    days_between,
    line_cents,
    mean_of_cents,
    money_of_cents,
    sale_date,
)
from ordermill.operators.aggregates import product_totals
from ordermill.operators.relational import (
    DELIVERED,
    delivered,
    items_of,
    line_details,
    order_lines,
    with_product,
)


def customer_metrics(
    orders: DataFrame, items: DataFrame, products: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Spend, order history and favorite category per customer.

    Order totals and category counts come from one pass over the joined lines, as two
    grouping sets, so items and orders are scanned and joined once. Orders are joined before
    products, so only lines of delivered orders are shuffled a second time. Hot orders,
    customers and categories combine on the map side of the aggregation. Lines without a
    customer are one row; as no customer is equal to null, it has no favorite category.
    """
    lines = order_lines(
        delivered(orders, status).select("order_id", "customer_id", "order_purchase_timestamp"),
        items.select("order_id", "product_id", line_cents().alias("cents")),
    )
    details = line_details(
        lines, products.select("product_id", F.col("product_category_name").alias("category"))
    ).drop("product_id")
    customer, order, category = F.col("customer_id"), F.col("order_id"), F.col("category")
    parts = details.groupingSets(
        [[customer, order], [customer, category]], customer, order, category
    ).agg(
        F.grouping(category).alias("is_order"),
        F.sum("cents").alias("cents"),
        F.min("order_purchase_timestamp").alias("order_time"),
        F.count(F.lit(1)).alias("line_count"),
    )
    return customers_of(parts)


def customers_of(parts: DataFrame) -> DataFrame:
    """The customer mart out of one row per (customer, order) and one per (customer, category)."""
    customer, category = F.col("customer_id"), F.col("category")
    is_order = F.col("is_order") == 1
    preference = F.struct(-F.col("line_count"), category.isNull(), category)
    per_customer = parts.groupBy("customer_id").agg(
        F.count_if(is_order).alias("total_orders"),
        F.sum(F.when(is_order, F.col("cents"))).alias("spent"),
        F.count(F.when(is_order, F.col("cents"))).alias("priced_orders"),
        F.to_date(F.min(F.when(is_order, F.col("order_time")))).alias("first_order_date"),
        F.to_date(F.max(F.when(is_order, F.col("order_time")))).alias("last_order_date"),
        F.min_by(category, F.when(~is_order, preference)).alias("favorite_category"),
    )
    return per_customer.select(
        "customer_id",
        "total_orders",
        money_of_cents(F.col("spent")).alias("total_spent"),
        mean_of_cents(F.col("spent"), F.col("priced_orders")).alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        days_between("last_order_date", "first_order_date").alias("customer_lifetime_days"),
        F.when(customer.isNotNull(), F.col("favorite_category")).alias("favorite_category"),
    )


def daily_sales(orders: DataFrame, items: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Item lines, revenue, customers and average line amount per day of purchase.

    ``total_orders`` counts item lines and ``avg_order_value`` averages line amounts.
    Lines are joined and aggregated once. The exact distinct count groups by (day, customer)
    first, which spreads a hot day; a hot order is split by adaptive skew handling.
    """
    lines = order_lines(
        delivered(orders, status).select(
            "order_id", "customer_id", sale_date().alias("sale_date")
        ),
        items.select("order_id", line_cents().alias("cents")),
    )
    per_day = lines.groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("cents").alias("cents"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count("cents").alias("priced_lines"),
    )
    return days_of(per_day)


def days_of(per_day: DataFrame) -> DataFrame:
    """The daily mart out of counts and cents per day."""
    return per_day.select(
        "sale_date",
        "total_orders",
        money_of_cents(F.col("cents")).alias("total_revenue"),
        "unique_customers",
        mean_of_cents(F.col("cents"), F.col("priced_lines")).alias("avg_order_value"),
    )


def product_performance(
    orders: DataFrame, items: DataFrame, products: DataFrame, status: str = DELIVERED
) -> DataFrame:
    """Quantity, revenue, average price and orders per product sold.

    ``total_quantity_sold`` sums item ordinals and revenue leaves freight out. Items are
    reduced to one row per product before the product table is joined.
    """
    sold = product_totals(items_of(delivered(orders, status), items))
    return with_product(sold, products).select(
        "product_id",
        "product_category_name",
        "total_quantity_sold",
        "total_revenue",
        "avg_price",
        "total_orders",
    )
