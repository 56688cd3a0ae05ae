"""Projections, filters, joins, aggregations, windows and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordermill.catalog.mapping import DELIVERED_CODE, Tables
from ordermill.catalog.registry import check
from ordermill.functions import days_between, line_amount, mean, money, sale_date
from ordermill.operators import aggregates, bitmaps, ranking, relational
from ordermill.plans import marts
from ordermill.session import scratch_root


def _delivered(t: Tables):
    return relational.delivered(t.orders(), DELIVERED_CODE)


def _lines(t: Tables):
    return relational.order_lines(_delivered(t), t.items())


def _details(t: Tables):
    return relational.line_details(_lines(t), t.products())


# Projections and filters


@check("project_delivered_keys", "SELECT order_id FROM t_delivered")
def project_delivered_keys(t):
    return _delivered(t).select("order_id")


@check(
    "project_rename",
    "SELECT product_id, product_category_name AS favorite_category FROM t_products",
)
def project_rename(t):
    return t.products().select(
        "product_id", F.col("product_category_name").alias("favorite_category")
    )


@check(
    "derive_sale_date",
    "SELECT order_id, CAST(order_purchase_timestamp AS DATE) AS sale_date FROM t_orders",
)
def derive_sale_date(t):
    return t.orders().select("order_id", sale_date().alias("sale_date"))


@check(
    "derive_lifetime_days",
    """
SELECT customer_id,
       CAST(date_diff('day', CAST(min(order_purchase_timestamp) AS DATE),
                      CAST(max(order_purchase_timestamp) AS DATE)) AS INTEGER)
         AS customer_lifetime_days
FROM t_orders GROUP BY customer_id
""",
)
def derive_lifetime_days(t):
    spans = t.orders().groupBy("customer_id").agg(
        F.min("order_purchase_timestamp").alias("first"),
        F.max("order_purchase_timestamp").alias("last"),
    )
    return spans.select(
        "customer_id", days_between("last", "first").alias("customer_lifetime_days")
    )


@check("filter_delivered", "SELECT order_id, customer_id, order_status FROM t_delivered")
def filter_delivered(t):
    return _delivered(t).select("order_id", "customer_id", "order_status")


@check(
    "filter_is_null",
    """
SELECT order_id, order_item_id, product_id, price
FROM t_items_gaps WHERE freight_value IS NULL
""",
)
def filter_is_null(t):
    return relational.rows_with_null(t.items_with_gaps(), "freight_value").select(
        "order_id", "order_item_id", "product_id", "price"
    )


# Joins


@check(
    "join_orders_items",
    "SELECT order_id, customer_id, order_item_id, product_id, price, freight_value FROM t_lines",
)
def join_orders_items(t):
    return _lines(t).select(
        "order_id", "customer_id", "order_item_id", "product_id", "price", "freight_value"
    )


@check(
    "join_lines_products",
    """
SELECT product_id, order_id, order_item_id, product_category_name
FROM t_items JOIN t_products USING (product_id)
""",
)
def join_lines_products(t):
    return relational.line_details(t.items(), t.products()).select(
        "product_id", "order_id", "order_item_id", "product_category_name"
    )


@check(
    "join_three_way",
    """
SELECT order_id, customer_id, product_id, product_category_name, order_item_id, price
FROM t_details
""",
)
def join_three_way(t):
    return _details(t).select(
        "order_id",
        "customer_id",
        "product_id",
        "product_category_name",
        "order_item_id",
        "price",
    )


RANKED_SQL = """
, counts AS (
  SELECT customer_id, product_category_name, count(*) AS category_orders
  FROM t_details GROUP BY customer_id, product_category_name
), ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY customer_id
    ORDER BY category_orders DESC, product_category_name ASC NULLS LAST) AS rn
  FROM counts
)
"""


@check(
    "join_left_favorite",
    RANKED_SQL
    + """
SELECT o.customer_id, o.total_orders, r.product_category_name AS favorite_category
FROM (SELECT customer_id, count(order_id) AS total_orders FROM t_orders GROUP BY customer_id) o
LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (customer_id)
""",
)
def join_left_favorite(t):
    """All customers with an order; the favorite counts delivered lines only."""
    per_customer = t.orders().groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders")
    )
    return relational.with_favorite(per_customer, ranking.favorite_category(_details(t)))


@check(
    "semi_join_delivered_items",
    """
SELECT order_id, order_item_id, product_id, price
FROM t_items WHERE order_id IN (SELECT order_id FROM t_delivered)
""",
)
def semi_join_delivered_items(t):
    return relational.items_of(_delivered(t), t.items()).select(
        "order_id", "order_item_id", "product_id", "price"
    )


@check(
    "join_after_agg",
    """
SELECT a.product_id, p.product_category_name, a.total_quantity_sold, a.total_revenue
FROM (SELECT product_id, CAST(sum(order_item_id) AS BIGINT) AS total_quantity_sold,
             CAST(sum(price) AS DECIMAL(15,2)) AS total_revenue
      FROM t_items GROUP BY product_id) a
JOIN t_products p ON a.product_id = p.product_id
""",
)
def join_after_agg(t):
    return relational.with_product(aggregates.product_totals(t.items()), t.products()).select(
        "product_id", "product_category_name", "total_quantity_sold", "total_revenue"
    )


# Aggregations


@check(
    "order_totals",
    """
SELECT order_id, customer_id,
       CAST(sum(price + freight_value) AS DECIMAL(15,2)) AS order_total,
       CAST(min(order_purchase_timestamp) AS DATE) AS order_date
FROM t_details GROUP BY order_id, customer_id
""",
)
def order_totals(t):
    return aggregates.order_totals(_details(t)).select(
        "order_id",
        "customer_id",
        money(F.col("order_total")).alias("order_total"),
        F.to_date("order_time").alias("order_date"),
    )


@check(
    "sum_expression_nulls",
    """
SELECT product_id, CAST(sum(price + freight_value) AS DECIMAL(15,2)) AS amount,
       count(price + freight_value) AS priced_lines, count(*) AS line_count
FROM t_items_gaps GROUP BY product_id
""",
)
def sum_expression_nulls(t):
    return t.items_with_gaps().groupBy("product_id").agg(
        money(F.sum(line_amount())).alias("amount"),
        F.count(line_amount()).alias("priced_lines"),
        F.count(F.lit(1)).alias("line_count"),
    )


@check(
    "sum_by_product",
    """
SELECT product_id, CAST(sum(order_item_id) AS BIGINT) AS total_quantity_sold,
       CAST(sum(price) AS DECIMAL(15,2)) AS total_revenue
FROM t_items GROUP BY product_id
""",
)
def sum_by_product(t):
    return t.items().groupBy("product_id").agg(
        F.sum("order_item_id").alias("total_quantity_sold"),
        money(F.sum("price")).alias("total_revenue"),
    )


@check(
    "first_order_ts",
    """
SELECT order_id, min(order_purchase_timestamp) AS order_time
FROM t_lines GROUP BY order_id
""",
)
def first_order_ts(t):
    return aggregates.order_totals(_lines(t)).select("order_id", "order_time")


@check(
    "count_non_null",
    """
SELECT product_id, count(freight_value) AS with_freight, count(order_id) AS with_order
FROM t_items_gaps GROUP BY product_id
""",
)
def count_non_null(t):
    return t.items_with_gaps().groupBy("product_id").agg(
        F.count("freight_value").alias("with_freight"),
        F.count("order_id").alias("with_order"),
    )


@check(
    "category_counts",
    """
SELECT customer_id, product_category_name, count(*) AS category_orders
FROM t_lines JOIN t_products_gaps USING (product_id)
GROUP BY customer_id, product_category_name
""",
)
def category_counts(t):
    return aggregates.category_counts(
        relational.line_details(_lines(t), t.products_with_gaps())
    )


@check(
    "distinct_customers_per_day",
    """
SELECT CAST(order_purchase_timestamp AS DATE) AS sale_date,
       count(DISTINCT customer_id) AS unique_customers
FROM t_orders GROUP BY 1
""",
)
def distinct_customers_per_day(t):
    return aggregates.distinct_per(
        t.orders(), sale_date().alias("sale_date"), "customer_id", "unique_customers"
    )


@check(
    "avg_by_key",
    """
SELECT product_id, CAST(sum(price) * 100 AS DOUBLE) / (count(price) * 100) AS avg_price,
       CAST(sum(price + freight_value) * 100 AS DOUBLE)
         / (count(price + freight_value) * 100) AS avg_amount
FROM t_items_gaps GROUP BY product_id
""",
)
def avg_by_key(t):
    return t.items_with_gaps().groupBy("product_id").agg(
        mean(F.sum("price"), F.count("price")).alias("avg_price"),
        mean(F.sum(line_amount()), F.count(line_amount())).alias("avg_amount"),
    )


@check(
    "order_date_range",
    """
SELECT customer_id, min(order_purchase_timestamp) AS first_order,
       max(order_purchase_timestamp) AS last_order
FROM t_orders GROUP BY customer_id
""",
)
def order_date_range(t):
    return t.orders().groupBy("customer_id").agg(
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"),
    )


CUSTOMER_TOTALS_SQL = """
, totals AS (
  SELECT order_id, customer_id, sum(price + freight_value) AS order_total,
         min(order_purchase_timestamp) AS order_time
  FROM t_details GROUP BY order_id, customer_id
), customer_totals AS (
  SELECT customer_id, count(order_id) AS total_orders,
         CAST(sum(order_total) AS DECIMAL(15,2)) AS total_spent,
         CAST(sum(order_total) * 100 AS DOUBLE) / (count(order_total) * 100) AS avg_order_value,
         CAST(min(order_time) AS DATE) AS first_order_date,
         CAST(max(order_time) AS DATE) AS last_order_date,
         CAST(date_diff('day', CAST(min(order_time) AS DATE), CAST(max(order_time) AS DATE))
              AS INTEGER) AS customer_lifetime_days,
         CAST(sum(order_total) * 100 AS HUGEINT) AS spent_cents,
         count(order_total) AS priced_orders
  FROM totals GROUP BY customer_id
)
"""


@check(
    "two_level_customer_totals",
    CUSTOMER_TOTALS_SQL
    + "SELECT * EXCLUDE (spent_cents, priced_orders) FROM customer_totals",
)
def two_level_customer_totals(t):
    return aggregates.customer_totals(aggregates.order_totals(_details(t)))


@check(
    "mixed_distinct_agg",
    """
SELECT product_id, count(DISTINCT order_id) AS total_orders,
       CAST(sum(order_item_id) AS BIGINT) AS total_quantity_sold,
       CAST(sum(price) AS DECIMAL(15,2)) AS total_revenue,
       CAST(sum(price) * 100 AS DOUBLE) / (count(price) * 100) AS avg_price
FROM t_items GROUP BY product_id
""",
)
def mixed_distinct_agg(t):
    return aggregates.product_totals(t.items())


@check(
    "row_counts",
    """
SELECT 'customers' AS table_name, count(*) AS row_count FROM t_customers
UNION ALL SELECT 'orders', count(*) FROM t_orders
UNION ALL SELECT 'order_items', count(*) FROM t_items
UNION ALL SELECT 'products', count(*) FROM t_products
""",
)
def row_counts(t):
    def counted(name, df):
        return aggregates.row_count(df).select(F.lit(name).alias("table_name"), "row_count")

    return (
        counted("customers", t.customers())
        .unionByName(counted("orders", t.orders()))
        .unionByName(counted("order_items", t.items()))
        .unionByName(counted("products", t.products()))
    )


# Windows and sorts


@check(
    "rank_categories",
    RANKED_SQL
    + """
SELECT customer_id, product_category_name, category_orders, CAST(rn AS INTEGER) AS rn FROM ranked
""",
)
def rank_categories(t):
    return ranking.rank_within(
        aggregates.category_counts(_details(t)), ["customer_id"], ranking.category_preference()
    )


@check(
    "top_category_per_customer",
    RANKED_SQL
    + """
SELECT customer_id, product_category_name AS favorite_category FROM ranked WHERE rn = 1
""",
)
def top_category_per_customer(t):
    return ranking.favorite_category(_details(t))


@check(
    "sort_daily_sales",
    """
SELECT CAST(order_purchase_timestamp AS DATE) AS sale_date, count(order_id) AS total_orders,
       row_number() OVER (ORDER BY CAST(order_purchase_timestamp AS DATE) NULLS FIRST)
         AS position
FROM t_lines GROUP BY 1
""",
)
def sort_daily_sales(t):
    daily = marts.daily_sales(t.orders(), t.items(), DELIVERED_CODE)
    return ranking.with_position(daily.select("sale_date", "total_orders"), ranking.by_date())


@check(
    "sort_products_by_revenue",
    """
, sold AS (
  SELECT product_id, CAST(sum(price) AS DECIMAL(15,2)) AS total_revenue
  FROM t_lines JOIN t_products USING (product_id) GROUP BY product_id
)
SELECT product_id, total_revenue,
       row_number() OVER (ORDER BY total_revenue DESC NULLS LAST, product_id) AS position
FROM sold
""",
)
def sort_products_by_revenue(t):
    products = marts.product_performance(t.orders(), t.items(), t.products(), DELIVERED_CODE)
    return ranking.with_position(
        products.select("product_id", "total_revenue"), ranking.by_revenue()
    )


@check(
    "distinct_customers_rollup",
    """
SELECT grain, period, count(DISTINCT customer_id) AS unique_customers
FROM (
  SELECT customer_id, CAST(order_purchase_timestamp AS DATE) AS day FROM t_orders
), LATERAL (
  SELECT unnest(['day', 'week', 'month']) AS grain,
         unnest([day, CAST(date_trunc('week', day) AS DATE), CAST(date_trunc('month', day) AS DATE)]) AS period
)
GROUP BY ALL
""",
)
def distinct_customers_rollup(t):
    """Days are read from the orders, in two halves; weeks and months from the days' bitmaps."""
    scratch_root(t.spark)
    orders = t.orders().select("customer_id", "order_id", sale_date().alias("day"))
    halves = [
        bitmaps.member_bitmaps(orders.filter(f"order_id % 2 = {half}"), ["day"], "customer_id")
        for half in (0, 1)
    ]
    days = bitmaps.merge_bitmaps(halves[0].union(halves[1]), ["day"]).checkpoint()
    grains = {
        "day": F.col("day"),
        "week": F.date_trunc("week", "day").cast("date"),
        "month": F.date_trunc("month", "day").cast("date"),
    }
    counts = [
        bitmaps.members(
            bitmaps.merge_bitmaps(days, [period.alias("period")]), ["period"], "unique_customers"
        ).select(F.lit(grain).alias("grain"), "period", "unique_customers")
        for grain, period in grains.items()
    ]
    return counts[0].union(counts[1]).union(counts[2])
