"""The marts, their declared shapes and the job summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordermill.catalog.mapping import DELIVERED_CODE
from ordermill.catalog.operator_checks import CUSTOMER_TOTALS_SQL, RANKED_SQL
from ordermill.catalog.registry import check
from ordermill.contracts import CUSTOMER_METRICS, DAILY_SALES, PRODUCT_PERFORMANCE
from ordermill.operators.quality import conform
from ordermill.plans import carried_marts, jobs, marts
from ordermill.session import scratch_path
from ordermill.sinks.layers import PathLayers


def _customer_metrics(t):
    return marts.customer_metrics(t.orders(), t.items(), t.products(), DELIVERED_CODE)


def _daily_sales(t):
    return marts.daily_sales(t.orders(), t.items(), DELIVERED_CODE)


def _product_performance(t):
    return marts.product_performance(t.orders(), t.items(), t.products(), DELIVERED_CODE)


def _declared(df, contract):
    """Declared shape without the time of writing, identifiers as given."""
    shaped = conform(df, contract).drop(*contract.stamped)
    ids = {c: F.col(c).cast("bigint") for c in contract.primary_key if c.endswith("_id")}
    return shaped.withColumns(ids) if ids else shaped


# Half-up average of whole cents, exact in integers.
_MEAN_CENTS = "(2 * {cents} + {n}) // (2 * {n})"


def _mean_sql(cents: str, n: str, declared: str) -> str:
    mean = _MEAN_CENTS.format(cents=cents, n=n)
    return f"CAST(CAST({mean} AS DECIMAL(18,0)) / 100 AS {declared})"


_CUSTOMER_SQL = (
    RANKED_SQL
    + CUSTOMER_TOTALS_SQL
    + """
SELECT c.* EXCLUDE (spent_cents, priced_orders), r.product_category_name AS favorite_category
FROM customer_totals c
LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (customer_id)
"""
)


@check("customer_metrics", _CUSTOMER_SQL)
def customer_metrics(t):
    return _customer_metrics(t)


_DAILY_SQL = """
, daily AS (
  SELECT CAST(order_purchase_timestamp AS DATE) AS sale_date, count(order_id) AS total_orders,
         CAST(sum(price + freight_value) AS DECIMAL(15,2)) AS total_revenue,
         count(DISTINCT customer_id) AS unique_customers,
         CAST(sum(price + freight_value) * 100 AS DOUBLE) / (count(price + freight_value) * 100)
           AS avg_order_value,
         CAST(sum(price + freight_value) * 100 AS HUGEINT) AS cents,
         count(price + freight_value) AS priced
  FROM t_lines GROUP BY 1
)
"""


_DAILY_MART_SQL = _DAILY_SQL + "SELECT * EXCLUDE (cents, priced) FROM daily"


@check("daily_sales", _DAILY_MART_SQL)
def daily_sales(t):
    return _daily_sales(t)


_PRODUCT_SQL = """
, sold AS (
  SELECT product_id, CAST(sum(order_item_id) AS BIGINT) AS total_quantity_sold,
         CAST(sum(price) AS DECIMAL(15,2)) AS total_revenue,
         CAST(sum(price) * 100 AS DOUBLE) / (count(price) * 100) AS avg_price,
         count(DISTINCT order_id) AS total_orders,
         CAST(sum(price) * 100 AS HUGEINT) AS cents, count(price) AS priced
  FROM t_lines GROUP BY product_id
)
"""


_PRODUCT_MART_SQL = (
    _PRODUCT_SQL
    + """
SELECT s.product_id, p.product_category_name, s.total_quantity_sold, s.total_revenue,
       s.avg_price, s.total_orders
FROM sold s JOIN t_products p ON s.product_id = p.product_id
"""
)


@check("product_performance", _PRODUCT_MART_SQL)
def product_performance(t):
    return _product_performance(t)


@check(
    "conform_customer_metrics",
    RANKED_SQL
    + CUSTOMER_TOTALS_SQL
    + f"""
SELECT customer_id, total_orders, total_spent,
       {_mean_sql('spent_cents', 'priced_orders', 'DECIMAL(12,2)')} AS avg_order_value,
       first_order_date, last_order_date, customer_lifetime_days,
       r.product_category_name AS favorite_category
FROM customer_totals
LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (customer_id)
""",
)
def conform_customer_metrics(t):
    return _declared(_customer_metrics(t), CUSTOMER_METRICS)


@check(
    "conform_daily_sales",
    _DAILY_SQL
    + f"""
SELECT sale_date, total_orders, total_revenue, unique_customers,
       {_mean_sql('cents', 'priced', 'DECIMAL(12,2)')} AS avg_order_value
FROM daily
""",
)
def conform_daily_sales(t):
    return _declared(_daily_sales(t), DAILY_SALES)


@check(
    "conform_product_performance",
    _PRODUCT_SQL
    + f"""
SELECT s.product_id, p.product_category_name AS product_category,
       s.total_quantity_sold, s.total_revenue,
       {_mean_sql('s.cents', 's.priced', 'DECIMAL(10,2)')} AS avg_price,
       s.total_orders
FROM sold s JOIN t_products p ON s.product_id = p.product_id
""",
)
def conform_product_performance(t):
    return _declared(_product_performance(t), PRODUCT_PERFORMANCE)


@check(
    "mart_run_summary",
    """
SELECT 'customers_processed' AS metric, count(DISTINCT customer_id) AS row_count FROM t_details
UNION ALL
SELECT 'days_analyzed', count(DISTINCT CAST(order_purchase_timestamp AS DATE)) FROM t_lines
UNION ALL
SELECT 'products_analyzed', count(DISTINCT product_id) FROM t_details
""",
)
def mart_run_summary(t):
    """Write all marts to a scratch layer and report what was written."""
    target = PathLayers(scratch_path(t.spark, "marts"))
    written = jobs.build_marts(t.orders(), t.items(), t.products(), target, DELIVERED_CODE)
    return jobs.mart_summary(t.spark, written)


def _carried(t, mart):
    """A mart out of the state of two batches that mix old and new orders, customers and days.

    Some orders and products come only with the second batch, after items of theirs.
    """
    target = PathLayers(scratch_path(t.spark, "carried"))
    orders, products, items = t.orders(), t.products(), t.items()
    early = (F.col("order_id") + F.col("order_item_id")) % 3 != 0
    carried_marts.carry_on(
        "first",
        orders.filter("order_id % 5 <> 0"),
        items.filter(early),
        products.filter("product_id % 7 <> 0"),
        target,
        DELIVERED_CODE,
    )
    for batch in ("second", "second"):
        carried_marts.carry_on(batch, orders, items.filter(~early), products, target, DELIVERED_CODE)
    return carried_marts.finished(carried_marts.stored_state(t.spark, target), products)[mart]


@check("customer_metrics_increment", _CUSTOMER_SQL)
def customer_metrics_increment(t):
    return _carried(t, CUSTOMER_METRICS.name).withColumn("customer_id", F.col("customer_id").cast("bigint"))


@check("daily_sales_increment", _DAILY_MART_SQL)
def daily_sales_increment(t):
    return _carried(t, DAILY_SALES.name)


@check("product_performance_increment", _PRODUCT_MART_SQL)
def product_performance_increment(t):
    found = _carried(t, PRODUCT_PERFORMANCE.name)
    return found.withColumn("product_id", F.col("product_id").cast("bigint"))
