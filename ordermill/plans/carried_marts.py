"""Marts carried on: new items are merged into stored partial aggregates, old lines are not read.

The state holds what the marts can be finished from and what can still be added to:

- ``day_customer``: lines, cents and priced lines per (day, customer); its rows are the customers
  that a day's distinct count counts;
- ``customer_order`` and ``customer_category``: cents and time per order, lines per category;
- ``product_order``: quantity, cents and priced lines per (product, order);
- ``orderless`` items whose order has not come yet, and ``productless`` lines of delivered orders
  whose product has not; both are tried again each time;
- ``applied``: the batches that are in it.

All kinds are one table and so one published version: a run that is lost before it leaves the old
state, and a batch that is applied already is not applied again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.contracts import (
    CUSTOMER_METRICS,
    DAILY_SALES,
    MART_STATE,
    PRODUCT_PERFORMANCE,
)
from ordermill.functions import line_cents, mean_of_cents, money_of_cents, price_cents, sale_date
from ordermill.operators.quality import conform
from ordermill.operators.relational import DELIVERED, delivered, items_of, order_lines, with_product
from ordermill.plans.marts import customers_of, days_of
from ordermill.sinks.layers import PathLayers

DAYS, ORDERS, CATEGORIES, PRODUCTS = "day_customer", "customer_order", "customer_category", "product_order"
ORDERLESS, PRODUCTLESS, APPLIED = "orderless", "productless", "applied"
KEYS = {
    DAYS: ("sale_date", "customer_id"),
    ORDERS: ("customer_id", "order_id"),
    CATEGORIES: ("customer_id", "category"),
    PRODUCTS: ("product_id", "order_id"),
}
ITEM = ("order_id", "order_item_id", "product_id", "price", "freight_value")
SUMS = ("line_count", "cents", "priced", "quantity")


def _of(kind: str | None, rows: DataFrame) -> DataFrame:
    """Rows in the shape of the state; without ``kind`` they tell theirs."""
    return rows.select(
        *[
            F.lit(kind).alias("kind")
            if f.name == "kind" and kind
            else (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in MART_STATE.schema
        ]
    )


def _kind(state: DataFrame, kind: str) -> DataFrame:
    return state.filter(F.col("kind") == kind)


def partials(
    orders: DataFrame, items: DataFrame, products: DataFrame, old: DataFrame, status: str
) -> DataFrame:
    """What new items, and those that waited in ``old``, add to the state, line by line.

    Rows are summed up where they meet the old state, so a task of a join holds no totals that
    another step holds again. ``waits`` tells rows that are kept as they are.
    """
    waited = _kind(old, ORDERLESS).select(*ITEM)
    candidates = items.select(*[F.col(c).cast(waited.schema[c].dataType) for c in ITEM]).union(waited)
    known = orders.select(F.col("order_id").cast("string"))
    sold = delivered(orders, status).select(
        F.col("order_id").cast("string"),
        F.col("customer_id").cast("string"),
        F.col("order_purchase_timestamp").cast("timestamp").alias("order_time"),
        sale_date().alias("sale_date"),
    )
    lines = order_lines(sold, candidates).withColumn("cents", line_cents())
    one = F.lit(1)

    def priced(value: str) -> Column:
        return F.when(F.col(value).isNotNull(), one).otherwise(0).alias("priced")

    per_day = lines.select(*KEYS[DAYS], one.alias("line_count"), "cents", priced("cents"))
    per_product = items_of(sold, candidates).select(
        *KEYS[PRODUCTS], F.col("order_item_id").alias("quantity"), price_cents().alias("cents"), priced("price")
    )
    line = ("customer_id", "order_id", "order_time", "product_id", "cents")
    details = lines.select(*line).union(_kind(old, PRODUCTLESS).select(*line))
    categories = products.select(
        F.col("product_id").cast("string"), F.col("product_category_name").alias("category")
    )
    # a line counts for its order and for its category
    counted = (
        ("kind", F.lit(ORDERS), F.lit(CATEGORIES)),
        ("order_id", F.col("order_id"), F.lit(None)),
        ("category", F.lit(None), F.col("category")),
        ("cents", F.col("cents"), F.lit(None)),
        ("order_time", F.col("order_time"), F.lit(None)),
        ("line_count", F.lit(None), one),
    )
    types = {f.name: f.dataType for f in MART_STATE.schema}
    both = [F.struct(*[c[i].cast(types[c[0]]).alias(c[0]) for c in counted]) for i in (1, 2)]
    per_customer = details.join(categories, "product_id").select("customer_id", F.inline(F.array(*both)))
    parts = [
        _of(DAYS, per_day),
        _of(PRODUCTS, per_product),
        _of(None, per_customer),
        _of(ORDERLESS, candidates.join(known, "order_id", "left_anti")),
        _of(PRODUCTLESS, details.join(categories, "product_id", "left_anti")),
    ]
    return reduce(DataFrame.union, [rows.withColumn("waits", F.lit(i >= 3)) for i, rows in enumerate(parts)])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key of each kind; waiting rows are those of ``new``, which has tried them all."""
    keys = sorted({c for columns in KEYS.values() for c in columns})
    added = new.filter(~F.col("waits")).drop("waits")
    both = old.filter(F.col("kind").isin(*KEYS)).union(added)
    totals = both.groupBy("kind", *keys).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("order_time").alias("order_time")
    )
    rest = new.filter("waits").drop("waits").union(_kind(old, APPLIED))
    columns = [
        (F.col(f.name) if f.name in totals.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in MART_STATE.schema
    ]
    return totals.select(*columns).union(rest)


def stored_state(spark: SparkSession, target: PathLayers) -> DataFrame:
    if not target.exists(spark, MART_STATE):
        return spark.createDataFrame([], MART_STATE.schema)
    return target.read(spark, MART_STATE).select(*MART_STATE.schema.names)


def carry_on(
    batch: str,
    orders: DataFrame,
    new_items: DataFrame,
    products: DataFrame,
    target: PathLayers,
    status: str = DELIVERED,
) -> bool:
    """Merge a named batch of new items into the state; whether it was not there already.

    ``orders`` and ``products`` are all that have come so far: a new item may be of an older order,
    and an order or product may come after its items. Of items only the new ones are read.
    """
    spark = new_items.sparkSession
    old = stored_state(spark, target)
    if not _kind(old, APPLIED).filter(F.col("batch") == batch).isEmpty():
        return False
    noted = _of(APPLIED, spark.createDataFrame([(batch,)], "batch string"))
    new = partials(orders, new_items, products, old, status)
    target.write(merged(old, new).union(noted), MART_STATE)
    return True


def finished(state: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """The three marts out of the state, equal to those computed from all lines."""
    per_day = (
        _kind(state, DAYS)
        .groupBy("sale_date")
        .agg(
            F.sum("line_count").alias("total_orders"),
            F.sum("cents").alias("cents"),
            F.count("customer_id").alias("unique_customers"),
            F.sum("priced").alias("priced_lines"),
        )
    )
    by_order = (F.col("kind") == ORDERS).cast("int").alias("is_order")
    parts = state.filter(F.col("kind").isin(ORDERS, CATEGORIES)).select(
        by_order, "customer_id", "category", "cents", "order_time", "line_count"
    )
    sold = _kind(state, PRODUCTS).groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("cents").alias("cents"),
        F.sum("priced").alias("priced"),
        F.count(F.lit(1)).alias("total_orders"),
    )
    listed = with_product(sold, products.withColumn("product_id", F.col("product_id").cast("string")))
    return {
        CUSTOMER_METRICS.name: customers_of(parts),
        DAILY_SALES.name: days_of(per_day),
        PRODUCT_PERFORMANCE.name: listed.select(
            "product_id",
            "product_category_name",
            "total_quantity_sold",
            money_of_cents(F.col("cents")).alias("total_revenue"),
            mean_of_cents(F.col("cents"), F.col("priced")).alias("avg_price"),
            "total_orders",
        ),
    }


def write_marts(spark: SparkSession, products: DataFrame, target: PathLayers) -> dict[str, int]:
    """Write the marts that the state gives; rows of each."""
    marts = finished(stored_state(spark, target), products)
    contracts = {c.name: c for c in (CUSTOMER_METRICS, DAILY_SALES, PRODUCT_PERFORMANCE)}
    return {
        name: target.write(conform(mart, contracts[name]), contracts[name]).rows
        for name, mart in marts.items()
    }
