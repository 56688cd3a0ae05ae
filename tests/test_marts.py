from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.catalog.mapping import DELIVERED_CODE, Tables
from ordermill.functions import line_amount, mean, money, sale_date
from ordermill.operators import aggregates, ranking, relational
from ordermill.plans import marts
from tests.conftest import eur, rows

DATA = "/root/testdata/sf0.001"


def test_customer_metrics(orders, items, products):
    got = {r.customer_id: r for r in marts.customer_metrics(orders, items, products).collect()}
    assert set(got) == {"ann", "bob", "dan"}  # eve bought unknown products only
    ann = got["ann"]
    assert ann.total_orders == 2
    assert ann.total_spent == eur("33.50")  # o2 has no priced line
    assert ann.avg_order_value == 33.5  # the average leaves o2 out
    assert (ann.first_order_date, ann.last_order_date) == (date(2024, 1, 1), date(2024, 1, 2))
    assert ann.customer_lifetime_days == 1
    assert ann.favorite_category == "books"
    assert got["bob"].favorite_category is None
    assert got["bob"].total_orders == 1
    assert got["dan"].total_spent == eur("10.00")


def test_daily_sales_counts_lines_and_keeps_unknown_products(orders, items):
    got = rows(marts.daily_sales(orders, items), "sale_date")
    assert got == [
        (date(2024, 1, 1), 2, eur("33.50"), 1, 16.75),
        (date(2024, 1, 2), 6, eur("20.40"), 2, 5.1),
        (date(2024, 1, 5), 4 - 1, eur("22.00"), 2, 22 / 3),
    ]


def test_product_performance(orders, items, products):
    got = {r.product_id: r for r in marts.product_performance(orders, items, products).collect()}
    assert set(got) == {"toy1", "book1", "bare1", "bare2"}
    toy = got["toy1"]
    assert toy.total_quantity_sold == 1 + 2 + 4 + 2  # item ordinals
    assert toy.total_revenue == eur("23.00")  # freight left out, null price skipped
    assert toy.avg_price == 23 / 3
    assert toy.total_orders == 4
    assert got["bare1"].product_category_name is None


def test_presentation_orders(orders, items, products):
    days = [r[0] for r in marts.daily_sales(orders, items).orderBy(*ranking.by_date()).collect()]
    assert days == sorted(days)
    sold = marts.product_performance(orders, items, products).orderBy(*ranking.by_revenue())
    assert [r.product_id for r in sold.collect()] == ["book1", "toy1", "bare1", "bare2"]


def test_customer_without_any_price_has_null_spend(spark, orders, products):
    unpriced = spark.createDataFrame(
        [("o1", 1, "toy1", "s", None, eur("1.00"))],
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "price decimal(10,2), freight_value decimal(10,2)",
    )
    row = marts.customer_metrics(orders, unpriced, products).first()
    assert (row.total_orders, row.total_spent, row.avg_order_value) == (1, None, None)
    day = marts.daily_sales(orders, unpriced).first()
    assert (day.total_orders, day.total_revenue, day.avg_order_value) == (1, None, None)


def test_prices_that_arrive_as_double_are_not_truncated(spark, orders, products):
    doubles = spark.createDataFrame(
        [("o1", 1, "toy1", "s", 1.15, 0.29)],
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "price double, freight_value double",
    )
    assert marts.daily_sales(orders, doubles).first().total_revenue == eur("1.44")
    assert marts.product_performance(orders, doubles, products).first().total_revenue == eur("1.15")


def test_empty_input_gives_empty_marts(orders, items, products):
    none = items.limit(0)
    assert marts.customer_metrics(orders, none, products).count() == 0
    assert marts.daily_sales(orders, none).count() == 0
    assert marts.product_performance(orders, none, products).count() == 0


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_fused_marts_equal_the_plain_composition(spark, broadcast):
    """The one-pass plans against the operators put together as written."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        t = Tables(spark, DATA)
        orders, items, products = t.orders(), t.items_with_gaps(), t.products_with_gaps()
        # some orders have no customer
        known = F.when(F.col("customer_id") % 7 != 0, F.col("customer_id"))
        orders = orders.withColumn("customer_id", known)
        lines = relational.order_lines(relational.delivered(orders, DELIVERED_CODE), items)
        details = relational.line_details(lines, products)
        plain_customers = relational.with_favorite(
            aggregates.customer_totals(aggregates.order_totals(details)),
            ranking.favorite_category(details),
        )
        fused = marts.customer_metrics(orders, items, products, DELIVERED_CODE)
        assert rows(fused, "customer_id") == rows(
            plain_customers.select(*fused.columns), "customer_id"
        )
        plain_days = (
            lines.groupBy(sale_date().alias("sale_date"))
            .agg(
                F.count("order_id").alias("total_orders"),
                money(F.sum(line_amount())).alias("total_revenue"),
                F.count_distinct("customer_id").alias("unique_customers"),
                mean(F.sum(line_amount()), F.count(line_amount())).alias("avg_order_value"),
            )
        )
        assert rows(marts.daily_sales(orders, items, DELIVERED_CODE), "sale_date") == rows(
            plain_days, "sale_date"
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


GOLDEN = {
    "customer_metrics": (145, 484, "109815971.07", 162076),
    "daily_sales": (440, 1995, "109815971.07", 484),
    "product_performance": (200, 8103, "105529153.40", 1980),
}


def test_golden_totals(spark):
    t = Tables(spark, DATA)
    c = marts.customer_metrics(t.orders(), t.items(), t.products(), DELIVERED_CODE)
    d = marts.daily_sales(t.orders(), t.items(), DELIVERED_CODE)
    p = marts.product_performance(t.orders(), t.items(), t.products(), DELIVERED_CODE)
    got = {
        "customer_metrics": c.selectExpr(
            "count(*)", "sum(total_orders)", "sum(total_spent)", "sum(customer_lifetime_days)"
        ),
        "daily_sales": d.selectExpr(
            "count(*)", "sum(total_orders)", "sum(total_revenue)", "sum(unique_customers)"
        ),
        "product_performance": p.selectExpr(
            "count(*)", "sum(total_quantity_sold)", "sum(total_revenue)", "sum(total_orders)"
        ),
    }
    for name, df in got.items():
        a, b, total, e = df.first()
        assert (a, b, total, e) == (*GOLDEN[name][:2], Decimal(GOLDEN[name][2]), GOLDEN[name][3])
