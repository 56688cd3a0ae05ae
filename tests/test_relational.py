from pyspark.sql import functions as F

from ordermill.functions import days_between, line_amount, sale_date
from ordermill.operators import aggregates, ranking, relational
from tests.conftest import day, eur, rows


def test_delivered_is_case_sensitive_and_drops_null(orders):
    kept = {r.order_id for r in relational.delivered(orders).collect()}
    assert kept == {"o1", "o2", "o3", "o4", "o8", "o9"}


def test_rows_with_null(items):
    assert rows(relational.rows_with_null(items, "price").select("order_id"), "order_id") == [
        ("o2",)
    ]


def test_order_lines_drops_orders_without_items_and_orphan_items(orders, items):
    lines = relational.order_lines(relational.delivered(orders), items)
    assert lines.columns.count("order_id") == 1
    found = {r.order_id for r in lines.select("order_id").distinct().collect()}
    assert found == {"o1", "o2", "o3", "o8", "o9"}


def test_unknown_product_drops_the_line(orders, items, products):
    lines = relational.order_lines(relational.delivered(orders), items)
    details = relational.line_details(lines, products)
    assert details.filter("product_id = 'ghost'").count() == 0
    assert lines.count() - details.count() == 2


def test_items_of_keeps_each_item_once_even_with_repeated_order_ids(orders, items):
    twice = relational.delivered(orders).union(relational.delivered(orders))
    assert relational.items_of(twice, items).count() == 11


def test_left_join_keeps_customers_without_favorite(spark):
    metrics = spark.createDataFrame([("ann", 1), ("zoe", 2)], "customer_id string, n int")
    favorites = spark.createDataFrame(
        [("ann", "toys")], "customer_id string, favorite_category string"
    )
    assert rows(relational.with_favorite(metrics, favorites), "customer_id") == [
        ("ann", 1, "toys"),
        ("zoe", 2, None),
    ]


def test_amount_is_null_when_either_part_is(items):
    sums = items.groupBy("order_id").agg(
        F.sum(line_amount()).alias("amount"), F.count(line_amount()).alias("n")
    )
    by_order = {r.order_id: (r.amount, r.n) for r in sums.collect()}
    assert by_order["o1"] == (eur("33.50"), 2)
    assert by_order["o2"] == (None, 0)


def test_dates_follow_the_calendar_not_elapsed_hours(orders):
    two = orders.filter("customer_id = 'ann'").agg(
        F.min("order_purchase_timestamp").alias("first"),
        F.max("order_purchase_timestamp").alias("last"),
    )
    # two minutes apart, across midnight
    assert two.select(days_between("last", "first")).first()[0] == 1
    assert orders.select(sale_date()).distinct().count() == 5


def test_null_category_counts_as_a_group(orders, items, products):
    details = relational.line_details(
        relational.order_lines(relational.delivered(orders), items), products
    )
    counts = {(r[0], r[1]): r[2] for r in aggregates.category_counts(details).collect()}
    assert counts[("bob", None)] == 3
    assert counts[("bob", "toys")] == 1


def test_favorite_breaks_ties_by_name_and_lets_null_win(orders, items, products):
    details = relational.line_details(
        relational.order_lines(relational.delivered(orders), items), products
    )
    favorites = dict(rows(ranking.favorite_category(details), "customer_id"))
    assert favorites == {"ann": "books", "bob": None, "dan": "toys"}


def test_null_category_loses_a_tie(spark):
    details = spark.createDataFrame(
        [("ann", None), ("ann", "toys")], "customer_id string, product_category_name string"
    )
    assert ranking.favorite_category(details).first().favorite_category == "toys"


def test_rank_numbers_all_categories(orders, items, products):
    details = relational.line_details(
        relational.order_lines(relational.delivered(orders), items), products
    )
    ranked = ranking.rank_within(
        aggregates.category_counts(details), ["customer_id"], ranking.category_preference()
    )
    ann = rows(ranked.filter("customer_id = 'ann'").select("rn", "product_category_name"), "rn")
    assert ann == [(1, "books"), (2, "toys")]


def test_top_per_group_takes_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "k string, v int")
    top = ranking.top_per_group(df, ["k"], [F.desc("v")], 2)
    assert rows(top, "k", "v") == [("a", 3), ("a", 4), ("b", 9)]


def test_position_is_dense_over_many_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
    placed = ranking.with_position(df, [F.desc("v")])
    assert rows(placed, "position") == [(999 - i, i + 1) for i in range(1000)]


def test_position_of_nothing(spark):
    assert ranking.with_position(spark.range(0), [F.asc("id")]).count() == 0


def test_order_time_and_total_per_order(orders, items, products):
    details = relational.line_details(
        relational.order_lines(relational.delivered(orders), items), products
    )
    totals = {r.order_id: r for r in aggregates.order_totals(details).collect()}
    assert totals["o8"].order_total == eur("10.00")
    assert totals["o8"].order_time == day("2024-01-05 10:00:00")
    assert "o9" not in totals


def test_row_count(items):
    assert aggregates.row_count(items).first().row_count == 15
