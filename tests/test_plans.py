"""The plans, and what adaptive execution makes of a hot key."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ordermill.catalog.mapping import DELIVERED_CODE, Tables
from ordermill.operators import quality, ranking, relational
from ordermill.plans import marts
from tests.conftest import ITEM_COLUMNS, ORDER_COLUMNS, PRODUCT_COLUMNS, rows

DATA = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_broadcast(spark):
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1")


def plan(df) -> str:
    """The plan as Spark would start it."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan that adaptive execution ended with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_and_columns_reach_the_scan(spark):
    t = Tables(spark, DATA)
    text = plan(marts.daily_sales(t.orders(), t.items(), DELIVERED_CODE))
    assert f"EqualTo(o_orderstatus,{DELIVERED_CODE})" in text
    assert "l_shipdate" not in text and "l_partkey" not in text
    assert "o_totalprice" not in text


def test_marts_stay_out_of_python(spark):
    t = Tables(spark, DATA)
    for df in (
        marts.customer_metrics(t.orders(), t.items(), t.products(), DELIVERED_CODE),
        marts.daily_sales(t.orders(), t.items(), DELIVERED_CODE),
        marts.product_performance(t.orders(), t.items(), t.products(), DELIVERED_CODE),
    ):
        assert "Python" not in plan(df)


def test_customer_metrics_scans_each_table_once(spark):
    t = Tables(spark, DATA)
    with no_broadcast(spark):
        text = plan(marts.customer_metrics(t.orders(), t.items(), t.products(), DELIVERED_CODE))
    for table in ("orders", "lineitem", "part"):
        assert text.count(f"{DATA}/{table}.parquet") == 1
    # orders and items by order, lines and products by product, then two aggregations
    assert text.count("Exchange hashpartitioning") == 6


def test_daily_sales_joins_lines_and_aggregates_once(spark):
    t = Tables(spark, DATA)
    with no_broadcast(spark):
        text = plan(marts.daily_sales(t.orders(), t.items(), DELIVERED_CODE))
    below_items = text[: text.index("lineitem.parquet")]
    assert "Aggregate" not in below_items[below_items.rindex("Exchange") :]
    # items and orders by order, (day, customer), day
    assert text.count("Exchange hashpartitioning") == 4


def test_product_performance_semi_join_and_shared_partitioning(spark):
    t = Tables(spark, DATA)
    with no_broadcast(spark):
        text = plan(
            marts.product_performance(t.orders(), t.items(), t.products(), DELIVERED_CODE)
        )
    assert "LeftSemi" in text
    # items and orders by order, product aggregates and products by product: the distinct
    # step and the product join reuse those partitionings
    assert text.count("Exchange hashpartitioning") == 4


def test_top_per_group_limits_before_the_shuffle(spark):
    t = Tables(spark, DATA)
    details = relational.line_details(t.items(), t.products())
    top = ranking.top_per_group(
        details, ["product_category_name"], [F.desc("price"), F.asc("order_id")]
    )
    text = plan(top)
    assert text.count("WindowGroupLimit") == 2
    assert "Partial" in text[text.rindex("Exchange hashpartitioning") :]


def test_null_audit_is_one_scan_and_one_aggregate(spark):
    t = Tables(spark, DATA)
    text = plan(quality.null_audit({"items": t.items_with_gaps()}))
    assert text.count("lineitem.parquet") == 1
    assert text.count("Exchange") == 1


def test_orphans_are_counted_per_key_before_the_anti_join(spark):
    t = Tables(spark, DATA)
    with no_broadcast(spark):
        text = plan(quality.orphans(t.items(), "order_id", t.orders(), "order_id", "r"))
    assert "LeftAnti" in text
    assert text.count("Exchange hashpartitioning") == 2
    assert text.index("LeftAnti") < text.index("partial_count")


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """One order, one product and one customer hold a third of all item rows."""
    root = str(tmp_path_factory.mktemp("skew"))
    n = 60_000
    hot = F.col("id") % 3 == 0
    orders = spark.range(n // 10).select(
        F.concat(F.lit("o"), "id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500))
        .alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 40) * 86_400)
        .alias("order_purchase_timestamp"),
    )
    items = spark.range(n).select(
        F.when(hot, "o1").otherwise(F.concat(F.lit("o"), F.col("id") % (n // 10)))
        .alias("order_id"),
        (F.col("id") % 9).cast("int").alias("order_item_id"),
        F.when(hot, "p1").otherwise(F.concat(F.lit("p"), F.col("id") % 800)).alias("product_id"),
        F.lit("s").alias("seller_id"),
        ((F.col("id") % 977) / 10).cast("decimal(10,2)").alias("price"),
        F.lit(1).cast("decimal(10,2)").alias("freight_value"),
    )
    products = spark.range(800).select(
        F.concat(F.lit("p"), "id").alias("product_id"),
        F.concat(F.lit("cat"), F.col("id") % 7).alias("product_category_name"),
    )
    frames = {}
    for name, df, columns in (
        ("orders", orders, ORDER_COLUMNS),
        ("items", items, ITEM_COLUMNS),
        ("products", products, PRODUCT_COLUMNS),
    ):
        df.repartition(8).write.parquet(f"{root}/{name}")
        frames[name] = spark.read.schema(columns).parquet(f"{root}/{name}")
    return frames


def small_skew(spark):
    """Skew limits low enough for a test-sized hot key."""
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )


def test_hot_order_and_product_are_split(spark, skewed):
    orders, items, products = skewed["orders"], skewed["items"], skewed["products"]
    build = {
        "customers": lambda: marts.customer_metrics(orders, items, products),
        "products": lambda: marts.product_performance(orders, items, products),
        "days": lambda: marts.daily_sales(orders, items),
    }
    expected = {k: rows(f(), f().columns[0]) for k, f in build.items()}
    with small_skew(spark):
        for name, make in build.items():
            df = make()
            assert "skew=true" in final_plan(df), name
            assert sorted(tuple(r) for r in df.collect()) == expected[name]


def test_a_plan_does_not_depend_on_what_was_built_before(spark, skewed):
    t = Tables(spark, DATA)
    big = lambda: marts.customer_metrics(**skewed)
    small = lambda: t.orders().groupBy("customer_id").count()

    def shape(df):
        return re.sub(r"#\d+L?|plan_id=\d+|_common_expr_\d+", "", plan(df))

    first, second = shape(big()), shape(small())
    assert (shape(small()), shape(big())) == (second, first)


def test_row_rules_share_one_scan_and_key_counts_serve_twice(spark, tmp_path):
    from ordermill.contracts import ORDER_ITEMS, RAW_TABLES

    frames = {}
    for c in RAW_TABLES:
        spark.createDataFrame([], c.schema).write.parquet(str(tmp_path / c.name))
        frames[c.name] = spark.read.schema(c.schema).parquet(str(tmp_path / c.name))
    rules = plan(quality.row_findings(frames["order_items"], ORDER_ITEMS))
    assert rules.count("FileScan") == 1 and "Exchange" not in rules
    found = quality.contract_findings(frames, RAW_TABLES)
    whole = {"spark__sql__adaptive__enabled": "false", "spark__sql__maxMetadataStringLength": "1000"}
    with settings(spark, **whole):
        text = plan(quality.contract_findings(frames, RAW_TABLES))
    scans = {c.name: text.count(f"/{c.name}]") for c in RAW_TABLES}
    # row rules, key, and for orders the customers they refer to
    assert scans == {"customers": 2, "orders": 3, "order_items": 2, "products": 2}, scans
    assert found.count() == 0


def test_marts_over_tables_stored_by_order_join_without_a_shuffle(spark, tmp_path, orders, items, products):
    from ordermill.contracts import ORDER_ITEMS, ORDERS, PRODUCTS
    from ordermill.sinks.layers import CatalogLayers

    def whole(df, contract):
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in contract.schema if f.name not in df.columns]
        return df.select("*", *missing)

    layers = CatalogLayers(str(tmp_path / "stored"), {"orders": ("order_id", 4), "order_items": ("order_id", 4)})
    frames = [(ORDERS, orders), (ORDER_ITEMS, items), (PRODUCTS, products)]
    for layer in ("raw_data", "staging", "analytics", "streaming"):
        spark.sql(f"DROP SCHEMA IF EXISTS {layer} CASCADE")
    try:
        layers.create(spark, [c for c, _ in frames])
        for contract, frame in frames:
            layers.write(whole(frame, contract), contract)
            layers.write(whole(frame, contract).limit(0), contract, "append")
        stored = [layers.read(spark, c) for c, _ in frames]
        whole_marts = [
            (marts.customer_metrics(*stored), marts.customer_metrics(orders, items, products)),
            (marts.daily_sales(*stored[:2]), marts.daily_sales(orders, items)),
            (marts.product_performance(*stored), marts.product_performance(orders, items, products)),
        ]
        with no_broadcast(spark), settings(spark, spark__sql__adaptive__enabled="false"):
            for mart, expected in whole_marts:
                text = plan(mart)
                dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
                assert not any(re.fullmatch(r"order_id#\d+, 4", d) for d in dealt), dealt
                assert "Bucketed: true" in text
                key = mart.columns[0]
                assert rows(mart, key) == rows(expected, key)
    finally:
        for layer in ("raw_data", "staging", "analytics", "streaming"):
            spark.sql(f"DROP SCHEMA IF EXISTS {layer} CASCADE")
