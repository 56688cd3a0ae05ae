from decimal import Decimal

import pytest
from pyspark.sql.types import DecimalType

from ordermill.contracts import CUSTOMERS, LIVE_ORDERS, ORDER_ITEMS, PRODUCT_PERFORMANCE
from ordermill.operators import quality
from tests.conftest import day, rows


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame([("a", None), ("b", 2), (None, None)], "k string, v int")


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame([("a", 1)], "k string, v int")


def test_null_audit_reports_columns_above_zero(dirty, clean):
    found = quality.null_audit({"dirty": dirty, "clean": clean})
    assert rows(found, "column_name") == [("dirty", "k", 1), ("dirty", "v", 2)]


def test_null_verdict(dirty, clean):
    verdict = quality.null_verdict({"dirty": dirty, "clean": clean})
    assert rows(verdict, "table_name") == [("clean", False, 0), ("dirty", True, 2)]


def test_null_audit_of_an_empty_table(clean):
    assert quality.null_audit({"empty": clean.limit(0)}).count() == 0


def test_null_audit_accepts_awkward_column_names(spark):
    df = spark.createDataFrame([(None, 1)], "`a.b` string, `c d` int")
    assert rows(quality.null_audit({"t": df}), "column_name") == [("t", "a.b", 1)]


def test_key_violations_report_duplicates_and_nulls(spark):
    df = spark.createDataFrame(
        [("o1", 1), ("o1", 1), ("o1", 2), (None, 1), (None, 1)],
        "order_id string, order_item_id int",
    )
    found = quality.key_violations(df, "order_items", ORDER_ITEMS.primary_key)
    assert rows(found, "key_value") == [
        ("order_items", '["o1","1"]', "duplicate", 2),
        ("order_items", '[null,"1"]', "null", 2),
    ]


def test_single_null_key_is_a_violation(spark):
    df = spark.createDataFrame([(None,), ("a",)], "customer_id string")
    found = quality.key_violations(df, "customers", CUSTOMERS.primary_key)
    assert rows(found, "key_value") == [("customers", None, "null", 1)]


def test_orphans_allow_null_references(spark):
    child = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "ref string")
    parent = spark.createDataFrame([("x",)], "id string")
    found = quality.orphans(child, "ref", parent, "id", "child.ref->parent.id")
    assert rows(found, "key_value") == [("child.ref->parent.id", "y", 2)]


def test_length_violations_use_declared_limits(spark):
    df = spark.createDataFrame(
        [("c1", "ABC"), ("c2", "AB"), ("c3", None)], "customer_id string, customer_state string"
    )
    limits = {"customer_state": CUSTOMERS.max_lengths["customer_state"]}
    found = quality.length_violations(df, "customers", ["customer_id"], limits)
    assert rows(found, "key_value") == [("customers", "c1", "customer_state", 2, 3)]


def test_decimal_violations(spark):
    df = spark.createDataFrame(
        [("a", 123456789.0), ("b", 99999999.99), ("c", 99999999.999), ("d", None)],
        "id string, price double",
    )
    types = {"price": ORDER_ITEMS.decimals["price"]}
    found = quality.decimal_violations(df, "order_items", ["id"], types)
    assert [r[1] for r in rows(found, "key_value")] == ["a", "c"]  # c rounds over the edge
    assert found.first().declared_type == "decimal(10,2)"


def test_conform_renames_casts_and_stamps(spark):
    mart = spark.createDataFrame(
        [("p1", "toys", 3, Decimal("10.00"), 2.675, 1)],
        "product_id string, product_category_name string, total_quantity_sold bigint, "
        "total_revenue decimal(15,2), avg_price double, total_orders bigint",
    )
    shaped = quality.conform(mart, PRODUCT_PERFORMANCE)
    assert [(f.name, f.dataType) for f in shaped.schema] == [
        (f.name, f.dataType) for f in PRODUCT_PERFORMANCE.schema
    ]
    row = shaped.first()
    assert row.product_category == "toys"
    assert row.avg_price == Decimal("2.68")  # half up on the decimal digits
    assert row.updated_at is not None


def test_conform_rejects_a_frame_without_a_declared_column(spark):
    with pytest.raises(ValueError, match="product_category"):
        quality.conform(spark.createDataFrame([("p",)], "product_id string"), PRODUCT_PERFORMANCE)


def test_conform_fills_absent_times_only(spark):
    df = spark.createDataFrame(
        [("a", "c", "p", 1.005, None), ("b", "c", "p", 2.0, day("2024-01-01"))],
        "order_id string, customer_id string, product_id string, order_value double, "
        "order_timestamp timestamp",
    )
    a, b = quality.conform(df, LIVE_ORDERS).orderBy("order_id").collect()
    assert a.order_timestamp == a.processed_at
    assert b.order_timestamp == day("2024-01-01") != b.processed_at
    assert a.order_value == Decimal("1.01")


def test_contract_decimals():
    assert ORDER_ITEMS.decimals == {
        "price": DecimalType(10, 2),
        "freight_value": DecimalType(10, 2),
    }
