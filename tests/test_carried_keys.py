"""Key rules against stored counts, and distinct counts by bitmaps."""

from pyspark.sql import functions as F

from ordermill.contracts import CUSTOMERS, KEY_COUNTS, ORDER_ITEMS, ORDERS
from ordermill.operators import bitmaps, carried_keys
from ordermill.operators.quality import foreign_key_violations, primary_key_violations
from ordermill.sinks.layers import PathLayers
from tests.conftest import rows

CONTRACTS = (CUSTOMERS, ORDERS, ORDER_ITEMS)


def _orders(spark, *pairs):
    return spark.createDataFrame(list(pairs), "order_id string, customer_id string")


def _items(spark, *pairs):
    return spark.createDataFrame(list(pairs), "order_id string, order_item_id int")


def _customers(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "customer_id string")


def test_a_landing_is_checked_against_all_keys_before_it(spark, tmp_path):
    target = PathLayers(str(tmp_path))
    landings = {
        "a": {"customers": _customers(spark, "c1", "c2", "c2"), "orders": _orders(spark, ("o1", "c1"), ("o2", "c9"))},
        "b": {"orders": _orders(spark, ("o1", "c2"), ("o3", None), (None, "c1")), "customers": _customers(spark, "c3"),
              "order_items": _items(spark, ("o1", 1), ("o9", 1), ("o9", 2), ("o1", None))},
    }
    for name, frames in landings.items():
        carried_keys.note_keys(name, frames, CONTRACTS, target)
    own = rows(carried_keys.key_problems(spark, target, "b"), "table_name", "key_value")
    assert own == [
        ("order_items", '["o1",null]', "null", 1),
        ("orders", None, "null", 1),
        ("orders", "o1", "duplicate", 2),
    ]
    whole = {
        "customers": landings["a"]["customers"].union(landings["b"]["customers"]),
        "orders": landings["a"]["orders"].union(landings["b"]["orders"]),
        "order_items": landings["b"]["order_items"],
    }
    everything = primary_key_violations(whole, CONTRACTS)
    order = ("table_name", "key_value")
    assert rows(carried_keys.key_problems(spark, target), *order) == rows(everything, *order)
    orphans = foreign_key_violations(whole, CONTRACTS)
    order = ("rule", "key_value")
    assert rows(carried_keys.missing_parents(spark, target), *order) == rows(orphans, *order)
    assert [r[1] for r in rows(carried_keys.missing_parents(spark, target, "b"), *order)] == ["o9"]
    # landed again, a batch counts once
    carried_keys.note_keys("b", landings["b"], CONTRACTS, target)
    assert rows(carried_keys.key_problems(spark, target, "b"), "table_name", "key_value") == own


def test_a_landing_looks_its_own_keys_up(spark, tmp_path):
    target = PathLayers(str(tmp_path))
    carried_keys.note_keys("a", {"customers": _customers(spark, "c1")}, CONTRACTS, target)
    files = carried_keys.key_problems(spark, target, "a").inputFiles()
    assert files and all(f"/{KEY_COUNTS.name}/" in f for f in files)


def test_bitmaps_merge_to_exact_counts(spark):
    seen = spark.createDataFrame(
        [("d1", 1), ("d1", 1), ("d1", 40_000), ("d2", 1), ("d2", -5), ("d2", None), ("d3", None), (None, 7)],
        "day string, customer bigint",
    )
    first = bitmaps.member_bitmaps(seen, ["day"], "customer")
    assert rows(bitmaps.members(first, ["day"], "n"), "day") == [(None, 1), ("d1", 2), ("d2", 2)]
    twice = bitmaps.merge_bitmaps(first.union(first), ["day"])
    assert rows(bitmaps.members(twice, ["day"], "n"), "day") == [(None, 1), ("d1", 2), ("d2", 2)]
    total = bitmaps.merge_bitmaps(first, [F.lit("all").alias("day")])
    assert rows(bitmaps.members(total, ["day"], "n"), "day") == [("all", 4)]


def test_dense_numbers_are_kept_and_follow_on(spark):
    first = bitmaps.dense_numbers(_customers(spark, "b", "a", "b", None), "customer_id")
    assert rows(first, "customer_id") == [("a", 1), ("b", 2)]
    more = bitmaps.dense_numbers(_customers(spark, "0", "b", "z"), "customer_id", first)
    assert rows(more, "customer_id") == [("0", 3), ("a", 1), ("b", 2), ("z", 4)]
