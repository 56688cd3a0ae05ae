"""Data-quality rules over the mapped tables."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from ordermill.catalog.mapping import DELIVERED_CODE
from ordermill.catalog.registry import check
from ordermill.contracts import ORDERS, RAW_TABLES
from ordermill.operators import carried_keys, quality, relational
from ordermill.session import scratch_path
from ordermill.sinks.layers import PathLayers

# Contract columns that the given tables have no counterpart for: null in every row.
_ABSENT = {
    "customers": ("t_customers", ["customer_state"]),
    "orders": (
        "t_orders",
        [
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ],
    ),
    "products": (
        "t_products",
        [
            "product_name_length",
            "product_description_length",
            "product_photos_qty",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        ],
    ),
}
NULLS_SQL = " UNION ALL ".join(
    [
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS null_count"
        f" FROM {source}"
        for table, (source, columns) in _ABSENT.items()
        for column in columns
    ]
    + [
        "SELECT 'order_items', 'freight_value', count(*) FROM t_items_gaps"
        " WHERE freight_value IS NULL",
        "SELECT 'products', 'product_category_name', count(*) FROM t_products_gaps"
        " WHERE product_category_name IS NULL",
    ]
)


@check("null_audit", f"SELECT * FROM ({NULLS_SQL}) WHERE null_count > 0")
def null_audit(t):
    return quality.null_audit(t.contract_frames())


@check(
    "null_verdict",
    f"""
SELECT table_name, count_if(null_count > 0) > 0 AS has_nulls,
       CAST(count_if(null_count > 0) AS BIGINT) AS null_columns
FROM ({NULLS_SQL} UNION ALL SELECT 'part', 'p_name', count(*) FROM part WHERE p_name IS NULL)
GROUP BY table_name
""",
)
def null_verdict(t):
    """The mapped raw tables, and one given table that is clean."""
    return quality.null_verdict({**t.contract_frames(), "part": t.given("part")})


_PK_SQL = """
SELECT 'customers' AS table_name, CAST(customer_id AS VARCHAR) AS key_value,
       'duplicate' AS problem, count(*) AS row_count
FROM t_customers GROUP BY customer_id HAVING count(*) > 1
UNION ALL
SELECT 'orders', CAST(order_id AS VARCHAR), 'duplicate', count(*)
FROM t_orders GROUP BY order_id HAVING count(*) > 1
UNION ALL
SELECT 'order_items', '["' || CAST(order_id AS VARCHAR) || '","' || CAST(order_item_id AS VARCHAR) || '"]',
       'duplicate', count(*)
FROM t_items GROUP BY order_id, order_item_id HAVING count(*) > 1
UNION ALL
SELECT 'products', CAST(product_id AS VARCHAR), 'duplicate', count(*)
FROM t_products GROUP BY product_id HAVING count(*) > 1
"""


@check("pk_violations", _PK_SQL)
def pk_violations(t):
    return quality.primary_key_violations(t.contract_frames(), RAW_TABLES)


@check(
    "fk_violations",
    """
SELECT 'orders.customer_id->customers.customer_id' AS rule,
       CAST(customer_id AS VARCHAR) AS key_value, count(*) AS orphan_rows
FROM t_orders WHERE customer_id NOT IN (SELECT customer_id FROM t_customers)
GROUP BY customer_id
UNION ALL
SELECT 'order_items.order_id->orders.order_id', CAST(order_id AS VARCHAR), count(*)
FROM t_items WHERE order_id NOT IN (SELECT order_id FROM t_orders) GROUP BY order_id
UNION ALL
SELECT 'order_items.order_id->delivered.order_id', CAST(order_id AS VARCHAR), count(*)
FROM t_items WHERE order_id NOT IN (SELECT order_id FROM t_delivered) GROUP BY order_id
""",
)
def fk_violations(t):
    """The declared references, which hold, and items against delivered orders, which do not."""
    undelivered = quality.orphans(
        t.items(),
        "order_id",
        relational.delivered(t.orders(), DELIVERED_CODE),
        "order_id",
        "order_items.order_id->delivered.order_id",
    )
    declared = quality.foreign_key_violations(t.contract_frames(), RAW_TABLES)
    return declared.unionByName(undelivered)


@check(
    "length_violations",
    """
SELECT 'customers' AS table_name, CAST(customer_id AS VARCHAR) AS key_value,
       'customer_city' AS column_name, 8 AS max_length,
       CAST(length(customer_city) AS INTEGER) AS actual_length
FROM t_customers WHERE length(customer_city) > 8
UNION ALL
SELECT 'orders', CAST(order_id AS VARCHAR), 'customer_id', 3,
       CAST(length(CAST(customer_id AS VARCHAR)) AS INTEGER)
FROM t_orders WHERE length(CAST(customer_id AS VARCHAR)) > 3
UNION ALL
SELECT 'orders', CAST(order_id AS VARCHAR), 'order_status', 0,
       CAST(length(order_status) AS INTEGER)
FROM t_orders WHERE length(order_status) > 0
UNION ALL
SELECT 'order_items', '["' || CAST(order_id AS VARCHAR) || '","' || CAST(order_item_id AS VARCHAR) || '"]',
       'product_id', 2, CAST(length(CAST(product_id AS VARCHAR)) AS INTEGER)
FROM t_items WHERE length(CAST(product_id AS VARCHAR)) > 2
UNION ALL
SELECT 'products', CAST(product_id AS VARCHAR), 'product_category_name', 5,
       CAST(length(product_category_name) AS INTEGER)
FROM t_products_gaps WHERE length(product_category_name) > 5
""",
)
def length_violations(t):
    """All four raw tables; limits below the declared ones, so that the given tables break them."""
    limits = {
        "customers": {"customer_city": 8},
        "orders": {"customer_id": 3, "order_status": 0},
        "order_items": {"product_id": 2},
        "products": {"product_category_name": 5},
    }
    found = [
        quality.length_violations(
            t.contract_frames()[c.name],
            c.name,
            c.primary_key,
            {**c.max_lengths, **limits[c.name]},
        )
        for c in RAW_TABLES
    ]
    return reduce(DataFrame.unionByName, found)


@check(
    "decimal_overflow",
    """
SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS key_value,
       'o_totalprice' AS column_name, 'decimal(7,2)' AS declared_type, CAST(o_totalprice AS VARCHAR) AS value
FROM orders WHERE o_totalprice IS NOT NULL AND TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL
""",
)
def decimal_overflow(t):
    return quality.decimal_violations(
        t.given("orders"), "orders", ["o_orderkey"], {"o_totalprice": DecimalType(7, 2)}
    )


@check(
    "item_decimal_overflow",
    """
SELECT 'order_items' AS table_name,
       '["' || CAST(order_id AS VARCHAR) || '","' || CAST(order_item_id AS VARCHAR) || '"]' AS key_value,
       column_name, declared_type, value
FROM (
  SELECT order_id, order_item_id, 'price' AS column_name, 'decimal(6,2)' AS declared_type,
         CAST(price AS VARCHAR) AS value FROM t_items_gaps WHERE abs(price) >= 10000
  UNION ALL
  SELECT order_id, order_item_id, 'freight_value', 'decimal(5,2)', CAST(freight_value AS VARCHAR)
  FROM t_items_gaps WHERE abs(freight_value) >= 1000
)
""",
)
def item_decimal_overflow(t):
    """The decimals that order_items declares, with fewer digits than declared."""
    return quality.decimal_violations(
        t.items_with_gaps(),
        "order_items",
        ["order_id", "order_item_id"],
        {"price": DecimalType(6, 2), "freight_value": DecimalType(5, 2)},
    )


@check(
    "contract_findings",
    """
SELECT 'length' AS rule, 'orders' AS table_name, CAST(order_id AS VARCHAR) AS key_value,
       'order_status' AS column_name, '1 > 0' AS problem, 1::BIGINT AS row_count
FROM t_orders WHERE length(order_status) > 0
UNION ALL
SELECT 'primary_key', 'orders', CAST(order_id AS VARCHAR), NULL, 'duplicate', 2
FROM t_orders WHERE order_status = 'P'
UNION ALL
SELECT 'foreign_key', 'orders', CAST(customer_id AS VARCHAR), 'customer_id',
       'orders.customer_id->customers.customer_id',
       sum(CASE WHEN order_status = 'P' THEN 2 ELSE 1 END)::BIGINT
FROM t_orders WHERE customer_id % 10 = 0 GROUP BY customer_id
UNION ALL
SELECT 'length', 'orders', CAST(order_id AS VARCHAR), 'order_status', '1 > 0', 1
FROM t_orders WHERE order_status = 'P'
UNION ALL
SELECT 'primary_key', 'order_items',
       '["' || CAST(order_id AS VARCHAR) || '","' || CAST(order_item_id AS VARCHAR) || '"]',
       NULL, 'duplicate', count(*)
FROM t_items GROUP BY order_id, order_item_id HAVING count(*) > 1
""",
)
def contract_findings(t):
    """All rules in one report, over orders broken on purpose: pending ones twice, every tenth
    customer unknown, and no room for a status."""
    frames = t.contract_frames()
    frames["orders"] = frames["orders"].union(frames["orders"].filter("order_status = 'P'"))
    frames["customers"] = frames["customers"].filter("customer_id % 10 <> 0")
    fields = [
        StructField(f.name, f.dataType, True, {"max_length": 0}) if f.name == "order_status" else f
        for f in ORDERS.schema
    ]
    orders = dataclasses.replace(ORDERS, schema=StructType(fields))
    contracts = [orders if c.name == "orders" else c for c in RAW_TABLES]
    return quality.contract_findings(frames, contracts)


def _noted(t):
    """Key counts of three landings; the second one is landed twice."""
    target = PathLayers(scratch_path(t.spark, "keys"))
    for batch in (0, 1, 1, 2):
        frames = {
            name: frame.filter(F.abs(F.xxhash64(*frame.columns[:2])) % 3 == batch)
            for name, frame in t.contract_frames().items()
        }
        carried_keys.note_keys(f"b{batch}", frames, RAW_TABLES, target)
    return target


@check("pk_violations_increment", _PK_SQL)
def pk_violations_increment(t):
    """Rows land in three batches; keys are checked against stored counts."""
    return carried_keys.key_problems(t.spark, _noted(t))


@check(
    "fk_violations_increment",
    """
SELECT 'orders.customer_id->customers.customer_id' AS rule, CAST(customer_id AS VARCHAR) AS key_value,
       count(*) AS orphan_rows
FROM t_orders WHERE customer_id % 10 = 0 GROUP BY customer_id
""",
)
def fk_violations_increment(t):
    """Orders land before their customers, of which every tenth never comes."""
    target = PathLayers(scratch_path(t.spark, "keys"))
    frames = t.contract_frames()
    late = {"customers": frames["customers"].filter("customer_id % 10 <> 0"), "products": frames["products"]}
    first = {name: frames[name] for name in ("orders", "order_items")}
    for batch, landed in (("first", first), ("late", late)):
        carried_keys.note_keys(batch, landed, RAW_TABLES, target)
    return carried_keys.missing_parents(t.spark, target)
