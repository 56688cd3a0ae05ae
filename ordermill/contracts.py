"""Table contracts: layer, columns, keys and limits of every table.

Column names, types, lengths and keys are fixed values of the data model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

RAW, STAGING, ANALYTICS, STREAMING = "raw_data", "staging", "analytics", "streaming"
LAYERS = (RAW, STAGING, ANALYTICS, STREAMING)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableContract:
    """One table: where it lives, what it holds and which rules its rows keep."""

    name: str
    layer: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    # computed column name -> declared column name
    renames: dict[str, str] = field(default_factory=dict)
    # columns that default to the time of writing
    stamped: tuple[str, ...] = ()
    # an added column that Parquet layers keep the table's folders by
    stored_by: str | None = None
    # columns that single rows are looked up by; Parquet layers keep Bloom filters of them
    looked_up: tuple[str, ...] = ()

    @property
    def qualified_name(self) -> str:
        return f"{self.layer}.{self.name}"

    @property
    def max_lengths(self) -> dict[str, int]:
        return {
            f.name: f.metadata["max_length"]
            for f in self.schema.fields
            if "max_length" in f.metadata
        }

    @property
    def decimals(self) -> dict[str, T.DecimalType]:
        return {
            f.name: f.dataType
            for f in self.schema.fields
            if isinstance(f.dataType, T.DecimalType)
        }


def _text(name: str, length: int = 255) -> T.StructField:
    return T.StructField(name, T.StringType(), True, {"max_length": length})


def _whole(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def _count(name: str) -> T.StructField:
    """A count: bigint at rest, as a hot product outgrows INTEGER; the database declares INTEGER."""
    return T.StructField(name, T.LongType(), True, {"database_type": "INTEGER"})


def _money(name: str, precision: int) -> T.StructField:
    return T.StructField(name, T.DecimalType(precision, 2))


def _time(name: str) -> T.StructField:
    return T.StructField(name, T.TimestampType())


def _day(name: str) -> T.StructField:
    return T.StructField(name, T.DateType())


CUSTOMERS = TableContract(
    name="customers",
    layer=RAW,
    schema=T.StructType(
        [
            _text("customer_id"),
            _text("customer_unique_id"),
            _whole("customer_zip_code_prefix"),
            _text("customer_city"),
            _text("customer_state", 2),
        ]
    ),
    primary_key=("customer_id",),
)

ORDERS = TableContract(
    name="orders",
    layer=RAW,
    schema=T.StructType(
        [
            _text("order_id"),
            _text("customer_id"),
            _text("order_status", 50),
            _time("order_purchase_timestamp"),
            _time("order_approved_at"),
            _time("order_delivered_carrier_date"),
            _time("order_delivered_customer_date"),
            _time("order_estimated_delivery_date"),
        ]
    ),
    primary_key=("order_id",),
    foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
)

ORDER_ITEMS = TableContract(
    name="order_items",
    layer=RAW,
    schema=T.StructType(
        [
            _text("order_id"),
            _whole("order_item_id"),
            _text("product_id"),
            _text("seller_id"),
            _time("shipping_limit_date"),
            _money("price", 10),
            _money("freight_value", 10),
        ]
    ),
    primary_key=("order_id", "order_item_id"),
    foreign_keys=(ForeignKey("order_id", "orders", "order_id"),),
)

PRODUCTS = TableContract(
    name="products",
    layer=RAW,
    schema=T.StructType(
        [
            _text("product_id"),
            _text("product_category_name"),
            _whole("product_name_length"),
            _whole("product_description_length"),
            _whole("product_photos_qty"),
            _whole("product_weight_g"),
            _whole("product_length_cm"),
            _whole("product_height_cm"),
            _whole("product_width_cm"),
        ]
    ),
    primary_key=("product_id",),
)

CUSTOMER_METRICS = TableContract(
    name="customer_metrics",
    layer=STAGING,
    schema=T.StructType(
        [
            _text("customer_id"),
            _count("total_orders"),
            _money("total_spent", 15),
            _money("avg_order_value", 12),
            _day("first_order_date"),
            _day("last_order_date"),
            _whole("customer_lifetime_days"),
            _text("favorite_category"),
            _time("updated_at"),
        ]
    ),
    primary_key=("customer_id",),
    stamped=("updated_at",),
)

DAILY_SALES = TableContract(
    name="daily_sales",
    layer=ANALYTICS,
    schema=T.StructType(
        [
            _day("sale_date"),
            _count("total_orders"),
            _money("total_revenue", 15),
            _count("unique_customers"),
            _money("avg_order_value", 12),
            _time("updated_at"),
        ]
    ),
    primary_key=("sale_date",),
    stamped=("updated_at",),
)

PRODUCT_PERFORMANCE = TableContract(
    name="product_performance",
    layer=ANALYTICS,
    schema=T.StructType(
        [
            _text("product_id"),
            _text("product_category"),
            _count("total_quantity_sold"),
            _money("total_revenue", 15),
            _money("avg_price", 10),
            _count("total_orders"),
            _time("updated_at"),
        ]
    ),
    primary_key=("product_id",),
    renames={"product_category_name": "product_category"},
    stamped=("updated_at",),
)

LIVE_ORDERS = TableContract(
    name="live_orders",
    layer=STREAMING,
    schema=T.StructType(
        [
            _text("order_id"),
            _text("customer_id"),
            _text("product_id"),
            _money("order_value", 10),
            _time("order_timestamp"),
            _time("processed_at"),
        ]
    ),
    primary_key=("order_id",),
    stamped=("order_timestamp", "processed_at"),
    stored_by="order_date",
    looked_up=("order_id",),
)

REJECTS = TableContract(
    name="rejects",
    layer=RAW,
    schema=T.StructType(
        [
            _text("table_name"),
            T.StructField(
                "rejected_columns", T.ArrayType(T.StringType()), True, {"database_type": "STRING"}
            ),
            T.StructField("broken_line", T.BooleanType()),
            T.StructField("raw_text", T.StringType()),
        ]
    ),
    primary_key=(),
)

LANDED_FILES = TableContract(
    name="landed_files",
    layer=RAW,
    schema=T.StructType(
        [
            T.StructField("batch", T.StringType()),
            _text("table_name"),
            T.StructField("path", T.StringType()),
            T.StructField("length", T.LongType()),
            _time("modified"),
            T.StructField("done", T.BooleanType()),
        ]
    ),
    primary_key=(),
)

KEY_COUNTS = TableContract(
    name="key_counts",
    layer=RAW,
    schema=T.StructType(
        [
            T.StructField("rule", T.StringType()),
            T.StructField("key_value", T.StringType()),
            T.StructField("has_null", T.BooleanType()),
            T.StructField("row_count", T.LongType()),
        ]
    ),
    primary_key=(),
    looked_up=("key_value",),
)

LIVE_REJECTS = TableContract(
    name="live_rejects",
    layer=STREAMING,
    schema=T.StructType(
        [
            T.StructField("raw_order", T.StringType()),
            T.StructField(
                "rejected_columns", T.ArrayType(T.StringType()), True, {"database_type": "STRING"}
            ),
            _time("rejected_at"),
        ]
    ),
    primary_key=(),
)

# partial aggregates that marts are carried on from; its rows are of several kinds
MART_STATE = TableContract(
    name="mart_state",
    layer=STAGING,
    schema=T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("batch", T.StringType()),
            _text("customer_id"),
            _text("order_id"),
            _text("product_id"),
            _text("category"),
            _day("sale_date"),
            _time("order_time"),
            _whole("order_item_id"),
            _money("price", 10),
            _money("freight_value", 10),
            *(T.StructField(c, T.LongType()) for c in ("line_count", "cents", "priced", "quantity")),
        ]
    ),
    primary_key=(),
    stored_by="kind",
)

FINDINGS = TableContract(
    name="findings",
    layer=RAW,
    schema=T.StructType(
        [
            _text("rule"),
            _text("table_name"),
            T.StructField("key_value", T.StringType()),
            T.StructField("column_name", T.StringType()),
            T.StructField("problem", T.StringType()),
            T.StructField("row_count", T.LongType()),
        ]
    ),
    primary_key=(),
)

RAW_TABLES = (CUSTOMERS, ORDERS, ORDER_ITEMS, PRODUCTS)
MART_TABLES = (CUSTOMER_METRICS, DAILY_SALES, PRODUCT_PERFORMANCE)
# raw tables that another one refers to, which a database can neither drop nor truncate
REFERENCED = {fk.parent for c in RAW_TABLES for fk in c.foreign_keys}
CONTRACTS = {c.name: c for c in (*RAW_TABLES, *MART_TABLES, LIVE_ORDERS)}
