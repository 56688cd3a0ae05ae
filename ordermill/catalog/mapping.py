"""The given tables in the shape of the raw contracts, in Spark and in check SQL.

Identifiers stay bigint and purchase times stay timestamp_ntz, as given. Contract columns
without a counterpart appear only in ``contract_frames``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ordermill.contracts import RAW_TABLES

# Status code that stands for a delivered order in the given tables.
DELIVERED_CODE = "F"


class Tables:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        # only the first read of a table in a query runs a job for its footer
        self._schemas: dict[str, StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def given(self, name: str) -> DataFrame:
        path = self.path(name)
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def customers(self) -> DataFrame:
        nations = self.given("nation").select("n_nationkey", "n_name")
        return (
            self.given("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_unique_id"),
                F.col("c_nationkey").alias("customer_zip_code_prefix"),
                F.col("n_name").alias("customer_city"),
            )
        )

    def orders(self) -> DataFrame:
        return self.given("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        )

    def items(self) -> DataFrame:
        return self._items(self._freight())

    def items_with_gaps(self) -> DataFrame:
        """Items whose seventh line has no freight value."""
        return self._items(F.when(F.col("l_linenumber") != 7, self._freight()))

    def products(self) -> DataFrame:
        return self._products(F.col("p_type"))

    def products_with_gaps(self) -> DataFrame:
        """Products whose PROMO category is unknown."""
        return self._products(F.nullif(F.col("p_type"), F.lit("PROMO")))

    def purchases(self, events: DataFrame) -> DataFrame:
        """Incoming live orders out of the event table or stream."""
        return events.filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            F.get_json_object("props", "$.k").alias("product_id"),
            F.col("value").cast("decimal(12,4)").cast("decimal(10,2)").alias("order_value"),
            F.col("ts").cast("timestamp").alias("order_timestamp"),
        )

    def contract_frames(self) -> dict[str, DataFrame]:
        """All raw tables with every contract column; those without counterpart are null."""
        mapped = {
            "customers": self.customers(),
            "orders": self.orders(),
            "order_items": self.items_with_gaps(),
            "products": self.products_with_gaps(),
        }
        return {
            c.name: mapped[c.name].select(
                *[
                    F.col(f.name)
                    if f.name in mapped[c.name].columns
                    else F.lit(None).cast(f.dataType).alias(f.name)
                    for f in c.schema.fields
                ]
            )
            for c in RAW_TABLES
        }

    @staticmethod
    def _price() -> Column:
        return F.col("l_extendedprice").cast("decimal(10,2)")

    def _freight(self) -> Column:
        return (self._price() * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(10,2)")

    def _items(self, freight: Column) -> DataFrame:
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            self._price().alias("price"),
            freight.alias("freight_value"),
        )

    def _products(self, category: Column) -> DataFrame:
        return self.given("part").select(
            F.col("p_partkey").alias("product_id"),
            category.alias("product_category_name"),
            F.col("p_size").alias("product_weight_g"),
        )


# The same mapping as common table expressions for the check SQL.
MAPPED_SQL = """
WITH t_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
         c_nationkey AS customer_zip_code_prefix, n_name AS customer_city
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), t_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp
  FROM orders
), t_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(4,2))
              AS DECIMAL(10,2)) AS freight_value
  FROM lineitem
), t_items_gaps AS (
  SELECT * REPLACE (CASE WHEN order_item_id = 7 THEN NULL ELSE freight_value END
                    AS freight_value)
  FROM t_items
), t_products AS (
  SELECT p_partkey AS product_id, p_type AS product_category_name,
         p_size AS product_weight_g
  FROM part
), t_products_gaps AS (
  SELECT * REPLACE (NULLIF(product_category_name, 'PROMO') AS product_category_name)
  FROM t_products
), t_delivered AS (
  SELECT * FROM t_orders WHERE order_status = 'F'
), t_lines AS (
  SELECT * FROM t_delivered JOIN t_items USING (order_id)
), t_details AS (
  SELECT * FROM t_lines JOIN t_products USING (product_id)
), t_purchases AS (
  SELECT event_id AS order_id, user_id AS customer_id,
         json_extract_string(props, '$.k') AS product_id,
         CAST(CAST(value AS DECIMAL(12,4)) AS DECIMAL(10,2)) AS order_value,
         ts AS order_timestamp
  FROM events WHERE event_type = 'purchase'
)
""".strip()
