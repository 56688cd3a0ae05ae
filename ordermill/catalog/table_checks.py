"""Sources, sinks and streams. Files are written by Spark from the given tables first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.catalog.mapping import Tables
from ordermill.catalog.quality_checks import NULLS_SQL
from ordermill.catalog.registry import check
from ordermill.contracts import LIVE_ORDERS, LIVE_REJECTS, ORDER_ITEMS, PRODUCTS
from ordermill.operators.quality import conform
from ordermill.plans import increments, jobs
from ordermill.session import scratch_path
from ordermill.sinks.layers import PathLayers
from ordermill.sources.files import read_csv
from ordermill.sources.inference import read_inferred_csv
from ordermill.streaming import live_orders as live


def _csv(df, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


@check(
    "csv_scan_inferred",
    """
SELECT order_id, customer_id, order_status, order_purchase_timestamp FROM t_orders
""",
)
def csv_scan_inferred(t):
    """Types come from the data, so they are widened to one fixed shape at the end."""
    path = _csv(t.orders(), scratch_path(t.spark, "orders-csv"))
    return read_csv(t.spark, path).select(
        F.col("order_id").cast("bigint"),
        F.col("customer_id").cast("bigint"),
        "order_status",
        F.col("order_purchase_timestamp").cast("timestamp_ntz"),
    )


@check(
    "csv_scan_schema",
    """
SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id,
       CAST(product_id AS VARCHAR) AS product_id, CAST(seller_id AS VARCHAR) AS seller_id,
       shipping_limit_date, price, freight_value
FROM t_items_gaps
""",
)
def csv_scan_schema(t):
    path = _csv(t.items_with_gaps(), scratch_path(t.spark, "items-csv"))
    return read_csv(t.spark, path, ORDER_ITEMS.schema).withColumn(
        "shipping_limit_date", F.col("shipping_limit_date").cast("timestamp_ntz")
    )


@check(
    "csv_inferred_types",
    """
, cells AS (
  SELECT unnest(['order_id', 'order_item_id', 'code', 'price', 'freight_value', 'shipping_limit_date', 'mixed']) AS column_name,
         unnest([CAST(order_id AS VARCHAR), CAST(order_item_id AS VARCHAR), '0' || order_item_id,
                 CAST(price AS VARCHAR), CAST(freight_value AS VARCHAR),
                 CASE WHEN order_item_id = 1 THEN CAST(CAST(shipping_limit_date AS DATE) AS VARCHAR)
                      ELSE strftime(shipping_limit_date, '%Y-%m-%d %H:%M:%S') END,
                 CASE WHEN order_item_id = 2 THEN 'n/a' ELSE CAST(order_id AS VARCHAR) END]) AS cell
  FROM t_items_gaps
), kinds AS (
  SELECT *, CASE WHEN regexp_full_match(cell, '-?(0|[1-9][0-9]*)') THEN 'int'
    WHEN regexp_full_match(cell, '-?(0|[1-9][0-9]*)[.][0-9]+') THEN 'decimal'
    WHEN regexp_full_match(cell, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date'
    WHEN regexp_full_match(cell, '[0-9]{4}-[0-9]{2}-[0-9]{2} .*') THEN 'timestamp' ELSE 'string' END AS kind
  FROM cells WHERE cell IS NOT NULL
), found AS (
  SELECT column_name, list(DISTINCT kind) AS kinds, max(length(cell)) FILTER (kind = 'decimal') AS size,
    min(cell) FILTER (kind = 'timestamp') AS a_time, min(cell) FILTER (kind = 'string') AS a_text
  FROM kinds GROUP BY column_name
)
SELECT column_name, CASE WHEN kinds = ['decimal'] THEN 'decimal(' || (size - 1) || ',2)'
    WHEN len(kinds) = 1 THEN kinds[1] WHEN list_contains(kinds, 'string') THEN 'string' ELSE 'timestamp' END AS data_type,
  CASE WHEN len(kinds) > 1 THEN coalesce(a_text, a_time) END AS widening_cell
FROM found
""",
)
def csv_inferred_types(t):
    """Codes keep their zeros, one text makes a column text, dates among times become times."""
    line, shipped = F.col("order_item_id"), F.col("shipping_limit_date")
    path = _csv(
        t.items_with_gaps().select(
            "order_id",
            "order_item_id",
            F.concat(F.lit("0"), line.cast("string")).alias("code"),
            "price",
            "freight_value",
            F.when(line == 1, F.date_format(shipped, "yyyy-MM-dd"))
            .otherwise(F.date_format(shipped, "yyyy-MM-dd HH:mm:ss"))
            .alias("shipping_limit_date"),
            F.when(line == 2, "n/a").otherwise(F.col("order_id").cast("string")).alias("mixed"),
        ),
        scratch_path(t.spark, "untyped-csv"),
    )
    _, account = read_inferred_csv(t.spark, path, "order_items")
    return account.select("column_name", "data_type", "widening_cell")


@check(
    "raw_landing_counts",
    """
SELECT 'customers' AS table_name, count(*) AS row_count FROM t_customers
UNION ALL SELECT 'orders', count(*) FROM t_orders
UNION ALL SELECT 'order_items', count(*) FROM t_items
UNION ALL SELECT 'products', count(*) FROM t_products
""",
)
def raw_landing_counts(t):
    """All raw tables as CSV, landed as typed Parquet; counts taken by the writes."""
    return jobs.landed_counts(t.spark, _land(t))


@check("raw_landing_nulls", f"SELECT * FROM ({NULLS_SQL}) WHERE null_count > 0")
def raw_landing_nulls(t):
    """The null audit that the landing writes take on the way."""
    return jobs.landed_nulls(t.spark, _land(t))


@check(
    "raw_landing_rejects",
    """
SELECT 'order_items' AS table_name, 'price' AS column_name, count(*) AS rejected
FROM t_items WHERE order_item_id IN (5, 6) HAVING count(*) > 0
UNION ALL
SELECT 'products', 'product_weight_g', count(*) FROM t_products WHERE product_weight_g > 40
HAVING count(*) > 0
""",
)
def raw_landing_rejects(t):
    """Cells broken on purpose: prices too wide or no number, weights with a unit."""
    frames = t.contract_frames()
    line, price = F.col("order_item_id"), F.col("price").cast("string")
    weight = F.col("product_weight_g")
    frames["order_items"] = frames["order_items"].withColumn(
        "price", F.when(line == 5, "abc").when(line == 6, "123456789.00").otherwise(price)
    )
    frames["products"] = frames["products"].withColumn(
        "product_weight_g",
        F.when(weight > 40, F.concat(weight.cast("string"), F.lit(" g"))).otherwise(
            weight.cast("string")
        ),
    )
    return jobs.landed_rejects(t.spark, _land(t, frames))


def _land(t: Tables, frames=None):
    root = scratch_path(t.spark, "raw")
    for name, frame in (frames or t.contract_frames()).items():
        _csv(frame, f"{root}/{name}.csv")
    return jobs.land_raw(t.spark, root, PathLayers(scratch_path(t.spark, "landed")))


@check(
    "raw_landing_increment",
    """
SELECT 'customers' AS table_name, count(*) AS row_count, count(*) FILTER (customer_id % 3 = 0) AS last_run
FROM t_customers
UNION ALL SELECT 'orders', count(*), count(*) FILTER (order_id % 3 = 0) FROM t_orders
UNION ALL SELECT 'order_items', count(*), count(*) FILTER (order_id % 3 = 0) FROM t_items
UNION ALL SELECT 'products', count(*), count(*) FILTER (product_id % 3 = 0) FROM t_products
""",
)
def raw_landing_increment(t):
    """Files arrive between two runs; the second run reads and counts the new ones alone."""
    root = scratch_path(t.spark, "raw")
    layers = PathLayers(scratch_path(t.spark, "landed"))
    for run in (1, 2):
        for name, frame in t.contract_frames().items():
            late = F.col(frame.columns[0]) % 3 == 0
            frame.filter(late if run == 2 else ~late).write.option("header", True).csv(
                f"{root}/{name}/{run}"
            )
        report = increments.land_increment(t.spark, root, layers, "{table}/*/part-*")
    last = {r.table: r.written.rows for r in report.landed()}
    counts = [
        r.frame.agg(
            F.lit(r.table).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
        ).withColumn("last_run", F.lit(last[r.table]).cast("bigint"))
        for r in report.landed()
    ]
    return reduce(DataFrame.unionByName, counts)


@check(
    "sink_append_mode",
    """
SELECT product_id, product_category_name FROM t_products_gaps
UNION ALL SELECT product_id, product_category_name FROM t_products_gaps
""",
)
def sink_append_mode(t):
    layers = PathLayers(scratch_path(t.spark, "append"))
    products = conform(t.contract_frames()["products"], PRODUCTS)
    layers.write(products, PRODUCTS, "overwrite")
    layers.write(products, PRODUCTS, "append")
    return layers.read(t.spark, PRODUCTS).select(
        F.col("product_id").cast("bigint"), "product_category_name"
    )


def _as_given(orders):
    """Live orders without the time of processing, identifiers as given."""
    return orders.select(
        F.col("order_id").cast("bigint"),
        F.col("customer_id").cast("bigint"),
        "product_id",
        "order_value",
        F.col("order_timestamp").cast("timestamp_ntz"),
    )


def _appended(t: Tables, orders):
    """Run a live-order stream to the end of the input and return what it appended."""
    out = scratch_path(t.spark, "live")
    live.append_stream(orders, out, scratch_path(t.spark, "live-state")).awaitTermination()
    return _as_given(t.spark.read.parquet(out))


def _event_stream(t: Tables):
    return live.file_stream(t.spark, t.path("events"), t.given("events").schema)


def _replayed(t: Tables):
    """Orders as received where every purchase arrives twice."""
    return t.purchases(_event_stream(t).unionByName(_event_stream(t)))


@check("live_orders", "SELECT * FROM t_purchases")
def live_orders(t):
    return _appended(t, live.live_orders(t.purchases(_event_stream(t))))


@check("live_orders_dedup", "SELECT * FROM t_purchases")
def live_orders_dedup(t):
    """Repeats removed by stream state that keeps every key."""
    return _appended(t, live.unique_orders(live.live_orders(_replayed(t))))


@check("live_orders_dedup_within", "SELECT * FROM t_purchases")
def live_orders_dedup_within(t):
    """Repeats removed by bounded state; the events span 30 days."""
    return _appended(t, live.live_orders(live.unique_orders_within(_replayed(t), "31 days")))


@check(
    "live_orders_absent_times",
    """
SELECT order_id, customer_id, product_id, order_value,
       CASE WHEN customer_id % 5 <> 0 THEN order_timestamp END AS received
FROM t_purchases
""",
)
def live_orders_absent_times(t):
    """Every order once, though some have no time and all come twice, in several batches."""
    time = F.when(F.col("customer_id") % 5 != 0, F.col("order_timestamp"))
    received = t.purchases(t.given("events")).withColumn("order_timestamp", time)
    inbox = scratch_path(t.spark, "live-inbox")
    # by time, so that the first file's absent times would outrun all later files
    received.repartitionByRange(4, "order_id").write.parquet(inbox)
    received.repartitionByRange(3, "order_id").write.mode("append").parquet(inbox)
    stream = live.file_stream(t.spark, inbox, received.schema, max_files=1)
    unique = live.unique_orders_within(stream, "31 days")
    out = scratch_path(t.spark, "live")
    query = live.append_stream(unique, out, scratch_path(t.spark, "live-state"))
    query.awaitTermination()
    got = t.spark.read.schema(received.schema).parquet(out)
    return got.withColumn("received", F.col("order_timestamp").cast("timestamp_ntz")).drop(
        "order_timestamp"
    )


@check("live_orders_upsert", "SELECT * FROM t_purchases")
def live_orders_upsert(t):
    """Repeats removed against the target table, without stream state."""
    layers = PathLayers(scratch_path(t.spark, "live-upsert"))
    state = scratch_path(t.spark, "live-upsert-state")
    live.upsert_stream(_replayed(t), layers, state).awaitTermination()
    return _as_given(layers.read(t.spark, LIVE_ORDERS))


@check(
    "live_orders_redated",
    """
SELECT order_id, customer_id, product_id, order_value,
       CASE WHEN customer_id % 5 <> 0 THEN order_timestamp END AS received
FROM t_purchases
""",
)
def live_orders_redated(t):
    """Orders sent again days later, earlier or without a time: the first ones stay."""
    time, customer = F.col("order_timestamp"), F.col("customer_id")
    received = t.purchases(t.given("events")).withColumn(
        "order_timestamp", F.when(customer % 5 != 0, time)
    )
    again = received.withColumn(
        "order_timestamp",
        F.when(customer % 3 == 0, time + F.expr("INTERVAL 3 DAYS")).when(
            customer % 3 == 1, time - F.expr("INTERVAL 40 DAYS")
        ),
    )
    layers = PathLayers(scratch_path(t.spark, "live-redated"))
    state = scratch_path(t.spark, "live-redated-state")
    inbox = scratch_path(t.spark, "live-redated-inbox")
    for sent in (received, again):
        sent.repartitionByRange(2, "order_id").write.mode("append").parquet(inbox)
        stream = live.file_stream(t.spark, inbox, received.schema, max_files=1)
        live.upsert_stream(stream, layers, state).awaitTermination()
    stored = layers.read(t.spark, LIVE_ORDERS)
    # a day is stored only for orders that came with a time
    shown = F.when(F.col(LIVE_ORDERS.stored_by).isNotNull(), F.col("order_timestamp"))
    return stored.select(
        F.col("order_id").cast("bigint"),
        F.col("customer_id").cast("bigint"),
        "product_id",
        "order_value",
        shown.cast("timestamp_ntz").alias("received"),
    )


@check(
    "live_orders_rejects",
    """
SELECT 'stored' AS outcome, order_id, NULL AS columns FROM t_purchases
WHERE customer_id % 7 NOT IN (0, 1)
UNION ALL
SELECT 'rejected', order_id, CASE customer_id % 7 WHEN 0 THEN 'order_value' ELSE 'order_value,order_timestamp' END
FROM t_purchases WHERE customer_id % 7 IN (0, 1)
""",
)
def live_orders_rejects(t):
    """Orders as text, some with a value too wide or no number and a time that is none."""
    received = t.purchases(t.given("events"))
    kind = F.col("customer_id") % 7
    broken = received.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        "product_id",
        F.when(kind == 0, F.lit("123456789.01"))
        .when(kind == 1, F.lit("n/a"))
        .otherwise(F.col("order_value").cast("string"))
        .alias("order_value"),
        F.when(kind == 1, F.lit("yesterday")).otherwise(F.col("order_timestamp").cast("string")).alias("order_timestamp"),
    )
    inbox = scratch_path(t.spark, "live-text")
    broken.repartitionByRange(2, "order_id").write.parquet(inbox)
    layers = PathLayers(scratch_path(t.spark, "live-rejects"))
    stream = live.file_stream(t.spark, inbox, broken.schema, max_files=1)
    state = scratch_path(t.spark, "live-rejects-state")
    live.upsert_text_stream(stream, "text_orders", layers, state).awaitTermination()
    stored = layers.read(t.spark, LIVE_ORDERS).select(
        F.lit("stored").alias("outcome"),
        F.col("order_id").cast("bigint"),
        F.lit(None).cast("string").alias("columns"),
    )
    rejects = layers.read(t.spark, LIVE_REJECTS).select(
        F.lit("rejected").alias("outcome"),
        F.get_json_object("raw_order", "$.order_id").cast("bigint").alias("order_id"),
        F.array_join("rejected_columns", ",").alias("columns"),
    )
    return stored.union(rejects)
