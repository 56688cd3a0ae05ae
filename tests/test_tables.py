import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, TimestampType

from ordermill.contracts import (
    CONTRACTS,
    CUSTOMERS,
    DAILY_SALES,
    LAYERS,
    ORDER_ITEMS,
    PRODUCT_PERFORMANCE,
    PRODUCTS,
    RAW_TABLES,
    REFERENCED,
    REJECTS,
)
from ordermill.operators.quality import conform, null_audit
from ordermill.plans import jobs
from ordermill.sinks.append import append_missing
from ordermill.sinks.jdbc import JdbcLayers, as_declared, column_types
from ordermill.sinks.layers import CatalogLayers, PathLayers
from ordermill.sources.files import path_exists, read_csv
from ordermill.sources.jdbc import JdbcConnection, RangeSplit, read_jdbc
from ordermill.sources.registry import (
    LOADED,
    MISSING,
    UNREADABLE,
    load_raw,
    loaded_frames,
    raw_paths,
)
from tests.conftest import day, eur, rows

CUSTOMER_CSV = """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state
c1,u1,01409,"sao paulo, centro",SP
c2,u2,,rio,RJ
c3,u3,bad,"town",MG
"""
PRODUCT_HEADER = ",".join(PRODUCTS.schema.names) + "\n"
PRODUCT_CSV = PRODUCT_HEADER + "p1,toys,10,,,,,,\np2,,20,,,,,,\n"


@pytest.fixture()
def raw_folder(tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "customers.csv").write_text(CUSTOMER_CSV)
    (root / "orders.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,"
        "order_estimated_delivery_date\n"
        "o1,c1,delivered,2024-01-01 23:59:00,,,,\n"
        "o2,c2,delivered,2024-01-02 10:00:00,,,,\n"
        "o3,c2,shipped,2024-01-02 10:00:00,,,,\n"
    )
    (root / "order_items.csv").write_text(
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2024-01-05 00:00:00,10.10,1.15\n"
        "o2,1,p2,s1,2024-01-05 00:00:00,20.00,2.00\n"
        "o2,2,p1,s1,2024-01-05 00:00:00,10.10,1.15\n"
        "o3,1,p1,s1,2024-01-05 00:00:00,10.10,1.15\n"
    )
    return root


# CSV


def test_inferred_scan_loses_leading_zeros_and_one_bad_cell_makes_a_string(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(CUSTOMER_CSV)
    df = read_csv(spark, str(path))
    assert df.schema["customer_zip_code_prefix"].dataType == StringType()
    path.write_text(CUSTOMER_CSV.replace("bad", "00007"))
    df = read_csv(spark, str(path))
    assert df.schema["customer_zip_code_prefix"].dataType == IntegerType()
    codes = rows(df.select("customer_zip_code_prefix"), "customer_zip_code_prefix")
    assert codes == [(None,), (7,), (1409,)]


def test_inferred_scan_reads_times(spark, raw_folder):
    df = read_csv(spark, str(raw_folder / "orders.csv"))
    assert df.schema["order_purchase_timestamp"].dataType == TimestampType()


def test_schema_scan_nulls_bad_cells_and_keeps_quotes(spark, raw_folder):
    got = rows(read_csv(spark, str(raw_folder / "customers.csv"), CUSTOMERS.schema), "customer_id")
    assert [r[2] for r in got] == [1409, None, None]
    assert [r[3] for r in got] == ["sao paulo, centro", "rio", "town"]


# Registry and landing


def test_missing_folder_loads_nothing(spark, tmp_path):
    assert load_raw(spark, str(tmp_path / "nowhere")) == {}
    with pytest.raises(jobs.NoDataError):
        jobs.land_raw(spark, str(tmp_path / "nowhere"), PathLayers(str(tmp_path / "out")))


def test_missing_file_is_skipped(spark, raw_folder):
    results = load_raw(spark, str(raw_folder))
    assert results["products"].status == MISSING
    assert set(loaded_frames(results)) == {"customers", "orders", "order_items"}


def test_unreadable_file_is_marked_and_the_rest_lands(spark, raw_folder, tmp_path):
    (raw_folder / "products.csv.gz").write_bytes(b"\x1f\x8b this is no gzip stream")
    (raw_folder / "customers.csv.gz").write_bytes(b"\x1f\x8b nor is this")
    layers = PathLayers(str(tmp_path / "out"))
    report = jobs.land_raw(spark, str(raw_folder), layers, "{table}.csv*", infer=False)
    status = {name: r.status for name, r in report.tables.items()}
    assert status["products"] == UNREADABLE
    assert status["orders"] == LOADED
    assert report.tables["products"].error


def test_a_corrupt_file_leaves_the_landed_table(spark, raw_folder, tmp_path):
    layers = PathLayers(str(tmp_path / "out"))
    (raw_folder / "products.csv").write_text(PRODUCT_HEADER + "p1,toys,10,1,1,1,1,1,1\n")
    jobs.land_raw(spark, str(raw_folder), layers)
    (raw_folder / "products.csv").unlink()
    (raw_folder / "products.csv.gz").write_bytes(b"\x1f\x8b this is no gzip stream")
    report = jobs.land_raw(spark, str(raw_folder), layers, "{table}.csv*")
    assert report.tables["products"].status == UNREADABLE
    assert layers.read(spark, PRODUCTS).count() == 1


def test_columns_are_found_by_header(spark, raw_folder, tmp_path):
    lines = CUSTOMER_CSV.splitlines()
    lines[0] = "customer_unique_id,ID,customer_zip_code_prefix,customer_city,customer_state"
    (raw_folder / "customers.csv").write_text("\n".join(lines) + "\n")
    layers = PathLayers(str(tmp_path / "out"))
    report = jobs.land_raw(spark, str(raw_folder), layers)
    assert report.tables["customers"].status == UNREADABLE
    assert "ID" in report.tables["customers"].error
    aliases = {"customers": {"ID": "customer_id"}}
    report = jobs.land_raw(spark, str(raw_folder), layers, aliases=aliases)
    got = rows(layers.read(spark, CUSTOMERS).select("customer_id", "customer_unique_id"), "customer_id")
    assert got == [("u1", "c1"), ("u2", "c2"), ("u3", "c3")]


def test_rejected_cells_are_counted_and_kept(spark, raw_folder, tmp_path):
    items = (raw_folder / "order_items.csv").read_text()
    items = items.replace("20.00,2.00", "123456789.00,2.00").replace("o3,1,p1", "o3,one,p1")
    (raw_folder / "order_items.csv").write_text(items + "o4,1,p1\n")
    layers = PathLayers(str(tmp_path / "out"))
    report = jobs.land_raw(spark, str(raw_folder), layers)
    got = {(r[0], r[1]): r[2] for r in jobs.landed_rejects(spark, report).collect()}
    assert got == {
        ("customers", "customer_zip_code_prefix"): 1,
        ("order_items", "price"): 1,
        ("order_items", "order_item_id"): 1,
        ("order_items", None): 1,
    }
    kept = {tuple(r.rejected_columns): r for r in layers.read(spark, REJECTS).collect()}
    assert "123456789.00" in kept[("price",)].raw_text
    assert kept[()].broken_line and kept[()].raw_text == "o4,1,p1"
    # a later landing without rejects empties the table
    (raw_folder / "order_items.csv").unlink()
    (raw_folder / "customers.csv").unlink()
    jobs.land_raw(spark, str(raw_folder), layers)
    assert layers.read(spark, REJECTS).count() == 0


def test_counts_outgrow_integer(spark, tmp_path):
    big = spark.range(1).select(
        F.lit("p").alias("product_id"),
        F.lit("c").alias("product_category_name"),
        F.lit(3_000_000_000).alias("total_quantity_sold"),
        F.lit(1).alias("total_revenue"),
        F.lit(1.0).alias("avg_price"),
        F.lit(3_000_000_000).alias("total_orders"),
    )
    layers = PathLayers(str(tmp_path))
    layers.write(conform(big, PRODUCT_PERFORMANCE), PRODUCT_PERFORMANCE)
    assert layers.read(spark, PRODUCT_PERFORMANCE).first().total_orders == 3_000_000_000
    declared = as_declared(conform(big, PRODUCT_PERFORMANCE), PRODUCT_PERFORMANCE)
    assert declared.schema["total_orders"].dataType == IntegerType()


def test_unreadable_file_with_inference(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "products.csv.gz").write_bytes(b"\x1f\x8b this is no gzip stream")
    results = load_raw(spark, str(root), pattern="{table}.csv.gz", infer=True)
    assert results["products"].status == UNREADABLE


def test_write_failure_reaches_the_caller(spark, raw_folder):
    def refuse(read, contract):
        raise OSError("target is down")

    with pytest.raises(OSError, match="target is down"):
        load_raw(spark, str(raw_folder), refuse)


def test_landing_keeps_declared_types_counts_and_audits(spark, raw_folder, tmp_path):
    (raw_folder / "products.csv").write_text(PRODUCT_CSV)
    layers = PathLayers(str(tmp_path / "out"))
    report = jobs.land_raw(spark, str(raw_folder), layers)
    assert rows(jobs.landed_counts(spark, report), "table_name") == [
        ("customers", 3),
        ("order_items", 4),
        ("orders", 3),
        ("products", 2),
    ]
    landed = layers.read(spark, ORDER_ITEMS)
    assert landed.schema["price"].dataType == ORDER_ITEMS.decimals["price"]
    audit = {(r.table_name, r.column_name): r.null_count for r in jobs.landed_nulls(spark, report).collect()}
    assert audit[("customers", "customer_zip_code_prefix")] == 2
    assert audit[("products", "product_category_name")] == 1
    assert ("order_items", "price") not in audit
    again = null_audit(loaded_frames(report.tables))
    assert audit == {(r.table_name, r.column_name): r.null_count for r in again.collect()}


def test_jobs_end_to_end(spark, raw_folder, tmp_path):
    (raw_folder / "products.csv").write_text(PRODUCT_CSV)
    layers = PathLayers(str(tmp_path / "out"))
    jobs.land_raw(spark, str(raw_folder), layers)
    written = jobs.run_marts(spark, layers, layers)
    assert rows(jobs.mart_summary(spark, written), "metric") == [
        ("customers_processed", 2),
        ("days_analyzed", 2),
        ("products_analyzed", 2),
    ]
    sales = rows(layers.read(spark, DAILY_SALES).select("sale_date", "total_revenue"), "sale_date")
    assert [r[1] for r in sales] == [eur("11.25"), eur("33.25")]
    assert jobs.check_raw(spark, layers, layers) == 0
    for c in (DAILY_SALES, PRODUCT_PERFORMANCE):
        assert layers.read(spark, c).columns == c.schema.names


def test_mart_failure_reaches_the_caller(spark, tmp_path):
    with pytest.raises(AnalysisException):
        jobs.run_marts(spark, PathLayers(str(tmp_path / "empty")), PathLayers(str(tmp_path)))


def test_raw_paths_take_a_file_pattern():
    paths = raw_paths("/data/raw/", "shop_{table}_v1.csv")
    assert paths["orders"] == "/data/raw/shop_orders_v1.csv"


def test_path_exists(spark, tmp_path):
    assert path_exists(spark, str(tmp_path))
    assert path_exists(spark, f"file://{tmp_path}")
    assert not path_exists(spark, str(tmp_path / "no"))


# Layers


def _products(spark, *ids):
    frame = spark.createDataFrame([(i, "toys") for i in ids], "product_id string, category string")
    return frame.select(
        "product_id",
        F.col("category").alias("product_category_name"),
        *[F.lit(None).alias(n) for n in PRODUCTS.schema.names[2:]],
    ).transform(lambda d: conform(d, PRODUCTS))


def test_layer_of_every_table():
    assert {c.name: c.layer for c in CONTRACTS.values()} == {
        "customers": "raw_data",
        "orders": "raw_data",
        "order_items": "raw_data",
        "products": "raw_data",
        "customer_metrics": "staging",
        "daily_sales": "analytics",
        "product_performance": "analytics",
        "live_orders": "streaming",
    }
    assert PathLayers("/w/").path(DAILY_SALES) == "/w/analytics/daily_sales"


def test_save_modes(spark, tmp_path):
    layers = PathLayers(str(tmp_path))
    assert not layers.exists(spark, PRODUCTS)
    assert layers.write(_products(spark, "a", "b"), PRODUCTS).rows == 2
    assert layers.exists(spark, PRODUCTS)
    assert layers.write(_products(spark, "c"), PRODUCTS, "append").rows == 1
    assert layers.read(spark, PRODUCTS).count() == 3
    assert layers.write(_products(spark, "d"), PRODUCTS, "ignore").rows == 0
    assert layers.read(spark, PRODUCTS).count() == 3
    with pytest.raises(AnalysisException):
        layers.write(_products(spark, "d"), PRODUCTS, "error")
    assert layers.write(_products(spark, "e"), PRODUCTS, "overwrite").rows == 1
    assert rows(layers.read(spark, PRODUCTS).select("product_id"), "product_id") == [("e",)]


def test_writing_nothing_counts_zero(spark, tmp_path):
    layers = PathLayers(str(tmp_path))
    assert layers.write(_products(spark, "a").limit(0), PRODUCTS).rows == 0
    assert layers.write(_products(spark, "a").filter("1 = 0"), PRODUCTS).rows == 0


def test_append_missing_can_be_repeated(spark, tmp_path):
    layers = PathLayers(str(tmp_path))
    twice = _products(spark, "a", "b", "a")
    assert append_missing(twice, PRODUCTS, layers).rows == 2
    assert append_missing(twice, PRODUCTS, layers).rows == 0
    assert append_missing(_products(spark, "b", "c"), PRODUCTS, layers).rows == 1
    assert rows(layers.read(spark, PRODUCTS).select("product_id"), "product_id") == [
        ("a",),
        ("b",),
        ("c",),
    ]


def test_append_missing_takes_a_null_key_once_and_the_last_of_repeats(spark, tmp_path):
    layers = PathLayers(str(tmp_path))
    frame = _products(spark, None, "a", "a").withColumn(
        "product_category_name", F.expr("substring(uuid(), 1, 0) || 'same'")
    )
    frame = frame.union(frame.withColumn("product_category_name", F.lit("zoo")))
    assert append_missing(frame, PRODUCTS, layers).rows == 2
    assert append_missing(frame, PRODUCTS, layers).rows == 0
    assert append_missing(frame, PRODUCTS, layers).rows == 0
    got = layers.read(spark, PRODUCTS).select("product_id", "product_category_name")
    assert rows(got, "product_id") == [(None, "zoo"), ("a", "zoo")]


def test_catalog_layers_are_idempotent_and_keep_declared_types(spark, tmp_path):
    layers = CatalogLayers(str(tmp_path / "catalog"))
    layers.create(spark)
    layers.create(spark)
    assert set(LAYERS) <= {d.name for d in spark.catalog.listDatabases()}
    for c in CONTRACTS.values():
        assert spark.catalog.tableExists(c.qualified_name)
    assert layers.write(_products(spark, "a", "b"), PRODUCTS).rows == 2
    layers.create(spark)  # does not empty a filled table
    assert layers.read(spark, PRODUCTS).count() == 2
    assert layers.write(_products(spark, "c"), PRODUCTS, "append").rows == 1
    assert layers.write(_products(spark, "d"), PRODUCTS, "overwrite").rows == 1
    table = layers.read(spark, PRODUCTS)
    assert rows(table.select("product_id"), "product_id") == [("d",)]
    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in PRODUCTS.schema
    ]
    with pytest.raises(ValueError):
        layers.write(_products(spark, "d"), PRODUCTS, "ignore")


# JDBC: options only, as no database is at hand


CONNECTION = JdbcConnection("jdbc:postgresql://db/shop", "me", "secret")


def test_jdbc_options():
    options = CONNECTION.table_options("raw_data", "orders")
    assert options["dbtable"] == "raw_data.orders"
    assert options["user"] == "me"
    assert "secret" not in repr(CONNECTION)
    split = RangeSplit("shipping_limit_date", "2024-01-01", "2024-12-31", 64)
    assert split.options()["numPartitions"] == "64"


def test_jdbc_write_options_keep_the_contract():
    assert REFERENCED == {"customers", "orders"}
    options = JdbcLayers(CONNECTION, max_connections=8).write_options(CUSTOMERS)
    assert options["truncate"] == "true"
    assert options["numPartitions"] == "8"
    assert "customer_state VARCHAR(2)" in options["createTableColumnTypes"]
    assert "createTableColumnTypes" not in JdbcLayers(CONNECTION).write_options(DAILY_SALES)
    assert column_types(DAILY_SALES.schema) == ""


def test_jdbc_split_and_predicates_exclude_each_other(spark):
    with pytest.raises(ValueError):
        read_jdbc(
            spark,
            CONNECTION,
            "orders",
            split=RangeSplit("a", "0", "1", 2),
            predicates=["a = 1"],
        )


def test_jdbc_failures_reach_the_caller(spark):
    nowhere = JdbcConnection("jdbc:none:nothing", driver="no.such.Driver")
    with pytest.raises(Exception, match="no.such.Driver"):
        JdbcLayers(nowhere).read(spark, RAW_TABLES[0])
    with pytest.raises(Exception, match="no.such.Driver"):
        JdbcLayers(nowhere).write(_products(spark, "a"), PRODUCTS)


def test_times_keep_their_value_through_a_layer(spark, tmp_path, orders):
    layers = PathLayers(str(tmp_path))
    full = orders.select(
        "*",
        *[
            F.lit(None).cast("timestamp").alias(n)
            for n in CONTRACTS["orders"].schema.names
            if n not in orders.columns
        ],
    )
    layers.write(full, CONTRACTS["orders"])
    first = layers.read(spark, CONTRACTS["orders"]).filter("order_id = 'o1'").first()
    assert first.order_purchase_timestamp == day("2024-01-01 23:59:00")
