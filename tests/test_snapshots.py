"""Published versions: a writer lost at any step leaves a whole table, old or new."""

import pytest

from ordermill.contracts import CUSTOMERS, LANDED_FILES, ORDER_ITEMS, PRODUCTS, REJECTS
from ordermill.plans import jobs
from ordermill.plans.increments import land_increment
from ordermill.sinks import layers as layers_module
from ordermill.sinks.jdbc import JdbcLayers
from ordermill.sinks.layers import PathLayers
from ordermill.sinks.snapshots import Versions
from tests.conftest import rows
from tests.test_tables import CONNECTION, PRODUCT_CSV, PRODUCT_HEADER, _products, raw_folder  # noqa: F401


def ids(spark, layers, **options):
    return rows(layers.read(spark, PRODUCTS, **options).select("product_id"), "product_id")


@pytest.mark.parametrize("step", ["publish", "tidy"])
def test_a_stop_between_the_steps_leaves_a_readable_table(spark, tmp_path, monkeypatch, step):
    layers = PathLayers(str(tmp_path))
    layers.write(_products(spark, "a"), PRODUCTS)

    def lost(*_):
        raise SystemExit("the driver is lost")

    with monkeypatch.context() as patch:
        patch.setattr(Versions, step, lost)
        with pytest.raises(SystemExit):
            layers.write(_products(spark, "b"), PRODUCTS)
    assert ids(spark, layers) == [("a" if step == "publish" else "b",)]
    removed = layers.recover(spark, [PRODUCTS])
    assert len(removed) == (step == "publish")
    assert layers.recover(spark, [PRODUCTS]) == []
    layers.write(_products(spark, "c"), PRODUCTS)
    assert ids(spark, layers) == [("c",)]


def test_a_reader_stays_with_its_version(spark, tmp_path):
    layers = PathLayers(str(tmp_path))
    layers.write(_products(spark, "a"), PRODUCTS)
    pinned = layers.read(spark, PRODUCTS)
    layers.write(_products(spark, "b"), PRODUCTS)
    assert rows(pinned.select("product_id"), "product_id") == [("a",)]
    assert ids(spark, layers, version=1) == [("a",)]
    layers.write(_products(spark, "c"), PRODUCTS)
    assert [s.number for s in layers.versions(spark, PRODUCTS).all()] == [2, 3]
    assert len(list((tmp_path / "raw_data" / "products").glob("version-*"))) == 2


def test_a_failing_source_leaves_the_table_and_nothing_behind(spark, tmp_path):
    layers = PathLayers(str(tmp_path))
    layers.write(_products(spark, "a"), PRODUCTS)
    failing = _products(spark, "b").selectExpr(
        "assert_true(product_id = 'a', 'source is down') IS NULL AS x", "*"
    )
    with pytest.raises(Exception, match="source is down"):
        layers.write(failing, PRODUCTS)
    assert ids(spark, layers) == [("a",)]
    layers.recover(spark, [PRODUCTS])
    assert len(list((tmp_path / "raw_data" / "products").glob("version-*"))) == 1


def test_increments_land_new_files_once(spark, raw_folder, tmp_path):  # noqa: F811
    layers = PathLayers(str(tmp_path / "out"))
    (raw_folder / "products1.csv").write_text(PRODUCT_CSV)
    first = land_increment(spark, str(raw_folder), layers)
    assert {r.table: r.written.rows for r in first.landed()} == {
        "customers": 3, "orders": 3, "order_items": 4, "products": 2,
    }
    again = land_increment(spark, str(raw_folder), layers)
    assert {r.written.rows for r in again.landed()} == {0}
    (raw_folder / "products2.csv").write_text(PRODUCT_HEADER + "p3,x,12 g,1,1,1,1,1,1\np4\n")
    report = land_increment(spark, str(raw_folder), layers)
    assert report.tables["products"].written.rows == 2
    assert report.tables["customers"].written.rows == 0
    got = {(r[0], r[1]): r[2] for r in jobs.landed_rejects(spark, report).collect()}
    assert got == {("products", "product_name_length"): 1, ("products", None): 1}
    assert layers.read(spark, REJECTS).filter("table_name = 'products'").count() == 2
    assert layers.read(spark, PRODUCTS).columns == PRODUCTS.schema.names
    assert ids(spark, layers) == [("p1",), ("p2",), ("p3",), ("p4",)]


def test_a_batch_that_was_cut_off_is_landed_again_in_its_place(spark, raw_folder, tmp_path, monkeypatch):  # noqa: F811
    from ordermill.plans import increments

    layers = PathLayers(str(tmp_path / "out"))
    note = increments._note

    def lost(files, batch, contract, target, done):
        if done and contract is ORDER_ITEMS:
            raise SystemExit("the driver is lost")
        note(files, batch, contract, target, done)

    with monkeypatch.context() as patch:
        patch.setattr(increments, "_note", lost)
        with pytest.raises(SystemExit):
            land_increment(spark, str(raw_folder), layers)
    assert layers.read(spark, ORDER_ITEMS).count() == 4
    land_increment(spark, str(raw_folder), layers)
    assert layers.read(spark, ORDER_ITEMS).count() == 4
    assert layers.read(spark, CUSTOMERS).count() == 3
    ledger = layers.read(spark, LANDED_FILES).filter("table_name = 'order_items' AND done")
    assert ledger.count() == 1


def test_a_table_landed_whole_takes_no_increments(spark, raw_folder, tmp_path):  # noqa: F811
    layers = PathLayers(str(tmp_path / "out"))
    jobs.land_raw(spark, str(raw_folder), layers)
    report = land_increment(spark, str(raw_folder), layers)
    assert "kept whole" in report.tables["customers"].error
    assert layers.read(spark, CUSTOMERS).count() == 3


class Database(JdbcLayers):
    """A database's behaviour without one: no version is replaced, tables rest in folders."""

    def __init__(self, folder):
        super().__init__(CONNECTION)
        object.__setattr__(self, "rest", PathLayers(folder))

    def exists(self, spark, contract):
        return self.rest.exists(spark, contract)

    def read(self, spark, contract, predicates=None):
        return self.rest.read(spark, contract)

    def write(self, df, contract, mode="overwrite", metrics=None, columns=None):
        assert not (mode == "overwrite" and contract.name in ("customers", "orders"))
        return self.rest.write(df, contract, mode, metrics, columns)


def test_landing_into_a_database_keeps_rejects_and_nulls(spark, raw_folder, tmp_path):  # noqa: F811
    text = (raw_folder / "orders.csv").read_text()
    (raw_folder / "orders.csv").write_text(text.replace("2024-01-02 10:00:00", "some day", 1))
    items = (raw_folder / "order_items.csv").read_text()
    (raw_folder / "order_items.csv").write_text(items.replace("20.00", "dear"))
    (raw_folder / "products.csv").write_text(PRODUCT_CSV + "p3,x,12 g,1,1,1,1,1,1\n")
    target = Database(str(tmp_path / "db"))
    for _ in range(2):
        report = jobs.land_raw(spark, str(raw_folder), target)
        got = {(r[0], r[1]): r[2] for r in jobs.landed_rejects(spark, report).collect()}
        assert got == {
            ("customers", "customer_zip_code_prefix"): 1,
            ("orders", "order_purchase_timestamp"): 1,
            ("order_items", "price"): 1,
            ("products", "product_name_length"): 1,
        }
        nulls = {(r[0], r[1]): r[2] for r in jobs.landed_nulls(spark, report).collect()}
        assert nulls["customers", "customer_zip_code_prefix"] == 2
        assert nulls["orders", "order_approved_at"] == 3
        kept = {r.table_name: r.raw_text for r in target.read(spark, REJECTS).collect()}
        assert set(kept) == {"customers", "orders", "order_items", "products"}
        assert "some day" in kept["orders"] and "dear" in kept["order_items"]
    assert target.read(spark, CUSTOMERS).count() == 3
    assert layers_module.PART not in target.read(spark, CUSTOMERS).columns
