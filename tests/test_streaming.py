import shutil

import pytest
from pyspark.sql import functions as F

from ordermill.catalog.mapping import Tables
from ordermill.contracts import LIVE_ORDERS, LIVE_REJECTS
from ordermill.sinks.append import append_missing, held_keys
from ordermill.sinks.layers import PathLayers
from ordermill.streaming import live_orders as live
from tests.conftest import day, rows

DATA = "/root/testdata/sf0.001"
INCOMING = (
    "order_id string, customer_id string, product_id string, order_value decimal(10,2), "
    "order_timestamp timestamp"
)


@pytest.fixture()
def inbox(spark, tmp_path):
    """A folder that one file of orders arrives in; the file can be delivered again."""
    from decimal import Decimal

    rows_in = [
        ("o1", "c1", "p1", Decimal("1.00"), day("2024-01-01 10:00:00")),
        ("o2", "c1", "p1", Decimal("2.00"), None),
    ]
    spark.createDataFrame(rows_in, INCOMING).coalesce(1).write.parquet(str(tmp_path / "made"))
    made = next((tmp_path / "made").glob("*.parquet"))
    folder = tmp_path / "inbox"
    folder.mkdir()

    def deliver(name: str) -> None:
        shutil.copy(made, folder / f"{name}.parquet")

    deliver("first")
    return folder, deliver


def _schema(spark):
    return spark.createDataFrame([], INCOMING).schema


def _stream(spark, folder):
    return live.live_orders(live.file_stream(spark, str(folder), _schema(spark), max_files=1))


def test_append_and_defaults(spark, inbox, tmp_path):
    folder, _ = inbox
    out = str(tmp_path / "out")
    live.append_stream(_stream(spark, folder), out, str(tmp_path / "s")).awaitTermination()
    got = spark.read.parquet(out).orderBy("order_id")
    assert got.columns == LIVE_ORDERS.schema.names
    o1, o2 = got.collect()
    assert o1.order_timestamp == day("2024-01-01 10:00:00")
    assert o2.order_timestamp is not None and o2.processed_at is not None


def test_append_without_dedup_repeats_replayed_rows(spark, inbox, tmp_path):
    folder, deliver = inbox
    out, state = str(tmp_path / "out"), str(tmp_path / "s")
    live.append_stream(_stream(spark, folder), out, state).awaitTermination()
    deliver("again")
    live.append_stream(_stream(spark, folder), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_dedup_state_outlives_a_restart(spark, inbox, tmp_path):
    folder, deliver = inbox
    out, state = str(tmp_path / "out"), str(tmp_path / "s")

    def run():
        unique = live.unique_orders(_stream(spark, folder))
        live.append_stream(unique, out, state).awaitTermination()

    run()
    deliver("again")
    run()
    assert rows(spark.read.parquet(out).select("order_id"), "order_id") == [("o1",), ("o2",)]


def test_dedup_within_a_delay(spark, inbox, tmp_path):
    folder, deliver = inbox
    deliver("again")
    out = str(tmp_path / "out")
    stream = live.file_stream(spark, str(folder), _schema(spark))
    unique = live.live_orders(live.unique_orders_within(stream, "1 hour"))
    live.append_stream(unique, out, str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_an_absent_time_does_not_make_later_orders_late(spark, tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for i in range(5):
        time = None if i == 0 else day(f"2024-01-01 10:0{i}:00")
        part = spark.createDataFrame([(f"o{i}", "c", "p", None, time)], INCOMING)
        part.coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        shutil.copy(next((tmp_path / f"made{i}").glob("*.parquet")), folder / f"{i}.parquet")
    out = str(tmp_path / "out")
    stream = live.file_stream(spark, str(folder), _schema(spark), max_files=1)
    unique = live.live_orders(live.unique_orders_within(stream, "1 hour"))
    live.append_stream(unique, out, str(tmp_path / "s")).awaitTermination()
    got = rows(spark.read.parquet(out).select("order_id"), "order_id")
    assert got == [(f"o{i}",) for i in range(5)]


def _orders(spark, *ids, at="2024-01-01 10:00:00"):
    frame = spark.createDataFrame([(i, "c", "p", None, day(at)) for i in ids], INCOMING)
    return live.live_orders(
        frame.withColumn("order_date", F.to_date("order_timestamp")), keep=["order_date"]
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_looks_up_the_keys_of_the_batch(spark, tmp_path, monkeypatch):
    target = PathLayers(str(tmp_path / "w"))
    assert append_missing(_orders(spark, "o1", "o2", "o3"), LIVE_ORDERS, target).rows == 3
    held = held_keys(_orders(spark, "o2", at="2024-05-05 00:00:00"), LIVE_ORDERS, target)
    pushed = _plan(held).split("PushedFilters: ")[1].split("]")[0]
    assert "order_id" in pushed and "o2" in pushed and "PartitionFilters: []" in _plan(held)
    assert rows(held, "_held_order_id") == [("o2",)]
    # another day is the same order
    again = _orders(spark, "o2", "o4", at="2024-02-02 00:00:00")
    assert append_missing(again, LIVE_ORDERS, target).rows == 1
    monkeypatch.setattr("ordermill.sinks.append.LISTED", 1)
    big = _orders(spark, "o1", "o4", "o5")
    assert "o5" not in _plan(held_keys(big, LIVE_ORDERS, target))
    assert append_missing(big, LIVE_ORDERS, target).rows == 1


def test_stored_orders_have_bloom_filters_of_their_ids(spark, tmp_path):
    target = PathLayers(str(tmp_path / "w"))
    ids = spark.range(20_000).select(F.format_string("o%08d", F.col("id") * 2).alias("order_id"))
    orders = ids.select(
        "order_id", F.lit("c").alias("customer_id"), F.lit("p").alias("product_id"),
        F.lit(1).cast("decimal(10,2)").alias("order_value"), F.lit(day("2024-01-01 00:00:00")).alias("order_timestamp"),
    )
    target.write(live.live_orders(orders.coalesce(1)), LIVE_ORDERS)
    # between the smallest and the largest id, so only the filter can tell that it is absent
    for absent, scanned in (("o00010001", 0), ("o00010000", 20_000)):
        found = target.read(spark, LIVE_ORDERS).filter(F.col("order_id").isin([absent]))
        found.collect()
        scans = found._jdf.queryExecution().executedPlan().collectLeaves()
        assert scans.head().metrics().apply("numOutputRows").value() == scanned


def test_upsert_adds_nothing_on_replay(spark, inbox, tmp_path):
    folder, deliver = inbox
    target = PathLayers(str(tmp_path / "w"))
    def run(state):
        incoming = live.file_stream(spark, str(folder), _schema(spark), max_files=1)
        live.upsert_stream(incoming, target, str(tmp_path / state)).awaitTermination()

    run("s")
    deliver("again")
    run("s")
    # even with its progress lost, the stream finds its rows in the target
    run("s2")
    assert rows(target.read(spark, LIVE_ORDERS).select("order_id"), "order_id") == [
        ("o1",),
        ("o2",),
    ]


def test_stream_equals_batch(spark, tmp_path):
    t = Tables(spark, DATA)
    batch = live.live_orders(t.purchases(t.given("events"))).drop("processed_at")
    events = live.file_stream(spark, t.path("events"), t.given("events").schema)
    out = str(tmp_path / "out")
    stream = live.live_orders(t.purchases(events))
    live.append_stream(stream, out, str(tmp_path / "s")).awaitTermination()
    assert rows(spark.read.parquet(out).drop("processed_at"), "order_id") == rows(
        batch, "order_id"
    )


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        live.file_stream(spark, str(tmp_path / "no.parquet"), _schema(spark))


def test_orders_that_do_not_cast_are_kept_apart_and_counted(spark, tmp_path):
    inbox, target = str(tmp_path / "in"), PathLayers(str(tmp_path / "w"))
    schema = "order_id string, customer_id string, product_id string, order_value string, order_timestamp string"
    received = [
        ("o1", "c", "p", "1.005", "2024-01-01 10:00:00"),
        ("o2", "c", "p", "123456789.00", None),
        ("o3", "c", "p", None, "no time"),
        (None, "c", "p", "1", None),
        ("o4", None, None, None, None),
        ("o4", None, None, "x", None),
    ]
    spark.createDataFrame(received, schema).coalesce(1).write.parquet(inbox)
    told = []

    def run(state):
        stream = live.file_stream(spark, inbox, spark.read.parquet(inbox).schema)
        live.upsert_text_stream(
            stream, "orders", target, str(tmp_path / state), tell=lambda *n: told.append(n)
        ).awaitTermination()

    run("s")
    run("s2")  # its progress lost, the stream writes the same rejects in their place
    assert told == [(0, 6, 4), (0, 6, 4)]
    stored = target.read(spark, LIVE_ORDERS)
    assert rows(stored.select("order_id"), "order_id") == [("o1",), ("o4",)]
    rejects = {tuple(r.rejected_columns): r.raw_order for r in target.read(spark, LIVE_REJECTS).collect()}
    assert set(rejects) == {("order_value",), ("order_timestamp",), ("order_id",)}
    assert target.read(spark, LIVE_REJECTS).count() == 4
    assert "no time" in rejects[("order_timestamp",)]
