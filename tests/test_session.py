import pytest

from ordermill.__main__ import layers, parse
from ordermill.session import INITIAL_PARTITIONS, RUNTIME_SETTINGS, adapt, scratch_path
from ordermill.sinks.jdbc import JdbcLayers
from ordermill.sinks.layers import CatalogLayers, PathLayers
from ordermill.sources.jdbc import RangeSplit


def test_adapt_keeps_what_the_caller_chose(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other = spark.newSession()
    other.conf.set(key, "32MB")
    assert adapt(other).conf.get(key) == "32MB"
    for name, value in RUNTIME_SETTINGS.items():
        if name != key:
            assert other.conf.get(name) == value


def test_a_task_reads_a_bounded_share(spark):
    """Few tasks could share a large stage; what each reads, and so holds, stays small all the same."""
    other = spark.newSession()
    most = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 32, "spark.sql.files.maxPartitionBytes": 32}
    for key in most:
        other.conf.unset(key)
    adapt(other)
    for key, mb in most.items():
        assert int(other.conf.get(key).removesuffix("MB")) <= mb


def test_initial_partitions_are_a_choice_at_the_start(spark):
    other = spark.newSession()
    assert adapt(other).conf.get(INITIAL_PARTITIONS, None) == spark.conf.get(INITIAL_PARTITIONS, None)


def test_scratch_is_the_folder_the_session_names(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(f"{shared}/x-")


def test_command_line(monkeypatch):
    assert layers(parse(["marts", "--warehouse", "/w"])) == PathLayers("/w")
    monkeypatch.setenv("ORDERMILL_DB_USER", "me")
    place = layers(parse(["marts", "--jdbc-url", "jdbc:postgresql://db/shop"]))
    assert isinstance(place, JdbcLayers) and place.connection.user == "me"
    split = "orders:order_purchase_timestamp:2017-01-01 00:00:00:2018-12-31 23:59:59:64"
    options = ["--jdbc-url", "jdbc:x", "--jdbc-connections", "64", "--jdbc-split", split]
    place = layers(parse(["marts", *options, "--jdbc-split", "order_items:order_item_id:1:9:8"]))
    assert place.max_connections == 64
    assert place.splits == {
        "orders": RangeSplit(
            "order_purchase_timestamp", "2017-01-01 00:00:00", "2018-12-31 23:59:59", 64
        ),
        "order_items": RangeSplit("order_item_id", "1", "9", 8),
    }
    assert isinstance(layers(parse(["check", "--catalog"])), CatalogLayers)
    live = parse(["live", "--warehouse", "/w", "--incoming", "/i", "--checkpoint", "/c"])
    assert live.every is None
    for wrong in (["land", "--warehouse", "/w"], ["live", "--warehouse", "/w"]):
        with pytest.raises(SystemExit):
            parse(wrong)
    with pytest.raises(SystemExit):
        parse(["land", "--warehouse", "/w"])
