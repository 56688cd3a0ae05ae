"""Marts out of carried state against marts out of all lines."""

import pytest
from pyspark.sql import functions as F

from ordermill.contracts import CUSTOMER_METRICS, DAILY_SALES, MART_STATE, PRODUCT_PERFORMANCE
from ordermill.plans import carried_marts, marts
from ordermill.sinks.layers import PathLayers
from ordermill.sinks.snapshots import Versions
from tests.conftest import rows


def whole(orders, items, products):
    return {
        CUSTOMER_METRICS.name: marts.customer_metrics(orders, items, products),
        DAILY_SALES.name: marts.daily_sales(orders, items),
        PRODUCT_PERFORMANCE.name: marts.product_performance(orders, items, products),
    }


def same(spark, target, orders, items, products):
    got = carried_marts.finished(carried_marts.stored_state(spark, target), products)
    for name, mart in whole(orders, items, products).items():
        key = mart.columns[0]
        assert rows(got[name].select(*mart.columns), key) == rows(mart, key), name


def test_any_order_of_arrival_gives_the_whole_marts(spark, tmp_path, orders, items, products):
    target = PathLayers(str(tmp_path))
    half = F.abs(F.xxhash64("order_id", "order_item_id")) % 2 == 0
    some = orders.filter("order_id NOT IN ('o2', 'o8')")
    assert carried_marts.carry_on("a", some, items.filter(half), products.limit(2), target)
    same(spark, target, some, items.filter(half), products.limit(2))
    assert carried_marts.carry_on("b", orders, items.filter(~half), products, target)
    same(spark, target, orders, items, products)
    # nothing new, then a batch again
    assert carried_marts.carry_on("c", orders, items.limit(0), products, target)
    assert not carried_marts.carry_on("b", orders, items.filter(~half), products, target)
    same(spark, target, orders, items, products)
    assert carried_marts.write_marts(spark, products, target)[DAILY_SALES.name] == 3


def test_a_lost_run_leaves_the_old_state(spark, tmp_path, monkeypatch, orders, items, products):
    target = PathLayers(str(tmp_path))
    carried_marts.carry_on("a", orders, items.limit(4), products, target)
    before = sorted(map(str, carried_marts.stored_state(spark, target).collect()))

    def lost(*_):
        raise SystemExit("the driver is lost")

    rest = items.exceptAll(items.limit(4))
    with monkeypatch.context() as patch:
        patch.setattr(Versions, "publish", lost)
        with pytest.raises(SystemExit):
            carried_marts.carry_on("b", orders, rest, products, target)
    assert sorted(map(str, carried_marts.stored_state(spark, target).collect())) == before
    assert carried_marts.carry_on("b", orders, rest, products, target)
    same(spark, target, orders, items, products)


def test_old_lines_are_not_read(spark, tmp_path, orders, items, products):
    """Items lie in files by batch; the plan of the second batch names the second file alone."""
    target = PathLayers(str(tmp_path / "w"))
    for name, part in (("old", items.limit(5)), ("new", items.exceptAll(items.limit(5)))):
        part.write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("old", "new"))
    carried_marts.carry_on("a", orders, old, products, target)
    state = carried_marts.stored_state(spark, target)
    merged = carried_marts.merged(
        state, carried_marts.partials(orders, new, products, state, "delivered")
    )
    assert not any("/old/" in f for f in merged.inputFiles())
    assert any("/new/" in f for f in merged.inputFiles())
    assert any(f"/{MART_STATE.name}/" in f for f in merged.inputFiles())
    done = carried_marts.finished(state, products)[DAILY_SALES.name]
    assert all(f"/{MART_STATE.name}/" in f for f in done.inputFiles())


def test_an_empty_state_gives_empty_marts(spark, tmp_path, products):
    target = PathLayers(str(tmp_path))
    assert carried_marts.write_marts(spark, products, target) == {
        CUSTOMER_METRICS.name: 0, DAILY_SALES.name: 0, PRODUCT_PERFORMANCE.name: 0,
    }


def test_new_lines_are_summed_up_once(spark, tmp_path, orders, items, products):
    """One aggregation, where lines meet the old state: its memory is not taken twice in a task."""
    target = PathLayers(str(tmp_path))
    carried_marts.carry_on("a", orders, items.limit(5), products, target)
    state = carried_marts.stored_state(spark, target)
    new = carried_marts.partials(orders, items, products, state, "delivered")
    plan = carried_marts.merged(state, new)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
