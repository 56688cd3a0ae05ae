"""Types out of text, and the account of them."""

import pytest

from ordermill.contracts import PRODUCTS, REJECTS
from ordermill.plans import jobs
from ordermill.sinks.layers import PathLayers
from ordermill.sources.inference import inferred_types, read_inferred_csv
from tests.test_tables import raw_folder  # noqa: F401

CASES = {
    "whole": (["1", "-2", "0", None], "int", None),
    "big": (["1", "3000000000"], "bigint", "3000000000"),
    "huge": (["1", "30000000000000000000"], "decimal(20,0)", "30000000000000000000"),
    "money": (["1.50", "12", "-1234.5"], "decimal(6,2)", "-1234.5"),
    "many": (["1" * 39, "2"], "string", "1" * 39),
    "wide": (["1" * 30, "0." + "1" * 20], "string", "0." + "1" * 20),
    "real": (["1e3", "2.5"], "double", "1e3"),
    "exact": (["1e3", "1234567890123456.5"], "string", "1e3"),
    "zip": (["01409", "20040"], "string", "01409"),
    "day": (["2024-02-29"], "date", None),
    "no_day": (["2024-02-30"], "string", None),
    "time": (["2024-02-29", "2024-02-29 10:00:00"], "timestamp", "2024-02-29 10:00:00"),
    "flag": (["true", "FALSE"], "boolean", None),
    "odd": (["true", "1"], "string", "1"),
    "text": (["a", "1", "2"], "string", "a"),
    "spaced": ([" 1"], "string", None),
    "empty": ([None], "string", None),
}


@pytest.mark.parametrize("name", CASES)
def test_narrowest_type_and_the_cell_that_widened_it(spark, name):
    cells, kind, cell = CASES[name]
    df = spark.createDataFrame([(c,) for c in cells], "`a.b` string").repartition(3)
    row = inferred_types(df, ["a.b"], "t").first()
    assert (row.column_name, row.data_type, row.widening_cell) == ("a.b", kind, cell)
    assert sum(row.cells.values()) == sum(c is not None for c in cells)


def test_one_scan(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    assert inferred_types(df.limit(0), ["a", "b"], "t").count() == 2
    (tmp_path / "c.csv").write_text("a, b\n1,2\n")
    read, account = read_inferred_csv(spark, str(tmp_path / "c.csv"), "t")
    assert read.schema.simpleString() == "struct<a:int,b:int>" and account.count() == 2


def test_landing_with_inference_keeps_broken_lines_and_zeros(spark, raw_folder, tmp_path):  # noqa: F811
    (raw_folder / "products.csv").write_text("product_id,code\np1,007\np2,1,2\np3\n")
    layers = PathLayers(str(tmp_path / "out"))
    report = jobs.land_raw(spark, str(raw_folder), layers, infer=True)
    got = {(r[0], r[1]): r[2] for r in jobs.landed_rejects(spark, report).collect()}
    assert got[("products", None)] == 2
    kept = {r.raw_text for r in layers.read(spark, REJECTS).filter("table_name = 'products'").collect()}
    assert kept == {"p2,1,2", "p3"}
    assert layers.read(spark, PRODUCTS).filter("product_id = 'p1'").first().code == "007"


def test_the_code_of_a_scan_does_not_grow_with_the_columns(spark, tmp_path):
    names = [f"c{i}" for i in range(7)]
    lines = [names, [str(i) for i in range(7)], ["x"] * 7]
    (tmp_path / "c.csv").write_text("\n".join(map(",".join, lines)) + "\n")
    # code that is too long for a method fails instead of running slowly
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        _, account = read_inferred_csv(spark, str(tmp_path / "c.csv"), "t")
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    got = [(r.data_type, r.cells, r.widening_cell) for r in account.collect()]
    assert got == [("string", {"int": 1, "string": 1}, "x")] * 7
