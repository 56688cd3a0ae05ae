"""Registered queries against their check SQL, and the entry without this folder."""

import subprocess
import sys
from pathlib import Path

import pytest

from ordermill.llm.registry import ORACLES, QUERIES
from tests.llm.conftest import DATA
from tests.oracle import connect, differences

ROOT = Path(__file__).parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLES[name]) == []


def test_one_query_for_each_operator():
    numbers = {n.split("_")[0] for n in QUERIES}
    assert numbers == {f"op{i}" for i in range(1, 14)}


def test_entry_has_the_operators_and_the_pipeline():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("missing", ["ordermill.llm", "corpus_pipeline"])
def test_entry_without_the_optional_part(missing):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e; assert not any(n.startswith('op') and n[2:3].isdigit() "
        "for n in e.queries()); assert 'customer_metrics' in e.queries()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
