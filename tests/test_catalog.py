"""The registry, and every SQL statement on its own. tools/compare.py runs both sides."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import compare, connect  # noqa: E402

from gaugebook.catalog import load  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables absent")


def test_every_query_has_sql():
    assert set(load.QUERIES) == set(load.ORACLES)
    assert len(load.QUERIES) >= 90
    assert set(load.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(load.ORACLES))
def test_sql_is_valid(name):
    connect(SMALL).execute(oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("name", ["prj_3_instant_millis", "flt_1_reading_rules", "limit_crossings",
                                  "str_3_contested_verdicts", "ord_5_sorted_inside_batch"])
def test_same_result(spark, name):
    assert compare(spark, connect(SMALL), name, SMALL) is None


def test_entry(spark):
    assert {"site_id", "over_kg"} <= set(entry(spark).columns)
