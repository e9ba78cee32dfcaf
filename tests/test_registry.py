"""The driver contract, and plans that must not hold a cross product."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
# Queries of the training-data part have tests of their own.
NAMES = sorted(n for n in entry_point.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit()))


def test_every_oracle_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(NAMES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert "grouping_level" in df.columns and df.count() > 0


def test_plans_without_cross_products(spark):
    found = {}
    for name in NAMES:
        fn = entry_point.queries()[name]
        out = io.StringIO()
        with redirect_stdout(out):
            fn(spark, SF).explain()
        plan = out.getvalue()
        found[name] = [w for w in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin") if w in plan]
    assert {n: w for n, w in found.items() if w} == {}


@pytest.mark.parametrize("name", ["settle_rollup_5", "occupancy_full_rebuild"])
def test_scans_are_pruned(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        entry_point.queries()[name](spark, SF).explain("formatted")
    assert "ReadSchema" in out.getvalue() and "o_totalprice" not in out.getvalue()
