"""Every registered query of the engine against SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from quern.plans import registry
from tests.compare import mismatch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert mismatch(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_other_folders_stay_importable_without_llm():
    import os

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{top}/quern"):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                with open(f"{folder}/{f}") as text:
                    assert "quern.llm" not in text.read(), f


def test_filters_and_columns_reach_the_scan(spark):
    from quern.engine import Engine

    plan = Engine(spark).load(SF, "lineitem").query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(l_quantity,40.0)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
