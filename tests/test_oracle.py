"""Every registered query equals its DuckDB oracle on the smallest test tables."""

import importlib
import os

import pytest

import __spark_entry__ as E
from tools.check_oracle import duck, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


NAMES = sorted(importlib.import_module("stockledger.plans.oracle").oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_bag = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    d_cols, d_bag = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert s_bag == d_bag


def test_every_query_of_this_part_has_oracle():
    from stockledger.plans import oracle, registry
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["item_id", "on_hand_qty", "total_events", "total_intake", "total_consumed", "last_activity"]
