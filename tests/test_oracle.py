"""Layer 2: every registered key against its independent DuckDB SQL at sf0.01 (the driver's correctness gate),
plus the flagship entry point at sf0.001."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from convops.plans import registry
from tests.conftest import SF01
from tests.oracle_check import compare_key, duck

# the optional training-data queries have their own tests
ORACLE = registry.oracle_sql()
QUERIES = {k: q for k, q in E.queries().items() if k in registry.queries()}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_key_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_key_matches_oracle(spark, con, key):
    res = compare_key(spark, con, QUERIES, ORACLE, key, SF01)
    assert res["cols_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["values_match"], res


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["persona_id", "persona", "thumbs_up_pct", "total_ratings"]
    assert df.count() == 1
