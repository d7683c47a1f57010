"""All foreign keys by one aggregate: the same orphans as one anti join each, few exchanges, no text in them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from convops.plans import audits as A
from convops.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS
from tests.conftest import SEED_ROWS, make_tables, rows


def one_join_each(t):
    out = []
    for fk in FOREIGN_KEYS:
        (c,), (p,) = fk.columns, fk.parent_columns
        known = {r[0] for r in t[fk.parent].select(p).collect()}
        for r in t[fk.child].collect():
            if r[c] is not None and r[c] not in known:
                out.append((fk.child, "|".join(str(r[k]) for k in PRIMARY_KEYS[fk.child]), f"{c} -> {fk.parent}"))
    return sorted(out)


def changed(t, table, column, value, where="true"):
    new = t[table].withColumn(column, F.when(F.expr(where), F.lit(value).cast(t[table].schema[column].dataType))
                              .otherwise(F.col(column)))
    return t.replace(**{table: new})


def test_nothing_to_report(spark):
    t = make_tables(spark, SEED_ROWS)
    got = A.audit_foreign_keys(t)
    assert got.columns == ["rule", "table", "key", "detail"] and got.count() == 0


@pytest.mark.parametrize("broken", [FOREIGN_KEYS[i:i + 7] for i in range(0, len(FOREIGN_KEYS), 7)])
def test_every_foreign_key_is_reported(spark, broken):
    t = make_tables(spark, SEED_ROWS)
    for fk in broken:  # -7 is missing in any parent, and shared by several children
        t = changed(t, fk.child, fk.columns[0], -7)
    got = rows(A.audit_foreign_keys(t), "table", "key", "detail")
    want = one_join_each(t)
    assert got == want and want
    assert {d for _, _, d in want} >= {f"{fk.columns[0]} -> {fk.parent}" for fk in broken if t[fk.child].count()}


def test_nulls_refer_to_nothing_and_a_missing_parent_has_all_its_children(spark):
    t = make_tables(spark, SEED_ROWS)
    t = changed(t, "conversation", "workspace_id", None)
    t = t.replace(persona=t.persona.limit(0), message=t.message.unionByName(t.message))  # a repeated row counts twice
    assert rows(A.audit_foreign_keys(t), "table", "key", "detail") == one_join_each(t)


def test_one_exchange_of_ids(spark):
    plan = A.orphan_keys(make_tables(spark, SEED_ROWS))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Join" not in plan
