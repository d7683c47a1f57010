"""Versioned store: new versions never overwrite, stored tables read back with their declared types, and a stored
copy of the platform tables answers exactly like the views it was made from."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from convops.plans import reports as R
from convops.plans.registry import run_job
from convops.session import checkpoint_dir
from convops.sources.binding import _MATERIALIZED, bind, load, register_materialized
from convops.sources.schemas import SCHEMAS, TABLES
from convops.sources.store import SchemaMismatch, materialize, read_table, read_version, write_tables, write_version
from tests.conftest import SF001, rows


def _types(schema):
    # file sources read every column as nullable; NOT NULL is checked by audit_not_null, not by the reader
    return [(f.name, f.dataType) for f in schema.fields]


def test_version_folders_are_never_overwritten(spark):
    t = bind(spark, SF001)
    out = os.path.join(checkpoint_dir(spark), f"version-test-{uuid.uuid4().hex[:8]}")
    res = run_job(t, "generate_invoices")
    paths = write_version(res, out)
    assert set(paths) == {"decisions", "invoice"}
    assert _types(read_table(spark, paths["invoice"], "invoice").schema) == _types(SCHEMAS["invoice"])
    assert read_table(spark, paths["invoice"], "invoice").count() == t.invoice.count() + res.accepted.count()
    assert sorted(read_version(spark, out)) == ["decisions", "invoice"]
    with pytest.raises(AnalysisException):
        write_version(res, out)
    with pytest.raises(RuntimeError):
        read_version(spark, os.path.join(out, "no-such-version"))


def test_stored_tables_answer_like_views(spark):
    t = bind(spark, SF001)
    out = os.path.join(checkpoint_dir(spark), f"platform-test-{uuid.uuid4().hex[:8]}")
    materialize(t, out)
    stored = load(spark, out, raw_dir=SF001)
    for name in TABLES:
        assert _types(stored[name].schema) == _types(SCHEMAS[name])
        assert rows(stored[name]) == rows(t[name]), name
    assert rows(R.best_persona(stored)) == rows(R.best_persona(t))
    key = os.path.normpath(SF001)
    register_materialized(SF001, out)
    try:
        assert rows(R.unpaid_invoices(bind(spark, SF001))) == rows(R.unpaid_invoices(t))
    finally:
        _MATERIALIZED.pop(key, None)


def test_a_stored_copy_gives_the_same_findings_by_path_and_by_uri(spark, tmp_path):
    from convops.plans.audits import audit_enums
    from convops.sources.binding import bind, load
    from convops.sources.store import materialize
    from tests.conftest import SF001
    folder = str(tmp_path / "platform")
    t = bind(spark, SF001)
    materialize(t, folder)
    want = rows(audit_enums(t))
    assert want and rows(audit_enums(load(spark, folder))) == rows(audit_enums(load(spark, f"file://{folder}"))) == want


def test_a_copy_that_lacks_a_column_is_refused_by_name(spark, tmp_path):
    t = bind(spark, SF001)
    folder = str(tmp_path / "platform")
    materialize(t, folder)
    broken = str(tmp_path / "broken")
    frames = {name: t[name] for name in TABLES}
    frames["invoice"] = t.invoice.drop("payment_status").withColumn("amount", F.col("amount").cast("double"))
    frames["tier"] = t.tier.withColumn("note", F.lit("more")).select("note", *reversed(t.tier.columns))
    write_tables(frames, broken)
    stored = load(spark, broken)
    with pytest.raises(SchemaMismatch, match="invoice at .*: column amount: double instead of decimal.*; column payment_status: missing"):
        stored.invoice
    assert rows(stored.tier) == rows(t.tier)  # further columns and another order change nothing
    with pytest.raises(SchemaMismatch) as e:
        read_table(spark, f"{broken}/invoice", "invoice")
    assert [c for c, _ in e.value.findings] == ["amount", "payment_status"]
    assert rows(load(spark, folder).invoice) == rows(t.invoice)
