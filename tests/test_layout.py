"""Stored tables lie in the order in which they are read by another table's id."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from convops.session import checkpoint_dir
from convops.sources import store
from convops.sources.binding import bind
from tests.conftest import SF01, rows


@pytest.mark.parametrize("name, column", [("message", "conversation_id"), ("invoice", "user_id")])
def test_an_id_lies_in_few_files(spark, name, column, monkeypatch):
    t = bind(spark, SF01)
    order = store.READ_ORDER[name]
    path = os.path.join(checkpoint_dir(spark), f"layout-{uuid.uuid4().hex[:8]}")
    monkeypatch.setattr(store, "TABLES", [name])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table in several files
    try:
        store.materialize(t, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    kept = store.read_table(spark, f"{path}/{name}", name)
    assert rows(kept) == rows(t[name])
    kept = kept.withColumn("file", F.input_file_name())
    ranges = sorted((r["low"], r["high"]) for r in kept.groupBy("file").agg(
        F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).collect())
    assert len(ranges) > 2 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    files = kept.groupBy(column).agg(F.countDistinct("file").alias("n"))
    assert files.agg(F.avg("n")).first()[0] < 1.5
