"""The skew-aware building blocks against brute-force window formulations, on inputs where one key holds a third
(or more) of all rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from convops.operators.dedup import last_per_key, mark_first
from convops.operators.ids import assign_ids
from convops.operators.ranking import running_rank
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rnd.randint(1, 50)       # key 0 holds a third of the rows
        day = rnd.randint(0, 2)
        ts = T0 + dt.timedelta(days=day, seconds=rnd.randint(0, 86399))
        data.append((i, key, ts))
    return spark.createDataFrame(data, "req_id long, k long, req_ts timestamp_ntz")


def test_running_rank_equals_window(spark):
    df = _skewed(spark).withColumn("day", F.to_date("req_ts"))
    brute = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("k", "day").orderBy("req_ts", "req_id")).cast("long"))
    for parts in (None, 3, 16):
        got = running_rank(df, ["k", "day"], "req_ts", ["req_id"], "rank", num_partitions=parts)
        assert rows(got, "req_id", "rank") == rows(brute, "req_id", "rank"), parts


def test_running_rank_same_timestamp_everywhere(spark):
    # every row at one instant: the tie-break column alone orders the group
    df = spark.range(500).select(F.col("id").alias("req_id"), F.lit(1).alias("k"),
                                 F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("req_ts"))
    got = running_rank(df, ["k"], "req_ts", ["req_id"], "rank", num_partitions=8)
    assert rows(got, "req_id", "rank") == sorted([(i, i + 1) for i in range(500)], key=repr)
    # the single hot group really is spread over several range partitions
    spread = (df.repartitionByRange(8, "k", "req_ts", "req_id").select(F.spark_partition_id().alias("p"))
              .distinct().count())
    assert spread > 1


def test_mark_first_and_last(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("req_ts", "req_id")
    brute = df.withColumn("is_first", F.row_number().over(w) == 1)
    assert rows(mark_first(df, ["k"], ["req_ts", "req_id"]), "req_id", "is_first") == rows(brute, "req_id", "is_first")
    last = last_per_key(df, ["k"], ["req_ts", "req_id"])
    brute_last = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("req_ts"),
                                                                                        F.desc("req_id"))))
    assert rows(last, "k", "req_id") == rows(brute_last.where("rn = 1"), "k", "req_id")


def test_mark_first_null_keys_are_their_own_group(spark):
    df = spark.createDataFrame([(1, None, T0), (2, None, T0), (3, 5, T0), (4, 5, T0)],
                               "req_id long, k long, req_ts timestamp_ntz")
    assert rows(mark_first(df, ["k"], ["req_ts", "req_id"]), "req_id", "is_first") == [
        (1, True), (2, True), (3, True), (4, False)]


def test_assign_ids_dense_in_order(spark):
    df = _skewed(spark).repartition(7)
    base = spark.range(1).select(F.lit(1000).cast("long")).scalar()
    got = assign_ids(df, ["req_ts", "req_id"], base, "new_id")
    brute = df.withColumn("new_id", (F.lit(1000) + F.row_number().over(Window.orderBy("req_ts", "req_id"))).cast("long"))
    assert rows(got, "req_id", "new_id") == rows(brute, "req_id", "new_id")


def test_mark_first_ignores_session_time_zone(spark):
    # wall-clock (timestamp_ntz) order must not depend on the session zone, not even across a DST fall-back hour
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1, 1, dt.datetime(2024, 11, 3, 1, 45)), (2, 1, dt.datetime(2024, 11, 3, 1, 15)),
                                    (3, 1, dt.datetime(2024, 11, 3, 0, 59))], "req_id long, k long, req_ts timestamp_ntz")
        got = rows(mark_first(df, ["k"], ["req_ts", "req_id"]), "req_id", "is_first")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(1, False), (2, False), (3, True)]
