"""Running minima and maxima within a group that never put a hot group into one task.

Like ``running_rank``: rows are range-partitioned on (group, order), which cuts a hot group into contiguous runs over
several partitions, and the assignment is stored. A value over all rows before (or after) a row is the value
within its run combined with that of the group's earlier (later) runs, which is a window over one row per group and
partition. Group and order columns must be non-null and the order total within a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convops.session import kept


def in_runs(df: DataFrame, group: Sequence[str], order: str, parts: int) -> DataFrame:
    """``df`` cut into ``parts`` contiguous runs of (group, order), with the run's number in ``__run``; stored.

    A single run, for rows that one task can hold, is ``df`` itself.
    """
    if parts == 1:
        return df.withColumn("__run", F.lit(0))
    return kept(df.repartitionByRange(parts, *group, order).withColumn("__run", F.spark_partition_id()), "runs")


def running(runs: DataFrame, parts: int, group: Sequence[str], order: str, values: Mapping[str, Column], *,
            largest: bool = True, following: bool = False) -> DataFrame:
    """``runs`` with, per name, the largest (or least) value over all rows of the group before (or after) this row.

    Null values are passed by; without any value the result is null. With several runs the result is stored, as
    ``runs`` is read twice.
    """
    pick, best = (F.max, F.greatest) if largest else (F.min, F.least)

    def by(c: str) -> Column:
        return F.col(c).desc() if following else F.col(c).asc()
    before = (Window.unboundedPreceding, -1)
    here = Window.partitionBy("__run", *group).orderBy(by(order)).rowsBetween(*before)
    local = runs.select("*", *(pick(v).over(here).alias(n) for n, v in values.items()))
    if parts == 1:
        return local
    there = Window.partitionBy(*group).orderBy(by("__run")).rowsBetween(*before)
    per_run = runs.groupBy(*group, "__run").agg(*(pick(v).alias(n) for n, v in values.items()))
    others = per_run.select(*group, "__run", *(pick(n).over(there).alias(f"__{n}") for n in values))
    out = local.join(others, [*group, "__run"])
    return kept(out.select(*runs.columns, *(best(F.col(n), F.col(f"__{n}")).alias(n) for n in values)), "running")
