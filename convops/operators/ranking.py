"""Running rank within a group that never puts a hot group into one task.

``rank = row_number() OVER (PARTITION BY group ORDER BY ts, tiebreak)`` sends a whole group to one task; if one
user-day held a third of all messages, so would one task. Instead:

1. range-partition on the *full* order key (group, ts, tiebreak): the sampled range bounds split a hot group into
   several partitions, each a contiguous run of the group's order — however the rows are spread over time;
2. checkpoint the tagging (partition id per row) to the shared checkpoint folder, so both uses below — and any
   recomputation after an executor loss — see the same assignment;
3. rank rows within (partition, group): a window whose partitions are runs, bounded by partition size;
4. count rows per (group, partition) — at most #groups + #partitions rows, since runs are contiguous — and take
   per group the running total of earlier partitions (a window over that small count table);
5. rank = offset + local rank.

Exact (equal to the single window) because runs are contiguous in the order. Group columns must be non-null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convops.session import checkpoint_dir


def running_rank(df: DataFrame, group: Sequence[str], ts: str, tiebreak: Sequence[str], name: str = "rank",
                 num_partitions: int | None = None, counts_if: str | None = None) -> DataFrame:
    """``counts_if``: a boolean column; rows where it is false get the rank they would have, but use none up."""
    order = [*group, ts, *tiebreak]
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = ranged.withColumn("__p", F.spark_partition_id()).checkpoint(eager=True)
    local = Window.partitionBy("__p", *group).orderBy(F.col(ts), *[F.col(c) for c in tiebreak])
    one = F.col(counts_if).cast("int") if counts_if else F.lit(1)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tagged.withColumn("__local", F.sum(one).over(upto) + F.lit(1) - one)
    counts = tagged.groupBy(*group, "__p").agg(F.sum(one).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = ranked.join(offsets, [*group, "__p"], "inner")
    return out.withColumn(name, (F.col("__off") + F.col("__local")).cast("long")).drop("__p", "__off", "__local")
