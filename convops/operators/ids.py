"""Dense new surrogate ids in a global order — the set-at-a-time form of an id sequence.

``max(id) + row_number() OVER (ORDER BY ...)`` without a partition moves every row into one task. Instead
(the zipWithIndex idea, in DataFrame form):

1. range-partition and sort by the order columns; tag each row with its partition id and a within-partition
   position (``monotonically_increasing_id`` counts up by one inside a partition);
2. checkpoint that tagging to the shared checkpoint folder so every later use — and any recomputation after an
   executor loss — sees the same assignment;
3. count rows per partition — one row per partition, a bounded table — and take running offsets over it;
4. id = base + offset(partition) + position within partition + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convops.session import checkpoint_dir


def assign_ids(df: DataFrame, order: Sequence[str], base: Column, id_col: str) -> DataFrame:
    """Add ``id_col`` = base + 1, base + 2, ... following ``order`` (which must be a total order).

    ``base`` is a scalar column, typically ``existing.select(coalesce(max(id), 0)).scalar()``.
    """
    checkpoint_dir(df.sparkSession)
    tagged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("__p", F.spark_partition_id())
                .withColumn("__m", F.monotonically_increasing_id()))
    tagged = tagged.checkpoint(eager=True)
    per_part = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
    # one row per partition: the only data that meets in a single window partition is the partition count table
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("__p", "__m0", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = tagged.join(F.broadcast(offsets), "__p")
    new_id = base.cast("long") + F.col("__off") + (F.col("__m") - F.col("__m0")) + F.lit(1)
    return out.withColumn(id_col, new_id.cast("long")).drop("__p", "__m", "__m0", "__off")


def max_id(df: DataFrame, col: str) -> Column:
    """Scalar subquery: the largest existing id (0 for an empty table)."""
    return df.select(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()
