"""First / last request per key.

A window ``row_number() OVER (PARTITION BY key ...)`` would send every row of a key to one task; a key holding a
third of the batch would then be a third of the job in one task. Here the winner per key is found with an
aggregate (``min``/``max`` of the order, encoded as one fixed-width decimal — see ``order_key``), which Spark
computes partially on the map side with a hash aggregate: a hot key is reduced to one row per map task before the
shuffle. Rows are then compared with their key's winner through a
join whose build side has one row per key (AQE's skew-join handling splits the hot probe partition).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ID_OFFSET = Decimal(2 ** 63)   # shifts any long to a non-negative number below 10**20
_ID_SCALE = Decimal(10 ** 20)


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value for the order columns.

    For the (timestamp, long) order every rule job uses, ``micros(ts) * 10**20 + (id + 2**63)`` as decimal(38,0):
    exact, monotone in (ts, id), and fixed-width — so min/max over it run as hash aggregates. Other orders fall back
    to a struct (compared field by field; planned as a sort-based aggregate).
    """
    types = [df.schema[c].dataType for c in order]
    if (len(order) == 2 and isinstance(types[0], (T.TimestampNTZType, T.TimestampType))
            and isinstance(types[1], (T.LongType, T.IntegerType))):
        if isinstance(types[0], T.TimestampNTZType):  # wall-clock value: difference to the epoch, no time zone
            micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(order[0]))
        else:
            micros = F.unix_micros(F.col(order[0]))
        micros = micros.cast("decimal(38,0)")
        shifted = F.col(order[1]).cast("decimal(38,0)") + F.lit(_ID_OFFSET).cast("decimal(38,0)")
        return (micros * F.lit(_ID_SCALE).cast("decimal(38,0)") + shifted).cast("decimal(38,0)")
    return F.struct(*order)


def mark_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_first",
               last: bool = False) -> DataFrame:
    """Add boolean ``name``: is this row the first (or last) of its key group by ``order`` (a total order)?

    Rows whose key contains a NULL are each their own group (first = True), as SQL keys never match NULL.
    """
    pick = F.max if last else F.min
    win_col = f"__win_{name}"
    tmp = [f"__d{i}_{name}" for i in range(len(keys))]
    no_null_key = F.lit(True)
    for k in keys:
        no_null_key = no_null_key & F.col(k).isNotNull()
    okey = order_key(df, order)
    winners = (df.where(no_null_key)
                 .groupBy([F.col(k).alias(t) for k, t in zip(keys, tmp)])
                 .agg(pick(okey).alias(win_col)))
    cond = [F.col(k) == F.col(t) for k, t in zip(keys, tmp)]
    out = df.join(winners, cond, "left")
    flag = F.when(F.col(win_col).isNull(), F.lit(True)).otherwise(okey == F.col(win_col))
    return out.withColumn(name, flag).drop(win_col, *tmp)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key (by ``order``), all columns kept — one row per key, partial aggregation."""
    others = [c for c in df.columns if c not in keys]
    order_first = list(order) + [c for c in others if c not in order]
    packed = F.max(F.struct(*order_first)).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])
