"""Existence flags and key lookups.

The reference probes one id at a time (``SELECT 1 ... WHERE key = ?``). Here a whole request table is probed in one
join: ``flag_exists`` left-joins the request rows against the *key set* of the other table and turns a match into a
boolean column, so several guards can be evaluated side by side and reported in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(on: Mapping[str, str] | Sequence[str] | str) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(c, c) for c in on]


def flag_exists(df: DataFrame, other: DataFrame, on, name: str, *, unique: bool = False,
                where: Column | None = None) -> DataFrame:
    """Add boolean ``name``: does ``other`` (optionally filtered by ``where``) hold a row matching ``on``?

    ``on`` maps request columns to ``other`` columns. ``unique=True`` says the matched columns are a key of
    ``other`` (skips the distinct, no extra shuffle); otherwise the key set is de-duplicated first — an aggregate
    with a map-side partial step, so a hot key collapses before the shuffle.
    """
    pairs = _pairs(on)
    if where is not None:
        other = other.where(where)
    tmp = [f"__k{i}_{name}" for i in range(len(pairs))]
    keys = other.select([F.col(r).alias(k) for (_, r), k in zip(pairs, tmp)])
    if not unique:
        keys = keys.distinct()
    keys = keys.withColumn(f"__hit_{name}", F.lit(True))
    cond = [F.col(left) == F.col(k) for (left, _), k in zip(pairs, tmp)]
    joined = df.join(keys, cond, "left")
    return joined.withColumn(name, F.coalesce(F.col(f"__hit_{name}"), F.lit(False))).drop(*tmp, f"__hit_{name}")

