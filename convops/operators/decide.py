"""Ordered rejection reasons and the decision frame of a rule job.

Every rule job turns a request table into decisions: one row per request with ``status`` ('accepted' /
'rejected') and ``reason`` (NULL when accepted). Reasons are evaluated in the order given; the first failing check
wins, exactly like the reference's sequence of early returns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED = "accepted"
REJECTED = "rejected"


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """``checks`` = [(reason, ok_condition), ...]. NULL conditions count as failures."""
    out = F.lit(None).cast("string")
    for reason, ok in reversed(list(checks)):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def with_reason(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    reason = first_failure(checks)
    return (df.withColumn("reason", reason)
              .withColumn("status", F.when(F.col("reason").isNull(), F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))))


class JobResult:
    """Outputs of one rule job.

    decisions  one row per request: req_id, status, reason, plus job-specific columns (e.g. the new id)
    tables     new versions of the platform tables the job changed (name -> DataFrame). Built on first access
               when given as ``build`` — a decisions-only caller never pays for e.g. a delete cascade.
    """

    def __init__(self, decisions: DataFrame, tables: dict[str, DataFrame] | None = None,
                 build: Callable[[], dict[str, DataFrame]] | None = None):
        self.decisions = decisions
        self._tables = tables
        self._build = build

    @property
    def tables(self) -> dict[str, DataFrame]:
        if self._tables is None:
            self._tables = self._build() if self._build else {}
        return self._tables

    @property
    def accepted(self) -> DataFrame:
        return self.decisions.where(F.col("status") == ACCEPTED)

    @property
    def rejected(self) -> DataFrame:
        return self.decisions.where(F.col("status") == REJECTED)
