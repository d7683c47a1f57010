"""Column-level helpers: all built-in Spark expressions (JVM side, inside whole-stage codegen), no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: label sets picked by menu codes ------------------------------------------------------------
TOPICS = ("Billing", "Model Error", "Account", "Feature Request", "Other")


def blank_to_null(c: Column) -> Column:
    """The reference's database stores '' as NULL: trim, then empty -> NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def role_from_code(code: Column) -> Column:
    """1 -> USER, anything else (including NULL) -> AI."""
    return F.when(code == 1, "USER").otherwise("AI")


def rating_from_code(code: Column) -> Column:
    """1 -> Thumbs Up, anything else -> Thumbs Down."""
    return F.when(code == 1, "Thumbs Up").otherwise("Thumbs Down")


def visibility_from_code(code: Column) -> Column:
    """2 -> SHARED, anything else -> PRIVATE."""
    return F.when(code == 2, "SHARED").otherwise("PRIVATE")


def topic_from_code(code: Column) -> Column:
    """1..5 pick a topic in list order; anything else -> Other."""
    out = F.lit("Other")
    for i, name in reversed(list(enumerate(TOPICS, start=1))):
        out = F.when(code == i, name).otherwise(out)
    return out


def final_ticket_status(code: Column) -> Column:
    """1 -> Resolved, anything else -> Escalated."""
    return F.when(code == 1, "Resolved").otherwise("Escalated")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters (1-based SUBSTR semantics)."""
    return F.substring(text, 1, n)


def pct(part: Column, whole: Column) -> Column:
    """round(100 * part / whole, 2) as double; NULL when whole is 0."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), 2).cast("double")


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours from start to end (NULL while end is NULL), second precision."""
    return F.timestamp_diff("SECOND", start, end).cast("double") / F.lit(3600.0)


def opt_long(c: Column) -> Column:
    """An optional id typed as text: not a number -> NULL."""
    return F.trim(c.cast("string")).try_cast("long")


def no_longer_than(c: Column, n: int) -> Column:
    """Fits a text column declared with ``n`` characters (NULL fits)."""
    return F.coalesce(F.length(c) <= n, F.lit(True))
