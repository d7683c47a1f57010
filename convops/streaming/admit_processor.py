"""The message rate limiter as a stateful processor that owns its counts (``transformWithStateInPandas``).

``admit_stream`` looks the prior count of a user-day up in a static table at each micro-batch. Here the counts live in the
processor alone:

* **Initial state.** The first batch hands the counts of the messages that are there to the processor, once per
  (owner, day); no later batch joins counts. A restarted query goes on from its own state.
* **Stored messages.** ``stored`` is an optional second stream of messages that others wrote after the start. They pass no
  test; they count from the batch on that sees them, before the requests of that batch. So a limiter that runs on, or
  comes back after a stop, knows messages that it didn't admit itself. What this stream accepted must not come back there.
* **Timers.** Each open user-day has one event-time timer at its close (its end plus ``lateness``); when the watermark
  passes it, the day's state goes.
* **Late rows** reach the processor, which answers ``rejected / late`` for requests of a closed day: the event-time column
  that Spark would drop them by stays behind the watermark operator.

A user-day's rows are one group. Of those with text only the running first k (k = what is left of the limit) are held;
rows without text, whose reason depends on the k-th row, wait in a list state of the group, which RocksDB keeps outside
the worker's memory, and are gone at the end of the batch.

Arrival order decides: the rows of one batch are taken in (req_ts, req_id) order after all earlier batches, so the stream
equals ``rules.admit_messages`` whenever files arrive in time order. Requests without an owner or a limit and AI messages
need no state. Null request ids or times are not allowed by the request schema; stored messages with a null time or
conversation are ignored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle,
                                                      TimerValues)

from convops import functions as cf
from convops.plans.rules import owner_days
from convops.session import kept
from convops.sources.binding import Tables
from convops.streaming.admit_stream import OUTPUT_SCHEMA

COLS = ["req_id", "conversation_id", "sender_role"]
WAITING = "req_id long, conversation_id long, sender_role string, req_ts timestamp_ntz"


class DayLimit(StatefulProcessor):
    """Messages used by one (owner, day) and the decisions that follow from them."""

    def __init__(self, lateness_ms: int):
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n long")
        self.waiting = handle.getListState("waiting", WAITING)

    def _close_ms(self, day: dt.date) -> int:
        return (day - dt.date(1970, 1, 1)).days * 86_400_000 + 86_400_000 + self.lateness_ms

    def _count(self, day: dt.date, n: int) -> None:
        """The day's count from now on; the first one starts its timer."""
        if not self.used.exists():
            self.handle.registerTimer(self._close_ms(day))
        self.used.update((n,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self._count(key[1], int(initialState["n"].sum()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        day = key[1]
        if timerValues.getCurrentWatermarkInMs() >= self._close_ms(day):
            for chunk in rows:
                asked = chunk.loc[~chunk["is_stored"], COLS]
                if len(asked):
                    yield asked.assign(status="rejected", reason="late")
            return
        before = self.used.get()[0] if self.used.exists() else 0
        top, limit, others, blank = None, 0, 0, False
        for chunk in rows:
            others += int(chunk["is_stored"].sum())
            chunk = chunk[~chunk["is_stored"]]
            if not len(chunk):
                continue
            limit = int(chunk["message_limit"].iloc[0])
            empty = chunk.loc[~chunk["written"], [*COLS, "req_ts"]]
            if len(empty):
                self.waiting.appendList([(int(r), int(c), s, ts.to_pydatetime())
                                         for r, c, s, ts in empty.itertuples(index=False)])
                blank = True
            chunk = chunk[chunk["written"]]
            pool = chunk if top is None else pd.concat([top, chunk], ignore_index=True)
            pool = pool.sort_values(["req_ts", "req_id"], kind="mergesort")
            left = max(0, limit - before - others)
            top, over = pool.iloc[:left], pool.iloc[left:]
            if len(over):
                yield over[COLS].assign(status="rejected", reason="rate_limit")
        left = max(0, limit - before - others)  # stored messages that came after the last request counted too
        if top is not None and len(top) > left:
            top, over = top.iloc[:left], top.iloc[left:]
            yield over[COLS].assign(status="rejected", reason="rate_limit")
        if blank:
            yield from self._unwritten(top, left)
        if top is not None and len(top):
            yield top[COLS].assign(status="accepted", reason=None)
        self._count(day, before + others + (0 if top is None else len(top)))

    def _unwritten(self, top: pd.DataFrame | None, left: int, rows: int = 10_000) -> Iterator[pd.DataFrame]:
        """Rows without text: over the limit once the last free place is taken, refused for the text before that."""
        last = None
        if left and top is not None and len(top) == left:
            last = (top["req_ts"].iloc[-1], top["req_id"].iloc[-1])
        part = []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(part, columns=[*COLS, "reason"]).assign(status="rejected")[[*COLS, "status", "reason"]]
        for req_id, conversation_id, role, ts in self.waiting.get():
            full = not left or (last is not None and (pd.Timestamp(ts), req_id) > last)
            part.append((req_id, conversation_id, role, "rate_limit" if full else "null"))
            if len(part) == rows:
                yield frame()
                part.clear()
        if part:
            yield frame()
        self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_processor(t: Tables, requests: DataFrame, prior: DataFrame | None = None, stored: DataFrame | None = None,
                    lateness: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """Decisions for a streaming request frame: req_id, conversation_id, sender_role, status, reason.

    ``prior`` (default: the message table) gives the counts of the first batch. ``stored`` is a streaming frame with the
    message table's conversation_id, sender_role and time_sent.
    """
    prior = t.message if prior is None else prior
    conv = t.conversation.select("conversation_id", F.col("user_id").alias("owner_id"))
    lim = (t.llm_user.select(F.col("user_id").alias("owner_id"), "tier_id")
           .join(t.tier.select("tier_id", "message_limit"), "tier_id").drop("tier_id")
           .where("message_limit IS NOT NULL"))
    # the static side of the stream: who owns a conversation and the owner's limit, written once for all micro-batches
    lookup = kept(conv.join(lim, "owner_id", "left"), "processor-lookup")
    # stored: the initial state is planned with the stream and its expressions travel to the tasks (no subqueries)
    start = kept(owner_days(prior, conv).join(lim.select("owner_id"), "owner_id", "left_semi"), "processor-start")
    # no text goes further than this
    rows = requests.select("req_id", "req_ts", "conversation_id", cf.role_from_code(F.col("role_code")).alias("sender_role"),
                           cf.blank_to_null(F.col("content")).isNotNull().alias("written"),
                           F.lit(False).alias("is_stored"))
    if stored is not None:
        rows = rows.unionByName(
            stored.where("sender_role = 'USER' AND time_sent IS NOT NULL")
            .select(F.lit(None).cast("long").alias("req_id"), F.col("time_sent").alias("req_ts"), "conversation_id",
                    "sender_role", F.lit(True).alias("written"), F.lit(True).alias("is_stored")))
    d = (rows.withColumn("event_time", F.col("req_ts").cast("timestamp"))
             .withWatermark("event_time", f"{int(lateness.total_seconds() * 1000)} milliseconds")
             .withColumn("day", F.to_date("req_ts"))
             .join(lookup, "conversation_id", "left"))
    limited = F.col("owner_id").isNotNull() & (F.col("sender_role") == "USER") & F.col("message_limit").isNotNull()
    free = d.where(~limited & ~F.col("is_stored")).select(
        "req_id", "conversation_id", "sender_role",
        F.when(F.col("owner_id").isNull() | ~F.col("written"), "rejected").otherwise("accepted").alias("status"),
        F.when(F.col("owner_id").isNull(), "no_conversation").when(~F.col("written"), "null").alias("reason"))
    # without event_time: a column that carries the watermark would let Spark drop late rows before they are answered
    days = d.where(limited).select("owner_id", "day", "req_id", "req_ts", "conversation_id", "sender_role",
                                   "message_limit", "written", "is_stored")
    decided = days.groupBy("owner_id", "day").transformWithStateInPandas(
        DayLimit(int(lateness.total_seconds() * 1000)), OUTPUT_SCHEMA, "append", "eventTime",
        start.select("owner_id", "day", "n").groupBy("owner_id", "day"))
    return free.unionByName(decided)
