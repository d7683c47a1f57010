"""The message rate limiter as a Structured Streaming query.

Requests (req_id, req_ts, conversation_id, role_code, content) arrive as files. Each request is decided when it
arrives, exactly as the batch job ``rules.admit_messages`` decides it when the arrival order follows (req_ts,
req_id):

* stream-static joins attach the conversation owner, the owner's tier limit and the owner-day's USER count already
  in the message table;
* rows that need no state (unknown conversation, AI messages, owners without a limit) are decided statelessly;
* USER rows with a limit go through ``applyInPandasWithState`` keyed by (owner, day). State = USER messages
  accepted so far that day, kept in the RocksDB state store (off-heap, incremental checkpoints). Inside a micro-batch the group's rows are taken in (req_ts, req_id) order; the function
  keeps only a running top-k (k = remaining allowance) while it reads the group's Arrow chunks, so a hot user-day
  costs O(k + chunk) memory, never the whole group. Rows without text, whose reason depends on the last of the k rows,
  wait in a temporary file of the task and are decided chunk by chunk.

Lateness (the reference has no notion of it): a watermark on req_ts with delay ``lateness``. A user-day is
*closed* once the watermark passes its end plus ``lateness``; its state is then removed by an event-time timeout.
A row that arrives for a closed day is emitted as ``rejected / late`` by the state function. Should a Spark
version discard rows behind the watermark before the function sees them, nothing is lost either: the source
folder is the request log and ``late_requests`` (an anti join of the log against the emitted decisions) returns
every undecided request as ``rejected / late``; ``complete_decisions`` is one row per request.

Arrival order decides: rows of one micro-batch are taken in (req_ts, req_id) order after all earlier batches, so
the stream equals the batch job whenever files arrive in time order (tested with multi-batch runs).
"""

from __future__ import annotations

import datetime as dt
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convops import functions as cf
from convops.plans.rules import owner_days
from convops.sources.binding import Tables
from convops.sources.store import new_version_dir

REQUEST_SCHEMA = T.StructType([
    T.StructField("req_id", T.LongType(), False),
    T.StructField("req_ts", T.TimestampNTZType(), False),
    T.StructField("conversation_id", T.LongType(), True),
    T.StructField("role_code", T.LongType(), True),
    T.StructField("content", T.StringType(), True),
])

OUTPUT_SCHEMA = "req_id long, conversation_id long, sender_role string, status string, reason string"
STATE_SCHEMA = "accepted long"
EPOCH = dt.datetime(1970, 1, 1)


def _decide_group(lateness_ms: int):
    def fn(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner_id, day = key
        if state.hasTimedOut:  # the watermark passed the day's close: its count is never needed again
            state.remove()
            return
        day_end_ms = int((dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) - EPOCH).total_seconds() * 1000)
        close_ms = day_end_ms + lateness_ms
        closed = state.getCurrentWatermarkMs() >= close_ms
        cols = ["req_id", "conversation_id", "sender_role"]
        if closed:  # the day's count is gone (or going): nothing arriving now can be decided against it
            for chunk in chunks:
                yield chunk[cols].assign(status="rejected", reason="late")
            if state.exists:
                state.remove()
            return
        accepted = state.get[0] if state.exists else None
        top = None  # running top-k rows with text of this micro-batch in (req_ts, req_id) order
        k = None
        # rows without text: refused, but only after the limit was tested
        blank, waiting = tempfile.TemporaryFile(), 0
        for chunk in chunks:
            if accepted is None:
                accepted = int(chunk["prior_n"].iloc[0]) if pd.notna(chunk["prior_n"].iloc[0]) else 0
            if k is None:
                k = max(0, int(chunk["message_limit"].iloc[0]) - accepted)
            empty = chunk.loc[~chunk["written"], [*cols, "req_ts"]]
            if len(empty):
                pickle.dump(empty, blank)
                waiting += 1
            chunk = chunk[chunk["written"]]
            pool = chunk if top is None else pd.concat([top, chunk], ignore_index=True)
            pool = pool.sort_values(["req_ts", "req_id"], kind="mergesort")
            top, spill = pool.iloc[:k], pool.iloc[k:]
            if len(spill):
                yield spill[cols].assign(status="rejected", reason="rate_limit")
        blank.seek(0)
        for _ in range(waiting):
            rows = pickle.load(blank)
            full = pd.Series(k == 0, index=rows.index)
            if k and len(top) == k:  # the limit is reached with the k-th row
                ts, rid = top["req_ts"].iloc[-1], top["req_id"].iloc[-1]
                full = (rows["req_ts"] > ts) | ((rows["req_ts"] == ts) & (rows["req_id"] > rid))
            yield rows[cols].assign(status="rejected", reason=full.map({True: "rate_limit", False: "null"}))
        blank.close()
        if top is not None and len(top):
            yield top[cols].assign(status="accepted", reason=None)
            accepted += len(top)
        if accepted is not None:
            state.update((accepted,))
            state.setTimeoutTimestamp(close_ms)
    return fn


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = new_version_dir(df.sparkSession, label=label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def admit_stream(t: Tables, requests: DataFrame, prior: DataFrame | None = None, lateness: str = "1 hour",
                 lateness_ms: int = 3_600_000) -> DataFrame:
    """Decisions for a streaming request frame (``requests.isStreaming``); same columns as the batch decisions
    minus the new message id (ids are assigned when the accepted rows are written)."""
    prior = t.message if prior is None else prior
    conv = t.conversation.select("conversation_id", F.col("user_id").alias("owner_id"))
    lim = (t.llm_user.select(F.col("user_id").alias("owner_id"), "tier_id")
           .join(t.tier.select("tier_id", "message_limit"), "tier_id").drop("tier_id"))
    # static sides of the stream-static joins: written once to the shared folder, instead of being re-derived by every
    # micro-batch or kept on executors' own disks
    lookup = _kept(conv.join(lim, "owner_id", "left"), "stream-lookup")
    prior_counts = _kept(owner_days(prior, conv).withColumnRenamed("n", "prior_n"), "stream-prior")
    d = (requests.withColumn("written", cf.blank_to_null(F.col("content")).isNotNull())
                 .withColumn("sender_role", cf.role_from_code(F.col("role_code")))
                 .withColumn("day", F.to_date("req_ts"))
                 .withColumn("event_time", F.col("req_ts").cast("timestamp"))
                 .withWatermark("event_time", lateness)
                 .join(lookup, "conversation_id", "left"))
    limited = F.col("owner_id").isNotNull() & (F.col("sender_role") == "USER") & F.col("message_limit").isNotNull()
    free = d.where(~limited).select(
        "req_id", "conversation_id", "sender_role",
        F.when(F.col("owner_id").isNull() | ~F.col("written"), "rejected").otherwise("accepted").alias("status"),
        F.when(F.col("owner_id").isNull(), "no_conversation").when(~F.col("written"), "null").alias("reason"))
    stateful = (d.where(limited).join(prior_counts, ["owner_id", "day"], "left")
                 .select("owner_id", "day", "req_id", "req_ts", "conversation_id", "sender_role", "message_limit",
                         "prior_n", "written", "event_time")
                 .groupBy("owner_id", "day")
                 .applyInPandasWithState(_decide_group(lateness_ms), OUTPUT_SCHEMA, STATE_SCHEMA,
                                         "append", GroupStateTimeout.EventTimeTimeout))
    return free.unionByName(stateful)


def late_requests(spark: SparkSession, source_dir: str, decided: DataFrame) -> DataFrame:
    """Requests in the log that the stream never decided (they were behind the watermark): rejected / late."""
    log = spark.read.schema(REQUEST_SCHEMA).parquet(source_dir)
    return (log.join(decided.select("req_id"), "req_id", "left_anti")
               .select("req_id", "conversation_id", cf.role_from_code(F.col("role_code")).alias("sender_role"),
                       F.lit("rejected").alias("status"), F.lit("late").alias("reason")))


def complete_decisions(spark: SparkSession, source_dir: str, sink_dir: str) -> DataFrame:
    """One decision per logged request: the stream's decisions plus the late ones."""
    decided = spark.read.parquet(sink_dir)
    return decided.unionByName(late_requests(spark, source_dir, decided))


def read_requests(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (off-heap, incremental checkpoints) unless a provider was chosen explicitly.
    A restarted query keeps the provider recorded in its checkpoint."""
    current = spark.conf.get(PROVIDER_CONF, None)
    if current is None or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER_CONF, ROCKSDB_PROVIDER)


def run_to_completion(decisions: DataFrame, sink_dir: str, checkpoint_location: str) -> None:
    """Process everything available (availableNow trigger) into a parquet sink; exactly-once via the checkpoint."""
    use_rocksdb_state(decisions.sparkSession)
    q = (decisions.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_location).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
