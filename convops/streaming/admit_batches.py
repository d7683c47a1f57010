"""The message rate limiter as a stream of batches over a stored count table.

``admit_stream`` keeps a user-day's count in the state store, which gives each user-day of a micro-batch to one task.
Here every micro-batch is a batch job (``foreachBatch``): the running rank that splits hot user-days over tasks
(``running_rank``) is added to the counts that earlier batches left in a table (owner_id, day, n), so a user-day with a
third of a batch is as good as any other, and no row waits on an executor's own disk.

* Conversations, owners and tiers are read by every batch, from the tables that ``tables`` gives it: what was created
  after the query started is seen by the next batch.
* Batch k reads the counts that the batch before it left, writes its decisions to ``decisions/batch_id=k`` and then the
  counts ``counts/k``, both by replacing what an earlier attempt may have left. A batch that failed half-way, or whose end
  the stream did not note, runs again on the same files and the same counts and gives the same rows.
* The counts start (``counts/start``) from the messages that are there before the first batch.
* A day is closed once an earlier batch has seen a time ``lateness`` past its end. Counts of closed days are left out of
  the table; USER rows with a limit that arrive for a closed day are ``rejected / late``, as in ``admit_stream``.

Arrival order decides, as in ``admit_stream``: rows of one batch are taken in (req_ts, req_id) order after all earlier
batches. Null request ids or times are not allowed by the request schema; an empty batch leaves the counts as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops import functions as cf
from convops.operators.decide import with_reason
from convops.operators.ranking import running_rank
from convops.plans.rules import owner_days
from convops.session import checkpoint_dir, kept
from convops.sources.binding import Tables

COUNTS = "owner_id long, day date, n long, seen timestamp_ntz"
DECISIONS = "req_id long, conversation_id long, sender_role string, status string, reason string, batch_id long"
START = "start"


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def _before(spark: SparkSession, root: str, batch_id: int) -> str:
    """The counts that the batch before this one left."""
    path = f"{root}/counts/{batch_id - 1 if batch_id else START}"
    if not _complete(spark, path):
        raise RuntimeError(f"no counts at {path}: batch {batch_id} can't run before the one it follows")
    return path


def write_start(root: str, tables: Tables, prior: DataFrame | None = None) -> None:
    """The counts before the first batch, unless an earlier start of the query wrote them."""
    path = f"{root}/counts/{START}"
    if _complete(tables.spark, path):
        return
    conv = tables.conversation.select("conversation_id", F.col("user_id").alias("owner_id"))
    counts = owner_days(tables.message if prior is None else prior, conv)
    counts.select("owner_id", "day", "n", F.lit(None).cast("timestamp_ntz").alias("seen")).write.mode("overwrite").parquet(path)


def decide_batch(requests: DataFrame, batch_id: int, root: str, tables: Tables, lateness: str) -> None:
    """Decisions of one batch, then the counts for the next one."""
    spark = requests.sparkSession
    checkpoint_dir(spark)
    before = spark.read.schema(COUNTS).parquet(_before(spark, root, batch_id))
    closed_to = before.agg(F.max("seen").alias("seen")).first()["seen"]

    def is_closed(day):
        if closed_to is None:
            return F.lit(False)
        return F.expr(f"timestamp_ntz '{closed_to}' - interval {lateness}") >= F.date_add(day, 1).cast("timestamp_ntz")
    conv = tables.conversation.select("conversation_id", F.col("user_id").alias("owner_id"))
    lim = (tables.llm_user.select(F.col("user_id").alias("owner_id"), "tier_id")
           .join(tables.tier.select("tier_id", "message_limit"), "tier_id").drop("tier_id"))
    # no text goes further than this
    narrow = requests.select("req_id", "req_ts", "conversation_id", cf.role_from_code(F.col("role_code")).alias("sender_role"),
                             cf.blank_to_null(F.col("content")).isNotNull().alias("written"),
                             F.to_date("req_ts").alias("day"))
    d = kept(narrow.join(conv, "conversation_id", "left").join(lim, "owner_id", "left")
             .withColumn("limited", F.col("owner_id").isNotNull() & (F.col("sender_role") == "USER")
                         & F.col("message_limit").isNotNull())
             .withColumn("late", F.col("limited") & is_closed(F.col("day"))), "admit-batch")
    ranks = running_rank(d.where("limited AND NOT late").select("req_id", "req_ts", "owner_id", "day", "written", "message_limit"),
                         ["owner_id", "day"], "req_ts", ["req_id"], "day_rank", counts_if="written")
    over = (ranks.join(before.where("owner_id IS NOT NULL").select("owner_id", "day", "n"), ["owner_id", "day"], "left")
            .where(F.coalesce("n", F.lit(0)) + F.col("day_rank") > F.col("message_limit"))
            .select("req_id", F.lit(True).alias("over")))
    decided = kept(with_reason(d.join(over, "req_id", "left"),
                               [("no_conversation", F.col("owner_id").isNotNull()), ("late", ~F.col("late")),
                                ("rate_limit", F.col("over").isNull()), ("null", F.col("written"))])
                   .select("req_id", "conversation_id", "sender_role", "status", "reason", "owner_id", "day", "req_ts"),
                   "admit-decided")
    (decided.select("req_id", "conversation_id", "sender_role", "status", "reason")
     .write.mode("overwrite").parquet(f"{root}/decisions/batch_id={batch_id}"))
    added = (decided.where("status = 'accepted' AND sender_role = 'USER'").groupBy("owner_id", "day")
             .agg(F.count(F.lit(1)).alias("n")))
    counts = (before.where("owner_id IS NOT NULL").select("owner_id", "day", "n").where(~is_closed(F.col("day")))
              .unionByName(added).groupBy("owner_id", "day").agg(F.sum("n").alias("n")))
    seen = (decided.select(F.col("req_ts").alias("seen")).unionByName(before.select("seen"))
            .agg(F.max("seen").alias("seen")))
    (counts.withColumn("seen", F.lit(None).cast("timestamp_ntz"))
     .unionByName(seen.select(F.lit(None).cast("long").alias("owner_id"), F.lit(None).cast("date").alias("day"),
                              F.lit(None).cast("long").alias("n"), "seen"))
     .write.mode("overwrite").parquet(f"{root}/counts/{batch_id}"))


def admit_in_batches(requests: DataFrame, root: str, tables: Callable[[SparkSession], Tables],
                     prior: DataFrame | None = None, lateness: str = "1 hour") -> DataFrame:
    """Run the stream over everything that is there and return all decisions so far.

    ``root`` holds the stream's progress, the counts and the decisions; called again with the same ``root`` it goes on
    where the last run ended.
    """
    write_start(root, tables(requests.sparkSession), prior)

    def step(batch: DataFrame, batch_id: int) -> None:
        decide_batch(batch, batch_id, root, tables(batch.sparkSession), lateness)
    query = (requests.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/_checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return decisions(requests.sparkSession, root)


def decisions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DECISIONS).parquet(f"{root}/decisions").drop("batch_id")
