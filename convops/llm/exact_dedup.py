"""Exact dedup by stateful streaming.

Every document becomes a fingerprint (digest of the whole text, document id, content locator). A Structured
Streaming aggregation keyed by digest keeps, in RocksDB state without expiry, the digest, the id of the row that
stays, its content locator (file and row) and the group's size. The state is read back with the state data source;
digests hit by more than one row are then checked on full bytes against the text found at the retained locator.
Everything is DataFrame operations: rows of a hot group are combined before each shuffle, and the join that hands
the state back to the documents is one whose skewed partitions Spark splits.

Defined cases: null text counts as empty; rows with null ``doc_id`` take part and lose against any id; of equal
rows (same id, same text) the one later in storage stays, so exactly one row of a group is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from convops.llm.shared import discard, documents, flagged, scratch, stored, without

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # all stores of an executor share this memory; what doesn't fit is on its disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # a store is closed when its task ends: memory and local files are those of the tasks that run
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, file, at): each row with the place of its content in a stored file.

    A frame that isn't read from files, whose plan hides the files, or that has a column named like the place's own is
    written to the shared folder first.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    if "_metadata" not in map(str.lower, docs.columns):
        try:
            return docs.select(row, *place)
        except AnalysisException:
            pass
    return stored(docs.select(row), "dedup-docs").select("row", *place)


def stream_state(spark: SparkSession, prints: str, schema, state_dir: str, batch_bytes: int = 16 << 30) -> DataFrame:
    """Run the stream of fingerprint files at ``prints`` to its end; the keyed state as a frame.

    With a ``state_dir`` used before, only files added since are read and the state goes on from there.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(prints)
    # whole texts are never in the state: digest, id, locator and a count
    keyed = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "at")).alias("stays"),
                                         F.count(F.lit(1)).alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = (keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_dir)
    values = [f.name for f in state.schema["value"].dataType.fields]  # the two aggregates, in order
    return state.select(F.col("key.digest").alias("digest"),
                        F.col("value").getField(values[0]).alias("stays"),
                        F.col("value").getField(values[1]).alias("group_size"))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: file, at, doc_id, digest, keep_id, group_size, kept.

    ``digest`` may be any function of the text: documents whose digests meet but whose bytes differ are grouped
    by their bytes.
    """
    return grouped(located(docs), digest)


def grouped(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``dedup`` of rows that have their places (``located``)."""
    spark = rows.sparkSession
    content = F.coalesce(F.col("row.text"), F.lit(""))
    prints_df = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), digest(content).alias("digest"),
                            "file", "at")
    prints_path = scratch(spark, "dedup-prints")
    prints_df.write.parquet(prints_path)
    prints = spark.read.schema(prints_df.schema).parquet(prints_path)
    state_dir = scratch(spark, "dedup-state")
    state = stored(stream_state(spark, prints_path, prints_df.schema, state_dir), "dedup-groups")
    discard(spark, state_dir)

    # full bytes on hits: each distinct (digest, text) among the hits against the text at the retained locator
    hit = state.where(F.col("group_size") > 1).select("digest", "stays.file", "stays.at")
    texts = rows.select(content.alias("text"), digest(content).alias("digest"), "file", "at")
    hits = (flagged(texts, hit, ["digest"]).where("maybe").join(hit.select("digest"), "digest", "left_semi")
            .select("digest", "text").distinct())
    retained = (flagged(texts, hit, ["file", "at"]).where("maybe")
                .join(hit.select("file", "at"), ["file", "at"], "left_semi")
                .select("digest", F.col("text").alias("retained")))
    unequal = stored(hits.join(retained, "digest").where(F.col("text") != F.col("retained"))
                     .select("digest").distinct(), "dedup-unequal")
    groups = state
    if unequal.take(1):  # two texts under one digest: group these rows by the text itself
        apart = texts.join(unequal, "digest", "left_semi")
        own = (apart.join(rows.select("file", "at", F.col("row.doc_id").cast("long").alias("doc_id")), ["file", "at"])
               .groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "at")).alias("stays"),
                                              F.count(F.lit(1)).alias("group_size")))
        by_row = (apart.join(own, ["digest", "text"])
                  .select("file", "at", F.col("stays").alias("own_stays"), F.col("group_size").alias("own_size")))
        prints = prints.join(by_row, ["file", "at"], "left")
    else:
        kind = state.schema["stays"].dataType
        prints = prints.select("*", F.lit(None).cast(kind).alias("own_stays"), F.lit(None).cast("long").alias("own_size"))
    stays = F.coalesce("own_stays", "stays")
    out = prints.join(groups, "digest").select(
        "file", "at", "doc_id", "digest", stays["doc_id"].alias("keep_id"),
        F.coalesce("own_size", "group_size").alias("group_size"),
        ((F.col("file") == stays["file"]) & (F.col("at") == stays["at"])).alias("kept"))
    return out


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = located(docs)
    gone = stored(grouped(rows).where(~F.col("kept")).select("file", "at"), "dedup-gone")
    return without(rows, gone, ["file", "at"]).select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
