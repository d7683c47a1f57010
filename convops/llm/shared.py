"""Scratch tables in the shared folder and small column helpers used by all operators of this subpackage."""

from __future__ import annotations

import gc
import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for this call, under the folder named by spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a cut of the lineage that any executor
    can reread after another one is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, *what: DataFrame | str) -> None:
    """Remove scratch tables (frames from ``stored``, or paths) that nothing reads any more, and let Spark's cleaner
    drop the shuffle files of finished steps, which it does when the driver collects its garbage."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for one in what:
        path = hadoop.Path(one if isinstance(one, str) else one._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes that Spark hands to a Python worker at a time: whole texts are long, and buffers outside the heap on
#: both sides grow with a batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage: heap that an earlier step filled, and buffers outside the heap that only the
    collector frees, go back to the system before the next step takes its own. A task on every free core does it."""
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("done"))
    collected.write.format("noop").mode("overwrite").save()


def broadcast_value(spark: SparkSession, value):
    """A broadcast of any value, classes of this subpackage included; ``received`` reads it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared):
    return pickle.loads(shared.value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


#: Bits of the membership filter below: 4 MB at most are broadcast, however many keys there are.
FILTER_BITS = 1 << 25


def flagged(df: DataFrame, keys: DataFrame, on: list[str], flag: str = "maybe") -> DataFrame:
    """``df`` with a boolean that is true for every row whose ``on`` columns occur in ``keys`` (and for some others).

    A hashed bitmap of fixed size, built in Spark, goes to all tasks, so a join that follows needs to shuffle the
    flagged rows only. With very many keys it flags everything and costs nothing but its own pass.
    """
    def slot(columns):
        return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))

    def named(c: str):
        return F.col(f"`{c}`")
    bits = (keys.select(slot([named(c) for c in on]).alias("slot"))
            .groupBy(F.shiftright("slot", 15).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")))
    rows = (df.select(F.struct(*(named(c) for c in df.columns)).alias("row"), slot([named(c) for c in on]).alias("slot"))
            .withColumn("bucket", F.shiftright("slot", 15)))
    return (rows.join(F.broadcast(bits), "bucket", "left")
            .withColumn("maybe", F.coalesce(
                F.expr("shiftright(cast(conv(hex(substring(bits, cast(((slot & 32767) >> 3) + 1 AS int), 1)), 16, 10)"
                       " AS int), cast(slot & 7 AS int)) & 1 = 1"), F.lit(False)))
            .select("row.*", F.col("maybe").alias(flag)))


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``on`` columns don't occur in ``keys``; only rows that the filter flags are shuffled."""
    names = [f"key{i}" for i in range(len(on))]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
                     *(F.col(f"`{c}`").alias(n) for c, n in zip(on, names)))
    gone = keys.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(on, names)))
    marked = flagged(rows, gone, names)
    return (marked.where(~F.col("maybe")).select("row.*")
            .unionByName(marked.where("maybe").join(gone, names, "left_anti").select("row.*")))
