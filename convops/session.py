"""SparkSession construction and the shared checkpoint folder.

On a cluster the session comes from the launcher; we only fill in settings that are unset. Locally (tests, bench)
we build one with the same defaults.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Time zone: all platform timestamps are wall-clock (timestamp_ntz); UTC keeps any
# cast to a zoned timestamp (needed by watermarks) exact.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # reducer partitions are coalesced towards this size; skewed ones (5x the median and above 256 MB) are split
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints of finished jobs (ids, ranks, cascade levels) are removed once their frames are unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "convops", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("CONVOPS_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(k, BASE_CONF[k])
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by whoever launches the job (a folder every executor can reach). Only when it is unset
    — local tests and bench runs — do we pick a fresh scratch folder ourselves.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder every executor can reach "
                               "(jobs checkpoint there and write new table versions under it)")
        configured = tempfile.mkdtemp(prefix="convops-ckpt-")  # single-JVM runs only (tests, bench)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once and stored as Parquet under the checkpoint folder: cuts the lineage like a checkpoint, which
    would compute it twice, and gives the planner its size."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
