"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and reread as the next one's
``docs``. All but the last return the columns of ``documents``; the last returns the packed pieces.

Whatever else ``docs`` holds is kept and never read: rows with null ids or texts pass through as the operators define.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm import exact_dedup, ngram_join, packing, pii, quality
from convops.llm.shared import documents, give_back, small_batches, stored


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of ``sf_dir``, scores below its threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, quality.learnable(labels))
    return quality.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a shingle similarity of 0.8 or more, directly or over others, the one with the smallest id stays
    (of equal ids the earliest in storage)."""
    return ngram_join.without_near_copies(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become surrogates; n_chars, where there is one, follows the text."""
    out = pii.replaced_rows(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left has one place in a sequence of at most 1024."""
    return packing.digests(packing.pack(docs, **packing.public_vocabulary()))


def _bounded(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        give_back(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, _bounded(stage)) for name, stage in [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", replace_personal_data),
    ("packing", pack_sequences),
]]

ORACLE_SQL = None  # model fitting, keyed surrogates and tokenisation are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
