"""Versioned parquet store for rule-job outputs.

A job never overwrites a table in place: each run writes a new version folder (``errorifexists``), and readers
load a version with the explicit schemas of ``schemas.SCHEMAS``. Folders live under a caller-given root — on a
cluster a shared location; by default the session's ``spark.checkpoint.dir`` (never a machine-local temp dir).
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from convops.session import checkpoint_dir
from convops.sources.schemas import PRIMARY_KEYS, SCHEMAS, TABLES


def new_version_dir(spark: SparkSession, root: str | None = None, label: str = "v") -> str:
    base = root or os.path.join(checkpoint_dir(spark), "versions")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex[:12]}")


def write_tables(tables: dict[str, DataFrame], out_dir: str, concurrency: int = 4) -> dict[str, str]:
    """Write each table to ``out_dir/<name>`` (fails if it exists). Returns name -> path.

    The writes are independent jobs; up to ``concurrency`` are submitted at once from driver threads so the
    scheduler can interleave their tasks (small tables no longer wait for each other). Any failure is raised.
    """
    paths = {name: os.path.join(out_dir, name) for name in tables}

    def write(name: str) -> None:
        tables[name].write.mode("errorifexists").parquet(paths[name])

    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        for done in [pool.submit(write, name) for name in tables]:
            done.result()
    return paths


COMPLETE_MARKER = "_version_complete"


def write_version(result, out_dir: str) -> dict[str, str]:
    """Persist a ``JobResult``: its decisions plus every new table version, then a completion marker.

    The marker (a one-row parquet listing the tables) is written with Spark after every table write succeeded,
    so it works on any file system the cluster uses; ``read_version`` refuses folders without it. A failed run
    leaves an unmarked folder that no reader picks up; a rerun writes a fresh folder.
    """
    frames = {"decisions": result.decisions, **result.tables}
    paths = write_tables(frames, out_dir)
    spark = result.decisions.sparkSession
    spark.createDataFrame([(",".join(sorted(paths)),)], "tables string").coalesce(1) \
        .write.mode("errorifexists").parquet(os.path.join(out_dir, COMPLETE_MARKER))
    return paths


def read_version(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of a completed version folder (typed where the table is a platform table)."""
    try:
        names = spark.read.parquet(os.path.join(out_dir, COMPLETE_MARKER)).first()["tables"].split(",")
    except Exception as e:  # no marker: the version was never completed
        raise RuntimeError(f"{out_dir} is not a completed version") from e
    return {name: read_table(spark, os.path.join(out_dir, name), name) for name in names}


class SchemaMismatch(ValueError):
    """Stored files that don't hold the columns of their table; ``findings`` has one (column, problem) each."""

    def __init__(self, name: str, path: str, findings: list[tuple[str, str]]):
        self.findings = findings
        super().__init__(f"{name} at {path}: " + "; ".join(f"column {c}: {problem}" for c, problem in findings))


def schema_findings(found: StructType, wanted: StructType) -> list[tuple[str, str]]:
    """(column, problem) for every column that is missing or of another type. Further columns are no problem: they
    aren't read. Names are compared as Spark resolves them, in any case."""
    types: dict[str, list] = {}
    for f in found.fields:
        types.setdefault(f.name.lower(), []).append(f.dataType)
    out = []
    for f in wanted.fields:
        own = types.get(f.name.lower(), [])
        if not own:
            out.append((f.name, "missing"))
        elif len(own) > 1:
            out.append((f.name, "there more than once"))
        elif own[0] != f.dataType:
            out.append((f.name, f"{own[0].simpleString()} instead of {f.dataType.simpleString()}"))
    return out


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its declared types.

    Reading with a given schema would turn a column that the files don't have into NULLs without a word, so the files'
    own schema (from a footer, no rows) is compared first and a table with a finding is refused.
    """
    if name not in SCHEMAS:
        return spark.read.parquet(path)
    findings = schema_findings(spark.read.parquet(path).schema, SCHEMAS[name])
    if findings:
        raise SchemaMismatch(name, path, findings)
    return spark.read.schema(SCHEMAS[name]).parquet(path)


#: Tables read by the id of another table: stored in the order in which these reads want them, not by primary key.
READ_ORDER = {
    "message": ("conversation_id", "time_sent", "message_id"),
    "message_raw": ("conversation_id", "time_sent", "message_id"),
    "invoice": ("user_id", "invoice_date", "invoice_id"),
}


def materialize(t, out_dir: str) -> dict[str, str]:
    """Store the platform tables of ``t`` once (the production shape: tables at rest, not views).

    Each table is range-partitioned and sorted before writing: by ``READ_ORDER`` where it has one (one conversation's
    messages and one user's invoices lie together, in the order they are listed), else by its primary key. So files hold
    disjoint ranges, and parquet min/max statistics let a filter on the leading column skip row groups; as the order
    ends with a unique column, a hot conversation or user is spread over files. A table with a ``READ_ORDER`` has no such
    skipping on its primary key. ``message_raw`` (the feed before the role filter, read by the enum audit) belongs to
    every stored copy.
    """
    frames = {}
    for name in [*TABLES, "message_raw"]:
        order = list(READ_ORDER.get(name) or PRIMARY_KEYS[name])
        frames[name] = t[name].repartitionByRange(*order).sortWithinPartitions(*order)
    return write_tables(frames, out_dir)
