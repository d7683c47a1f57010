"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence matrix.

A document's row holds its distinct five-word shingles. Documents with the same row are one class. A class needs to
meet others only in its first n - need + 1 columns of one global order of the columns (rare ones first): two classes
with enough overlap share one of them. Columns are dealt to tasks by hash, so each task multiplies its own block of
columns; what is known from sizes and positions bounds the overlap of a pair, and pairs below the overlap that their
sizes ask for are discarded before any full overlap is counted.

To order columns their frequency must be known, which needs every (class, column) entry once in a shuffle. Half of the
columns (those with the smaller hashes) come first and are ordered by frequency; the other half follows in the order of
the hashes and enters only where a class has too few of the first. Entries of columns with one class go no further.

Large groups of near copies: only which documents hang together is asked for, so pairs are not enumerated. In each
column all classes are compared with one pivot, links are contracted to components, and the next round compares only
classes of different components with another pivot. What is left is done exactly: in small columns pair by pair; in
large ones in cells of bounded size, where overlaps are accumulated row by row over the cell's own columns and only
links that join two components leave the cell.

Defined cases: null text is empty; a document without words has no shingles, is linked with nothing and is its own
component; fewer than five words make one shingle; documents with null ids take part, and a component's id is its
smallest non-null id; repeated rows are one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convops.llm.exact_dedup import located
from convops.llm.hashing import shingle_sets
from convops.llm.shared import discard, documents, flagged, stored, without

#: Jaccard of at least 80 / 100: 100 * overlap >= 80 * union.
PER_CENT = 80
ROUNDS = 2
SMALL_COLUMN = 48
#: Entries of the incidence matrix in one side of a cell.
CELL_ENTRIES = 1 << 20
_HALF = np.uint64(1 << 63)


def probing(n: Column) -> Column:
    return n - F.expr(f"({PER_CENT} * n + 99) div 100") + 1


def indexing(n: Column) -> Column:
    """Columns in which a class meets classes that are no smaller: n - ceil(2t / (1 + t) n) + 1."""
    return n - F.expr(f"({2 * PER_CENT} * n + {99 + PER_CENT}) div {100 + PER_CENT}") + 1


def _key(row: np.ndarray, salt: int) -> tuple[int, bytes]:
    digest = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8, salt=salt.to_bytes(8, "big")).digest(), "big",
                          signed=True), digest


def class_rows(docs: DataFrame, salt: int) -> DataFrame:
    """doc_id, n, key, digest, early and the columns of ``docs`` after the text: the shingle set's size, identity and
    number of columns of the first half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in shingle_sets(batch.column(1)):
                key, digest = _key(row, salt) if len(row) else (None, None)
                rows.append((len(row), key, digest, int(np.searchsorted(row, _HALF))))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(),
                                                                           pa.int64()))] + batch.columns[2:],
                ["doc_id", "n", "key", "digest", "early", *carried])
    carried = docs.columns[2:]
    schema = "doc_id long, n long, key long, digest binary, early long"
    return docs.mapInArrow(run, ", ".join([schema, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)]))


def entries(docs: DataFrame, salt: int) -> DataFrame:
    """key, columns: the columns of each class that may be among its first, once a class and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, columns, held = [], [], 0
            for row in shingle_sets(batch.column(1)):
                if len(row):
                    key, _ = _key(row, salt)
                    if key in seen:
                        continue
                    seen.add(key)
                    n = len(row)
                    first = max(int(np.searchsorted(row, _HALF)), n - (PER_CENT * n + 99) // 100 + 1)
                    keys.append(key)
                    columns.append(row[:first].view(np.int64))
                    held += first
                    if held > 1 << 19:
                        yield _listed(keys, columns, "columns")
                        keys, columns, held = [], [], 0
            if keys:
                yield _listed(keys, columns, "columns")
    return docs.mapInArrow(run, "key long, columns array<bigint>")


def whole_rows(docs: DataFrame, salt: int) -> DataFrame:
    """key, columns: each document's whole row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns, held = [], [], 0
            for row in shingle_sets(batch.column(1)):
                if len(row):
                    keys.append(_key(row, salt)[0])
                    columns.append(row.view(np.int64))
                    held += len(row)
                    if held > 1 << 19:
                        yield _listed(keys, columns, "columns")
                        keys, columns, held = [], [], 0
            if keys:
                yield _listed(keys, columns, "columns")
    return docs.mapInArrow(run, "key long, columns array<bigint>")


def _listed(keys: list[int], columns: list[np.ndarray], name: str) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(columns)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["key", name])


def first_columns(docs: DataFrame, classes: DataFrame, salt: int) -> DataFrame:
    """token, key, n, at: the shared columns among each class' first ones, and their places in its order."""
    by_token = Window.partitionBy("token")
    shared = (entries(docs, salt).select("key", F.explode("columns").alias("token"))
              .withColumn("df", F.count(F.lit(1)).over(by_token)).where(F.col("df") > 1)
              .dropDuplicates(["token", "key"])  # copies read by different tasks
              .withColumn("df", F.count(F.lit(1)).over(by_token)).where(F.col("df") > 1))
    rows = (shared.groupBy("key").agg(F.collect_list(F.struct("df", "token")).alias("all"))
            .join(classes.select("key", "n", "early"), "key"))
    early = F.sort_array(F.filter("all", lambda c: c["token"] >= 0))
    late = F.array_sort(F.filter("all", lambda c: c["token"] < 0)["token"])
    placed = (rows.withColumn("first", early["token"]).withColumn("then", late)
              .select("key", "n", "early", F.size("first").alias("k"),
                      F.posexplode(F.concat("first", "then")).alias("i", "token"))
              .withColumn("at", F.when(F.col("i") < F.col("k"), F.col("early") - F.col("k") + F.col("i"))
                          .otherwise(F.col("early") + F.col("i") - F.col("k")))
              .where(F.col("at") < probing(F.col("n"))).select("token", "key", "n", "at"))
    indexed = (F.col("at") < indexing(F.col("n"))).cast("int")
    return (placed.withColumn("members", F.count(F.lit(1)).over(by_token))
            .withColumn("index", indexed).withColumn("indexed", F.sum("index").over(by_token))
            .where((F.col("members") > 1) & (F.col("indexed") > 0)).select("token", "key", "n", "at", "index"))


def possible(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """May this pair, which shares a column at these places, have the overlap that its sizes ask for?"""
    less = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["key"] < b["key"]))
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    indexed = F.when(less, a["index"]).otherwise(b["index"]) == 1
    rest = F.least(a["n"] - a["at"], b["n"] - b["at"])
    return (indexed & (small * 100 >= large * PER_CENT)
            & (rest * (100 + PER_CENT) >= (a["n"] + b["n"]) * PER_CENT))


def overlapping(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose whole rows overlap enough."""
    one = rows.select(F.col("key").alias("a"), F.col("columns").alias("row_a"))
    two = rows.select(F.col("key").alias("b"), F.col("columns").alias("row_b"))
    both = F.size(F.array_intersect("row_a", "row_b"))
    return (pairs.join(one, "a").join(two, "b")
            .withColumn("both", both)
            .where(F.col("both") * (100 + PER_CENT) >= (F.size("row_a") + F.size("row_b")) * PER_CENT)
            .drop("row_a", "row_b", "both"))


def contract(edges: DataFrame) -> DataFrame | None:
    """node, root: the smallest node reachable over ``edges`` (u, v); None without edges.

    Every node goes to its smallest neighbour, the edges are mapped along, until none is left.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                   .distinct(), "near-edges")
    roots = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent"))
                    .withColumn("parent", F.least("node", "parent")), "near-parents")
        a, b = up.toDF("u", "pu"), up.toDF("v", "pv")
        fewer = stored(edges.join(a, "u").join(b, "v").where("pu <> pv")
                       .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
                       "near-edges")
        if roots is None:
            roots, old = stored(up.withColumnRenamed("parent", "root"), "near-roots"), []
        else:
            old = [roots]
            roots = stored(roots.join(up.withColumnRenamed("node", "root"), "root", "left")
                           .select("node", F.coalesce("parent", "root").alias("root")), "near-roots")
        discard(spark, edges, up, *old)
        edges = fewer
    discard(spark, edges)
    return roots


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (key, comp) after joining the components (u, v) that the stored ``links`` connect; both stored
    inputs are used up."""
    spark = labels.sparkSession
    roots = contract(links.select("u", "v"))
    if roots is None:
        discard(spark, links)
        return labels
    out = stored(labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
                 .select("key", F.coalesce("root", "comp").alias("comp")), "near-labels")
    discard(spark, labels, links, roots)
    return out


def pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """a, b, u, v: each column's members against its pivot, if they are in different components."""
    by_token = Window.partitionBy("token")
    # first the class with the largest share of shared columns, later others by hash
    order = F.col("at") * 1000 / F.col("n") if turn == 0 else F.xxhash64("key", F.lit(turn))
    # ``at`` of the first shared column tells how many columns only this class has
    mark = F.struct(order.cast("double").alias("order"), "key", "n", "at", "index", "comp")
    found = members.withColumn("pivot", F.min(F.when(F.col("index") == 1, mark)).over(by_token))
    me = {c: F.col(c) for c in ("key", "n", "at", "index")}
    it = {c: F.col("pivot")[c] for c in me}
    ok = (F.col("comp") != F.col("pivot.comp")) & possible(me, it)
    swap = F.col("key") > F.col("pivot.key")
    return (found.where(ok).select(
        F.when(swap, F.col("pivot.key")).otherwise(F.col("key")).alias("a"),
        F.when(swap, F.col("key")).otherwise(F.col("pivot.key")).alias("b"),
        F.when(swap, F.col("pivot.comp")).otherwise(F.col("comp")).alias("u"),
        F.when(swap, F.col("comp")).otherwise(F.col("pivot.comp")).alias("v")).distinct())


def divided(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of columns that still hold several components, with the column's size and entries."""
    by_token = Window.partitionBy("token")
    return (columns.join(labels, "key").withColumn("low", F.min("comp").over(by_token))
            .withColumn("high", F.max("comp").over(by_token)).where("low <> high")
            .withColumn("size", F.count(F.lit(1)).over(by_token))
            .withColumn("total", F.sum("n").over(by_token)).drop("low", "high"))


def small_pairs(members: DataFrame) -> DataFrame:
    """a, b, u, v: all possible pairs of different components within columns of at most SMALL_COLUMN members."""
    one = F.struct("n", "key", "at", "index", "comp")
    lists = members.groupBy("token").agg(F.sort_array(F.collect_list(one)).alias("all"))
    pairs = (lists.select("all", F.posexplode("all").alias("i", "x"))
             .select("x", F.explode(F.slice("all", F.col("i") + 2, F.lit(SMALL_COLUMN))).alias("y")))
    x, y = ({c: F.col(side)[c] for c in ("n", "key", "at", "index")} for side in ("x", "y"))
    swap = F.col("x.key") > F.col("y.key")
    return (pairs.where((F.col("x.comp") != F.col("y.comp")) & possible(x, y))
            .select(F.when(swap, F.col("y.key")).otherwise(F.col("x.key")).alias("a"),
                    F.when(swap, F.col("x.key")).otherwise(F.col("y.key")).alias("b"),
                    F.when(swap, F.col("y.comp")).otherwise(F.col("x.comp")).alias("u"),
                    F.when(swap, F.col("x.comp")).otherwise(F.col("y.comp")).alias("v")).distinct())


def cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """u, v: links that join components, from the product of a cell's incidence matrix with itself."""
    rows = [np.asarray(c, np.int64) for c in cell["columns"]]
    n = np.array([len(r) for r in rows])
    comp = cell["comp"].to_numpy()
    _, column = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), n)
    order = np.argsort(column, kind="stable")
    by_column = row[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(column))])
    at = np.concatenate([[0], np.cumsum(n)])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c
    values, counts = np.unique(comp, return_counts=True)
    common = values[np.argmax(counts)]
    out = []
    for i in np.flatnonzero(comp != common):  # of two components one is not the most common
        mine = column[at[i]:at[i + 1]]
        both = np.bincount(np.concatenate([by_column[start[c]:start[c + 1]] for c in mine]), minlength=len(rows))
        for j in np.flatnonzero((both * (100 + PER_CENT) >= (n[i] + n) * PER_CENT) & (comp != comp[i])):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((int(comp[i]), int(comp[j])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def large_links(members: DataFrame, rows: DataFrame) -> DataFrame:
    """u, v: links of different components within large columns, cell by cell; every pair meets in one cell."""
    sides = F.ceil(F.col("total") / F.lit(CELL_ENTRIES)).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(5)), F.col("sides")).cast("int")
    cells = (members.select("token", "key", "comp", sides.alias("sides")).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
             .select("token", "key", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    return (cells.join(rows, "key").groupBy("token", "i", "j")
            .applyInPandas(lambda cell: cell_links(cell), "u long, v long"))


def components(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return labelled(docs, rounds).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, component and what else ``docs`` (doc_id, text, ...) has, for each of its rows.

    component: one number for all rows of a component, null without shingles (ids may be null or repeated).
    """
    spark = docs.sparkSession
    carried = docs.columns[2:]
    salt = 0
    while True:
        table = stored(class_rows(docs, salt), "near-docs")
        clash = (table.where("key IS NOT NULL").groupBy("key")
                 .agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y"))
        if not clash.take(1):
            break
        salt += 1  # two different rows with one 64-bit key: other keys
    docs = docs.select("doc_id", "text")
    classes = stored(table.where("key IS NOT NULL").groupBy("key")
                     .agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("early").alias("early")),
                     "near-classes")
    columns = stored(first_columns(docs, classes, salt), "near-columns")
    labels = stored(columns.select("key").distinct().withColumn("comp", F.col("key")), "near-labels")

    # whole rows of the classes that are left, read again from the texts that hold them
    def named(df: DataFrame, c: str) -> DataFrame:
        return df.withColumn("id", F.coalesce(F.col(c), F.lit(-(1 << 63))))
    wanted = named(classes.join(labels.select("key"), "key"), "rep").select("key", "id")
    texts = flagged(named(docs, "doc_id"), wanted, ["id"]).where("maybe").select("doc_id", "text")
    rows = stored(whole_rows(texts, salt).join(wanted.select("key"), "key", "left_semi")
                  .groupBy("key").agg(F.first("columns").alias("columns")), "near-rows")

    for turn in range(rounds):
        members = columns.join(labels, "key") if turn == 0 else divided(columns, labels)
        links = stored(overlapping(pivot_pairs(members, turn), rows), "near-links")
        labels = relabelled(labels, links)
    members = stored(divided(columns, labels), "near-members")
    small = overlapping(small_pairs(members.where(F.col("size") <= SMALL_COLUMN)), rows).select("u", "v")
    labels = relabelled(labels, stored(small, "near-links"))
    large = divided(columns.join(members.where(F.col("size") > SMALL_COLUMN).select("token").distinct(), "token",
                                 "left_semi"), labels)
    labels = relabelled(labels, stored(large_links(large, rows), "near-links"))
    discard(spark, columns, rows, members)

    joined = labels.join(classes.select("key", "rep"), "key")
    lowest = joined.groupBy("comp").agg(F.min("rep").alias("lowest"))
    named_classes = (classes.select("key", "rep")
                     .join(labels.join(lowest, "comp").select("key", "comp", "lowest"), "key", "left")
                     .select("key", F.coalesce("lowest", "rep").alias("component_id"),
                             F.coalesce("comp", "key").alias("component")))
    some = (table.where("key IS NOT NULL").join(named_classes, "key")
            .select("doc_id", "n", "component_id", "component", *carried))
    none = table.where("key IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"),
                                             F.lit(None).cast("long").alias("component"), *carried)
    return some.unionByName(none).withColumnRenamed("n", "n_shingles")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null ids last), of equal ids the one
    earliest in storage. Rows without words all stay."""
    rows = located(docs)
    found = stored(labelled(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"),
                                        F.col("row.text").cast("string").alias("text"), "file", "at"))
                   .where("component IS NOT NULL").select("component", "doc_id", "file", "at"), "near-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")
    groups = (found.groupBy("component").agg(F.min(order).alias("stays"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("component", F.col("stays.file").alias("first"), F.col("stays.at").alias("first_at")))
    gone = stored(found.join(groups, "component").where("file <> first OR at <> first_at").select("file", "at"),
                  "near-gone")
    return without(rows, gone, ["file", "at"]).select("row.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))
