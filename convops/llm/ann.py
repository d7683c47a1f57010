"""Nearest neighbours by largest inner product with an adaptive dimension scan.

Every vector gets one more component that makes all norms equal, so that largest inner product is smallest distance.
Vectors are dealt to lists by k-means centres (fitted on a bounded sample; every row is indexed). Lists are cut into
cells of bounded size, by vectors and by the queries that visit this list; a query visits all cells of its nearest lists.
There are about sqrt(rows) lists, at most one per 8 rows of the sample and ``max_lists``: larger tables ask for a larger
``sample`` and ``max_lists``. In a cell, vectors are randomly rotated and
compared block of columns by block: after t of D columns the partial distance estimates the whole one, and a
hypothesis test drops the candidate when the estimate is too large for the query's bound. What survives all columns
is scored exactly on the original vectors in double precision.

A query's bound is its k-th best distance in the sample, whose members are candidates like any others. How many lists
a query visits is set by brute force: for some queries the exact neighbours among all rows are found, and enough
lists are visited to hold the share ``recall`` of them.

Defined cases: vectors that are null, empty, zero, of a length other than the usual one, or that hold null or
non-finite components take no part, nor do null ids; rows of the query's own id are not its candidates; of several
rows with one id the best score counts; ties go to the smaller id; with fewer than k candidates all are returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convops.llm.shared import broadcast_value, received, stored

K = 20
QUERY_STEP = 20
SAMPLE = 8192
TRIAL_QUERIES = 64
MAX_LISTS = 1024
CELL_ROWS = 4096
COLUMNS = 16
EPSILON = 2.1
RECALL = 0.97


def valid_vectors(batch: pa.RecordBatch, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors (float64) of the rows that take part."""
    ids, vectors = [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if i is None or not v or (dim is not None and len(v) != dim) or any(c is None for c in v):
            continue
        ids.append(i)
        vectors.append(v)
    x = np.array(vectors, np.float64).reshape(len(ids), -1 if ids else (dim or 1))
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(ids, np.int64)[ok], x[ok]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        own = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, 1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class Index:
    """What all tasks share; its size depends on the sample and the number of lists only."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, rows: int, norm: float, max_lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.norm = norm
        self.ids, self.sample = ids, sample
        lists = int(np.clip(np.sqrt(rows), 1, min(max_lists, max(1, len(ids) // 8)))) if rows >= 1000 else 1
        self.centres = kmeans(self.lifted(sample), lists, rng)
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim + 1, self.dim + 1)))[0]
        self.sizes = np.zeros(lists, np.int64)
        self.visits = lists
        self.chunks = np.ones(lists, np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x ** 2).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def by_nearness(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query, nearest first (a query's added component is zero)."""
        return np.argsort((self.centres ** 2).sum(1) - 2 * q @ self.centres[:, :-1].T, 1, kind="stable")

    def visited(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists that each query visits."""
        order = self.by_nearness(q)
        enough = np.cumsum(self.sizes[order], 1) >= 2 * k
        visits = np.maximum(self.visits, np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1]))
        return [o[:n] for o, n in zip(order, visits)]

    def best_of_sample(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the sample or -1, scores) of each query's k best."""
        scores = q @ self.sample.T
        scores[query_ids[:, None] == self.ids[None, :]] = -np.inf
        k = min(k, len(self.ids))
        top = np.argpartition(-scores, k - 1, 1)[:, :k]
        found = np.take_along_axis(scores, top, 1)
        return np.where(np.isfinite(found), top, -1), found


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, each computed alike wherever its row stands."""
    return (x * q).sum(1)


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, columns: int = COLUMNS,
         epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of rotated float32 rows whose squared distance may be within ``bound`` of the query."""
    dim = x.shape[1]
    t = min(columns, dim)

    def limit(t: int) -> np.ndarray:
        slack = (1 + epsilon / np.sqrt(t)) ** 2 * t / dim if t < dim else 1.0
        return (bound * slack * (1 + 1e-5) + 1e-6).astype(np.float32)
    part = (q[:, :t] ** 2).sum(1)[:, None] + (x[:, :t] ** 2).sum(1)[None, :] - 2 * q[:, :t] @ x[:, :t].T
    qi, xi = np.nonzero(part <= limit(t)[:, None])
    d = part[qi, xi]
    while t < dim:
        end = min(t + columns, dim)
        for s in range(0, len(qi), 1 << 18):
            e = s + (1 << 18)
            d[s:e] += ((q[qi[s:e], t:end] - x[xi[s:e], t:end]) ** 2).sum(1)
        t = end
        alive = d <= limit(t)[qi]
        qi, xi, d = qi[alive], xi[alive], d[alive]
    return qi, xi


def top_rows(query_ids: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best distinct ids."""
    rows = pd.DataFrame({"query_id": query_ids, "vec_id": vec_ids, "score": scores})
    rows = rows[rows.query_id != rows.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True],
                                                           kind="stable").drop_duplicates(["query_id", "vec_id"])
    return rows[rows.groupby("query_id").cumcount() < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score double"


def neighbours(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = K, recall: float = RECALL,
               sample: int | None = None, max_lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; queries: vec_id divisible by ``query_step``.

    ``sample`` rows (default SAMPLE) fit the index and are broadcast with it; ``max_lists`` (default MAX_LISTS) bounds
    the lists.
    """
    sample, max_lists = sample or SAMPLE, max_lists or MAX_LISTS
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    usual = (vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count()
             .orderBy(F.desc("count"), "dim").first())
    dim = usual["dim"] if usual else 1

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = valid_vectors(batch, dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.sqrt((x ** 2).sum(1)))],
                ["vec_id", "vector", "norm"])
    table = vectors.mapInArrow(usable, "vec_id long, vector binary, norm double")
    facts = table.agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("norm")).first()
    if not facts["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)

    def hashed(frame: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n vectors of different ids, in the order of a hash of the ids; only they reach the driver."""
        ids = frame.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)
        some = sorted(frame.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.max("vector").alias("vector"))
                      .collect(), key=lambda r: r["vec_id"])
        return np.array([r["vec_id"] for r in some], np.int64), matrix([bytes(r["vector"]) for r in some])
    is_query = F.pmod("vec_id", F.lit(query_step)) == 0
    index = Index(*hashed(table, sample), facts["rows"], facts["norm"], max_lists)
    shared = broadcast_value(spark, index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = received(shared)
        for batch in batches:
            if batch.num_rows:
                x = index.lifted(matrix(batch.column(1).to_pylist()))
                own = np.argmin((index.centres ** 2).sum(1) - 2 * x @ index.centres.T, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own.astype(np.int32))],
                                                 ["vec_id", "vector", "list"])
    lists = stored(table.mapInArrow(assign, "vec_id long, vector binary, list int"), "ann-lists")
    for r in lists.groupBy("list").count().collect():  # at most max_lists rows
        index.sizes[r["list"]] = r["count"]

    # how many lists to visit: exact neighbours of a few queries among all rows
    trial_ids, trial = hashed(lists.where(is_query), TRIAL_QUERIES)
    if len(trial_ids):
        trials = spark.sparkContext.broadcast((trial_ids, trial))

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = trials.value
            for batch in batches:
                if batch.num_rows:
                    x, own = matrix(batch.column(1).to_pylist()), np.asarray(batch.column(2))
                    scores = q @ x.T
                    scores[ids[:, None] == np.asarray(batch.column(0))[None, :]] = -np.inf
                    top = np.argsort(-scores, 1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.arange(len(ids)), top.shape[1])), pa.array(own[top].ravel()),
                         pa.array(np.take_along_axis(scores, top, 1).ravel())], ["q", "list", "score"])
        order = Window.partitionBy("q").orderBy(F.desc("score"), "list")
        near = (lists.mapInArrow(brute, "q long, list int, score double").where("score > double('-Infinity')")
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "list").collect())
        place = np.argsort(index.by_nearness(trial), 1, kind="stable")
        ranks = np.sort([place[r["q"], r["list"]] for r in near]) if near else np.zeros(1, int)
        index.visits = int(ranks[min(len(ranks) - 1, int(recall * len(ranks)))]) + 1
    shared = broadcast_value(spark, index)

    # cells: at most about CELL_ROWS vectors by CELL_ROWS of the queries that visit the list; a hot list has many
    queries = lists.where(is_query)

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many queries visit each list, one sum per task."""
        index = received(shared)
        count = np.zeros(len(index.sizes), np.int64)
        for batch in batches:
            if batch.num_rows:
                count += np.bincount(np.concatenate(index.visited(matrix(batch.column(1).to_pylist()), k)),
                                     minlength=len(count))
        some = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["list", "n"])
    asked = queries.mapInArrow(visitors, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()
    for r in asked:  # at most max_lists rows
        index.chunks[r["list"]] = -(-r["n"] // CELL_ROWS)
    parts = [max(1, -(-n // CELL_ROWS)) for n in index.sizes.tolist()]
    shared = broadcast_value(spark, index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query, with its bound, to the cells of its lists."""
        index = received(shared)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            raw = batch.column(1).to_pylist()
            q = matrix(raw)
            _, scores = index.best_of_sample(ids, q, k)
            low = scores.min(1) if scores.shape[1] == k else np.full(len(ids), -np.inf)
            bound = np.where(np.isfinite(low), (q ** 2).sum(1) + index.norm ** 2 - 2 * low, np.inf)
            rows = [(i, v, b, int(cell), p, int(index.chunks[cell]))
                    for i, v, b, own in zip(ids.tolist(), raw, bound.tolist(), index.visited(q, k))
                    for cell in own for p in range(parts[int(cell)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.int32(),
                                                              pa.int32()))],
                ["vec_id", "vector", "bound", "list", "part", "chunks"])
    visits = (queries.mapInArrow(deal, "vec_id long, vector binary, bound double, list int, part int, chunks int")
              .withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).cast("int")))
    sizes = [(i, n, int(c)) for i, (n, c) in enumerate(zip(parts, index.chunks))]
    cells = (lists.join(F.broadcast(spark.createDataFrame(sizes, "list int, parts int, chunks int")), "list")
             .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("vec_id", "vector", "list", "part", "chunk"))

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index = received(shared)
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = matrix(vectors.vector), matrix(queries.vector)
        turned = (index.lifted(x) @ index.rotation).astype(np.float32)
        asked = (np.hstack([q, np.zeros((len(q), 1))]) @ index.rotation).astype(np.float32)
        ids, query_ids, bound = vectors.vec_id.to_numpy(), queries.vec_id.to_numpy(), queries.bound.to_numpy()
        out = []
        for s in range(0, len(q), 256):
            qi, xi = scan(turned, asked[s:s + 256], bound[s:s + 256])
            qi = qi + s
            scores = np.concatenate([exact(x[xi[a:a + 65536]], q[qi[a:a + 65536]])
                                     for a in range(0, len(qi), 65536)] or [np.zeros(0)])
            out.append(top_rows(query_ids[qi], ids[xi], scores, k))
        return pd.concat(out)
    found = (cells.groupBy("list", "part", "chunk").cogroup(visits.groupBy("list", "part", "chunk"))
             .applyInPandas(search, _FOUND))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sample's own best, as found."""
        index = received(shared)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if len(ids):
                q = matrix(batch.column(1).to_pylist())
                places, _ = index.best_of_sample(ids, q, k)
                qi, at = np.nonzero(places >= 0)
                pos = places[qi, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[qi]), pa.array(index.ids[pos]), pa.array(exact(index.sample[pos], q[qi]))],
                    ["query_id", "vec_id", "score"])
    found = found.unionByName(queries.mapInArrow(sampled, _FOUND))
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
