"""Centroid clustering with nearest centroids by the threshold algorithm.

Vectors become integers (floor of 256 times each component). To find a vector's nearest centroid, the centroids are
held in one sorted list per dimension, and each list is walked outward from the vector's own value, the nearer side
first. A centroid met for the first time is measured exactly over all dimensions. The squared distances at the frontier
of all lists add up to a bound below which no centroid that was not met can lie; the walk ends when this sum strictly
exceeds the best exact distance, so ties still go to the smallest number.

Every round is one pass over a stored table: tasks walk their vectors in blocks, add up components per cluster, and
only these sums are shuffled and only one row per cluster and dimension reaches the driver. All arithmetic is on
integers and exact.

Defined cases: vectors that are null, of another length, or that hold null or non-finite components take no part;
components beyond +-2^27 after scaling count as that bound, so a distance always fits 64 bits (sums of distances that
don't are null); repeated rows count each, and repeated ids may start several centroids; a null id never starts a
centroid, but its vector is assigned; with fewer ids than centroids each one starts a centroid, and without any
(or on an empty table) the result is empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.shared import broadcast_value, discard, received, stored

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
LIMIT = 1 << 27
#: Vectors that are walked together.
BLOCK = 2048
_ASSIGNED = "vec_id long, cluster int, distance long"
_SUMS = "cluster int, dimension int, total long, rows long"


def whole_numbers(batch: pa.RecordBatch, dimensions: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer vectors of the rows of (vec_id, embedding) that take part."""
    ids, lists = batch.column(0), batch.column(1)
    size = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dimensions)
    flat = lists.take(pa.array(rows)).flatten()
    values = np.asarray(flat.fill_null(np.nan), np.float64).reshape(len(rows), dimensions)
    ok = np.isfinite(values).all(1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(values[ok] * scale), -LIMIT, LIMIT).astype(np.int64)
    return ids.take(pa.array(rows[ok])), x


class SortedLists:
    """Centroids in one list per dimension, sorted by their value there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, d = centroids.shape
        self.order = np.argsort(centroids, 0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, 1)

    def nearest(self, x: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid, of equally near ones the smallest number."""
        found = [self._walk(x[s:s + block]) for s in range(0, len(x), block)]
        return (np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)]),
                np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)]))

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        k = len(self.centroids)
        far = np.int64(1) << 61  # beyond any squared difference of components
        right = np.stack([np.searchsorted(self.values[j], x[:, j]) for j in range(d)], 1)
        left = right - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        met = np.zeros((n, k), bool)
        walking = np.arange(n)
        dims = np.arange(d)
        for _ in range(k):  # every step advances each list by one
            a, b, own = left[walking], right[walking], x[walking]
            below = np.where(a >= 0, (own - self.values[dims, np.maximum(a, 0)]) ** 2, far)
            above = np.where(b < k, (own - self.values[dims, np.minimum(b, k - 1)]) ** 2, far)
            down = below <= above
            here = self.order[dims, np.where(down, np.maximum(a, 0), np.minimum(b, k - 1))]
            left[walking], right[walking] = a - down, b + ~down
            new = np.zeros((len(walking), k), bool)
            new[np.arange(len(walking))[:, None], here] = True
            row, centroid = np.nonzero(new & ~met[walking])
            met[walking] |= new
            if len(row):  # exact distances of the centroids met now
                distance = ((own[row] - self.centroids[centroid]) ** 2).sum(1)
                order = np.lexsort((centroid, distance, row))
                first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                at, value, which = walking[row[first]], distance[first], centroid[first]
                better = (value < best[at]) | ((value == best[at]) & (which < number[at]))
                best[at[better]], number[at[better]] = value[better], which[better]
            # in floats, so that sums of large squares can't overflow, and a little less than the sum
            frontier = np.minimum(below, above).astype(np.float64).sum(1) * (1 - 1e-12)
            walking = walking[frontier <= best[walking].astype(np.float64) * (1 + 1e-12)]
            if not len(walking):
                break
        return number, best


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dimensions).astype(np.int64)


def kept(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id, vector (32-bit little-endian integers) of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_numbers(batch, dimensions, scale)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["vec_id", "vector"])
    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .mapInArrow(run, "vec_id long, vector binary"))


def cluster_sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (rows, component sums); one row per cluster and dimension leaves each task and reaches the driver."""
    k, d = centroids.shape
    shared = broadcast_value(table.sparkSession, SortedLists(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = received(shared)
        total, rows = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            number, _ = lists.nearest(x)
            np.add.at(total, number, x)
            rows += np.bincount(number, minlength=k)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, d).astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(some))),
             pa.array(total[some].ravel()), pa.array(np.repeat(rows[some], d))],
            ["cluster", "dimension", "total", "rows"])
    sums = (table.select("vector").mapInArrow(run, _SUMS).groupBy("cluster", "dimension")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():
        out.setdefault(r["cluster"], (r["rows"], [0] * d))[1][r["dimension"]] = int(r["total"])
    return out


def fitted(table: DataFrame, centroids: int, rounds: int, dimensions: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds over ``table`` (vec_id, vector)."""
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    start = (table.where("vec_id IS NOT NULL").select(key.alias("key"), "vector").orderBy("key", "vector")
             .limit(centroids).collect())
    now = np.array([np.frombuffer(r["vector"], "<i4") for r in start], np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(now) else 0):
        new = now.copy()
        for number, (rows, total) in cluster_sums(table, now).items():
            new[number] = [t // rows for t in total]
        if (new == now).all():
            break
        now = new
    return now


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every row of ``table``."""
    shared = broadcast_value(table.sparkSession, SortedLists(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = received(shared)
        for batch in batches:
            number, distance = lists.nearest(matrix(batch.column(1), lists.centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])
    return table.mapInArrow(run, _ASSIGNED)


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector that takes part; the centroids)."""
    table = stored(kept(vectors, dimensions, scale), "centroids-vectors")
    final = fitted(table, centroids, rounds, dimensions)
    if not len(final):
        return vectors.sparkSession.createDataFrame([], _ASSIGNED), final
    out = stored(assigned(table, final), "centroids-assigned")
    discard(vectors.sparkSession, table)
    return out, final


def digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the inertia of each row's cluster and of all, and the hash of the row's centroid."""
    sums = {r["cluster"]: int(r["sum"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}  # at most one row a centroid

    def long(n: int) -> int | None:
        return n if n < 1 << 63 else None
    facts = found.sparkSession.createDataFrame(
        [(i, long(sums[i]), long(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for i, c in enumerate(centroids.tolist()) if i in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (found.join(F.broadcast(facts), "cluster")  # one row a centroid
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _oracle() -> str:
    """The same rounds in SQL, every distance measured."""
    parts = [f"""kept AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""", f"""
c0 AS (
  SELECT row_number() OVER (ORDER BY key) - 1 AS cluster, v
  FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS key, v FROM kept ORDER BY key LIMIT {CENTROIDS}))"""]
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.v, c.v)])"
    for r in range(ROUNDS + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.row, k.vec_id, k.v, c.cluster, {distance} AS d FROM kept k, c{r} c)
  GROUP BY row, vec_id, v)""")
        if r < ROUNDS:
            parts.append(f"""
m{r} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS v
  FROM (SELECT cluster, dim, sum(x) AS s, count(*) AS n
        FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{r}) GROUP BY cluster, dim)
  GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return "WITH " + ",".join(parts) + f"""
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


ORACLE_SQL = _oracle()
