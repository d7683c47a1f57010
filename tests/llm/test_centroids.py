import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convops.llm import centroids as cc
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, k, rounds, d):
    """Plain Python over every pair of vector and centroid."""
    kept = [(i, [max(-cc.LIMIT, min(cc.LIMIT, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(now)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                now[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept] if now else []
    total = sum(f[2] for f in found)
    inertia = {n: sum(f[2] for f in found if f[1] == n) for n in range(len(now))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, n, dist, inertia[n], total, sha[n]) for i, n, dist in found), key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1]), (500, None), (501, []), (502, [1.0]),
             (503, [1.0, None, 0.0, 0.0]), (504, [float("nan"), 0.0, 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0, 0.0]),
             (506, [0.0] * 4), (507, [0.0] * 4), (508, [-0.001] * 4)]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], SCHEMA + ", cluster long, vector string")
    got = collected(cc.digests(*cc.clusters(df.repartition(5), 9, 5, 4)))
    assert got == by_hand(rows, 9, 5, 4)


def test_few_and_none(spark):
    two = [(1, [0.5, 1.0]), (2, [3.0, -1.0])]
    assert collected(cc.digests(*cc.clusters(spark.createDataFrame(two, SCHEMA), 40, 5, 2))) == by_hand(two, 40, 5, 2)
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        df = cc.digests(*cc.clusters(spark.createDataFrame(rows, SCHEMA), 40, 5, 2))
        assert df.collect() == []
        assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r[:3] for r in collected(cc.clusters(df, 3, 2, 2)[0])] == [r[:3] for r in by_hand(rows, 3, 2, 2)]


def test_hot_vector(spark):
    rows = [(i, [0.5, 0.25]) for i in range(400)] + [(400 + i, [i / 7, -i / 3]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert collected(cc.digests(*cc.clusters(df, 12, 5, 2))) == by_hand(plain, 12, 5, 2)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF01}/embeddings.parquet'")
    want = sorted(con.execute(cc.ORACLE_SQL).fetchall(), key=repr)
    got = cc.op13_centroid_clusters(spark, SF01)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"),
                          ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert collected(got) == want and len(want) > 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 12), st.integers(1, 5), st.sampled_from([2, 30, cc.LIMIT]))
def test_walk_equals_all_distances(seed, k, d, top):
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-top, top + 1, (k, d)), rng.integers(-top, top + 1, (40, d))
    every = ((x[:, None, :] - c[None]) ** 2).sum(2)
    number, distance = cc.SortedLists(c).nearest(x, 7)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_walk_stops_early():
    """Far centroids aren't measured."""
    lists = cc.SortedLists(np.arange(1000).reshape(-1, 1).repeat(3, 1) * 100)
    measured = []
    lists.centroids = Counting(lists.centroids, measured)
    number, distance = lists.nearest(np.array([[501, 499, 500], [70_000, 70_000, 70_001]]))
    assert number.tolist() == [5, 700] and distance.tolist() == [2, 1]
    assert sum(measured) < 20


class Counting:
    def __init__(self, rows, seen):
        self.rows, self.seen, self.shape = rows, seen, rows.shape

    def __len__(self):
        return len(self.rows)

    def __getitem__(self, at):
        self.seen.append(len(at))
        return self.rows[at]


@pytest.mark.parametrize("k", [1, 2])
def test_equal_centroids(k):
    number, distance = cc.SortedLists(np.zeros((k, 2), np.int64)).nearest(np.array([[0, 0], [3, 4]]))
    assert number.tolist() == [0, 0] and distance.tolist() == [0, 25]
