import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from convops.llm import exact_dedup as X
from convops.llm.shared import without

SCHEMA = "doc_id long, text string, digest string, file int, at int, kept string, row int"
ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (None, "b"), (None, "z"), (None, "z"),
        (9, "long " * 200_000), (8, "long " * 200_000), (7, "A"), (10, "a ")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3) for i, t in rows], SCHEMA)


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)



def check(df, rows):
    got = df.collect()
    want = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows})  # exactly one row of each group
    assert all(r.doc_id == r.keep_id for r in kept)


def test_groups_nulls_ties_and_clashing_columns(spark):
    check(X.dedup(frame(spark, ROWS)), ROWS)


def test_equal_digests_of_different_texts_are_told_apart_by_their_bytes(spark):
    check(X.dedup(frame(spark, ROWS), digest=lambda t: F.encode(F.substring(t, 1, 0), "utf-8")), ROWS)


def test_kept_rows_have_all_columns(spark):
    docs = frame(spark, ROWS)
    out = X.kept_rows(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    best = {}
    for i, t in ROWS:
        k = t or ""
        if k not in best or (i is not None and (best[k][0] is None or i >= best[k][0])):
            best[k] = (i, t)
    assert [(i, t or "") for i, t in got] == sorted(((i, t or "") for i, t in best.values()), key=repr)


def test_state_goes_on_in_a_second_run(spark, tmp_path):
    schema = "doc_id long, digest binary, file string, at long"
    def add(rows):
        spark.createDataFrame([(i, bytes([d]), "f", i) for i, d in rows], schema).write.mode("append").parquet(
            str(tmp_path / "prints"))
        state = X.stream_state(spark, str(tmp_path / "prints"), spark.read.parquet(str(tmp_path / "prints")).schema,
                               str(tmp_path / "state"))
        return sorted((bytes(r.digest)[0], r.stays.doc_id, r.group_size) for r in state.collect())
    assert add([(1, 7), (2, 8), (3, 7)]) == [(7, 3, 2), (8, 2, 1)]
    assert add([(5, 8), (4, 9)]) == [(7, 3, 2), (8, 5, 2), (9, 4, 1)]


def test_empty_table(spark):
    docs = frame(spark, [])
    assert X.dedup(docs).count() == 0
    assert X.kept_rows(docs).count() == 0


def test_columns_with_the_names_used_inside(spark):
    rows = [(1, "a", "m", "s", 1, True), (2, "a", "m2", "s2", 2, False), (3, "b", "m3", "s3", 3, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_metadata` string, `__slot` string, at int, maybe boolean")
    out = X.kept_rows(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[1:]
    kept = {"keep": [5, 6]}
    left = without(docs, spark.createDataFrame([(i,) for i in kept["keep"] + [1]], "doc_id long"), ["doc_id"])
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == rows[1:]
