import random
import re

import pyarrow as pa
import pytest

from convops.llm import ngram_join as N
from convops.llm.hashing import shingle_sets, slices

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    out = [None, "", " \t\n ", "one", "ONE", "two words", "Two\x0bWords", "a b c d", "a b c d e", "É é", "É É"]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.45:  # a family of near copies, many close to the threshold
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(6)}"
        elif kind < 0.7:  # a passage that many documents share
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + passage
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))]
        text = " ".join(words)
        out.append(text)
        if rng.random() < 0.3:
            out.append(text.upper() if rng.random() < 0.5 else text)
    ids = rng.sample(range(10_000), len(out))
    rows = list(zip(ids, out))
    rows += [rows[20], (None, out[21]), (None, "nothing like the others at all here"), (5, "long " * 30_000)]
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("small, cell, rounds", [(48, 1 << 20, 2), (2, 300, 0), (2, 1 << 20, 1)])
def test_components_equal_all_pairs(spark, monkeypatch, small, cell, rounds):
    monkeypatch.setattr(N, "SMALL_COLUMN", small)
    monkeypatch.setattr(N, "CELL_ENTRIES", cell)
    rows = corpus(small + rounds)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, n int").repartition(3)
    assert result(N.components(docs, rounds)) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g", "k"), (1, "A B C D E F G", "k"), (2, "x", "k"), (4, None, "k"), (5, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = N.without_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 5]


def test_empty_table(spark):
    assert N.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert sorted(map(tuple, N.contract(edges).collect())) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]


def test_hashed_shingles_are_the_sets(monkeypatch):
    texts = [t for _, t in corpus(1)]
    got = list(shingle_sets(pa.array(texts)))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 5):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(shingles(texts[i]) & shingles(texts[j]))
    assert [len(s) for s in slices(pa.array(["ab", None, "c" * 50, "d"]), 3)] == [2, 1, 1]


def test_rows_decide_not_ids(spark):
    a, b = "one two three four five six seven eight nine ten eleven", "quite another text with other words in it today"
    near = a + " twelve"
    rows = [(1, a), (2, near), (2, b), (None, a), (None, near), (7, None), (7, ""), (9, b), (9, b)]
    docs = (spark.createDataFrame([(i, t, f"s{k}", k, "b", "m", "f", 1) for k, (i, t) in enumerate(rows)],
                                  "doc_id long, text string, `__slot` string, row int, `__bitmap` string, "
                                  "`_metadata` string, file string, at int").coalesce(1))
    out = N.without_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["row"], r["__slot"]) for r in out.collect()) == [(0, "s0"), (2, "s2"), (5, "s5"), (6, "s6")]
