import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convops.llm import toxicity as tx
from convops.llm.quality import lasso
from convops.llm.shared import documents
from tests.conftest import SF01

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def plain_terms(text):
    out = set()
    for w in WORD.findall((text or "").lower()):
        raw = w.encode()
        out |= {(0, raw)} | {(n, raw[:n]) for n in tx.PREFIXES if len(raw) > n}
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abcdefgh XY1.,é\n"), max_size=30)), max_size=6))
def test_terms_equal_plain_words(texts):
    """As many terms as plain words and stems, and equal terms for equal ones across texts."""
    sets = list(tx.term_sets(pa.array(texts, pa.string())))
    want = [plain_terms(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for a, x in zip(sets, want):
        for b, y in zip(sets, want):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_margin_equals_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = tx.Machine(np.arange(9, dtype=np.uint64), rng.normal(size=9), rng.normal(size=(9, 3)), 0.3)
    rows = [[0, 3, 8], [], [1], [2, 4, 5, 6, 7]]
    got = m.margin(np.array(sum(rows, [])), np.cumsum([0, *map(len, rows)]))
    want = [0.3 + sum(m.weights[i] for i in r)
            + sum(m.vectors[a] @ m.vectors[b] for k, a in enumerate(r) for b in r[k + 1:]) for r in rows]
    assert np.allclose(got, want)


def test_learns_a_pair_that_weights_miss():
    """Toxic only when an insult stands beside a group: each alone is clean."""
    rng = np.random.default_rng(5)
    filler = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(2400):
        kind = i % 4
        words = list(rng.choice(filler, 12)) + ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(float(kind == 3))
    y = np.array(y)
    sets = list(tx.term_sets(pa.array(texts)))
    model = tx.fit(sets[:1600], y[:1600])
    got = model.scores(pa.array(texts[1600:]))
    assert ((got >= 0.5) == (y[1600:] == 1)).mean() > 0.98
    keys = {k: model.vectors[i] for i, k in enumerate(model.keys.tolist())}
    a, b = (int(next(tx.term_sets(pa.array([w])))[np.isin(next(tx.term_sets(pa.array([w]))), model.keys)][0])
            for w in ("insult", "group"))
    assert keys[a] @ keys[b] > 1
    # the additive part alone
    vocabulary = {k: i for i, k in enumerate(np.unique(np.concatenate(sets)).tolist())}
    x = np.zeros((len(sets), len(vocabulary)))
    for i, s in enumerate(sets):
        x[i, [vocabulary[k] for k in s.tolist()]] = 1
    w = lasso(x[:1600], y[:1600], 0.001)
    z = x[1600:] @ w[:-1] + w[-1]
    loss = -np.log(1 / (1 + np.exp(-np.where(y[1600:] == 1, z, -z)))).mean()
    own = -np.log(np.where(y[1600:] == 1, got, 1 - got)).mean()
    assert own < loss / 2


def test_defined_cases(spark):
    rows = [(i, "you idiot moron" if i % 2 else "a fine day") for i in range(40)]
    docs = spark.createDataFrame(rows + [(None, None), (40, ""), (1, "you idiot moron"), (41, "x" * 200_000)], SCHEMA)
    docs = docs.selectExpr("*", "'x' AS score", "1 AS toxic", "text AS terms")
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(40)] + [(None, 1, "t"), (3, None, "t"), (999, 1, "t"),
                                                                          (1, 1, "t")], "doc_id long, toxic int, text string")
    model = tx.learn(docs, labels)
    out = [(r["doc_id"], r["score"]) for r in tx.scored(docs, model).collect()]
    assert len(out) == 44
    by_id = {}
    for i, s in out:
        by_id.setdefault(i, []).append(s)
    base = 1 / (1 + np.exp(-model.intercept))
    assert by_id[40] == [base] == by_id[None] == by_id[41] and len(set(by_id[1])) == 1
    assert all((by_id[i][0] >= 0.5) == bool(i % 2) for i in range(40))


@pytest.mark.parametrize("labels,share", [([], 0.5), ([(0, 1), (1, 1)], 1.0), ([(0, 0)], 0.0)])
def test_without_both_labels(spark, labels, share):
    docs = spark.createDataFrame([(0, "a b"), (1, "c"), (2, None)], SCHEMA)
    model = tx.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(abs(r["score"] - share) < 1e-6 for r in tx.scored(docs, model).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert tx.scored(empty, model).collect() == []
    assert tx.learn(empty, spark.createDataFrame(labels, "doc_id long, toxic int")).intercept == 0


def test_sample_is_bounded_by_terms(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}x{j}" for j in range(50))) for i in range(30)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    seen = []
    own = tx.fit
    try:
        tx.fit = lambda sets, y: seen.append(sum(map(len, sets))) or own(sets, y)
        tx.learn(docs, labels, sample_terms=700)
    finally:
        tx.fit = own
    assert 500 < seen[0] <= 700


def test_held_out_accuracy(spark):
    out = tx.op12_toxicity(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    rows = out.where("held_out AND toxic IS NOT NULL").collect()
    good = np.mean([r["predicted"] == r["toxic"] for r in rows])
    clean = np.mean([r["predicted"] for r in rows if r["toxic"] == 0])
    assert len(rows) > 50 and good > 0.93 and clean < 0.02
    assert tx.op12_toxicity(spark, SF01).count() == documents(spark, SF01).count()
