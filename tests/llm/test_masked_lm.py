import math
import random

import numpy as np
import pyarrow as pa

from convops.llm import masked_lm as M
from convops.llm.hashing import word_hashes


def network(seed=0):
    vocabulary = M.Vocabulary(list(range(-20, 40)), 8, 8, 8)
    net = M.Network(vocabulary, seed=seed)
    rng = np.random.default_rng(seed)
    for w in net.weights.values():
        w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    return vocabulary, net


def test_probabilities_are_those_of_the_formula_and_sum_to_one():
    vocabulary, net = network()
    rng = np.random.default_rng(1)
    context = rng.integers(0, vocabulary.size + 1, (5, 4))
    w = {k: v.astype(float) for k, v in net.weights.items()}
    for row in context:
        all_ids = np.arange(vocabulary.size)
        got = net.log_probability(np.repeat(row[None], vocabulary.size, 0), all_ids)
        assert abs(np.exp(got).sum() - 1) < 1e-4
        h = np.tanh(np.concatenate([w["embed"][i] for i in row]) @ w["place"] + w["bias"])
        zc = h @ w["class"] + w["class_bias"]
        for i in (0, 17, vocabulary.size - 1):
            c, k = divmod(i, vocabulary.per_class)
            zw = h @ w["word"][c] + w["word_bias"][c]
            want = zc[c] - math.log(np.exp(zc).sum()) + zw[k] - math.log(np.exp(zw).sum())
            assert abs(got[i] - want) < 1e-4


def test_windows_stay_within_their_text():
    vocabulary = M.Vocabulary([], 4, 8, 8)
    words, at = word_hashes(pa.array(["a b c", None, "d"]))
    context, ids = vocabulary.windows(words, at)
    a, b, c, d = ids
    p = vocabulary.pad
    assert context.tolist() == [[p, p, b, c], [p, a, c, p], [a, b, p, p], [p, p, p, p]]


def test_training_follows_the_gradient():
    vocabulary, net = network(3)
    rng = np.random.default_rng(2)
    context, ids = rng.integers(0, vocabulary.size, (256, 4)), rng.integers(0, vocabulary.size, 256)
    before = net.log_probability(context, ids).mean()
    for _ in range(60):
        net.train(context, ids, 0.02)
    assert net.log_probability(context, ids).mean() > before + 1


def corpus(n, rng):
    order = "red orange yellow green blue indigo violet".split()
    return [" ".join(order[(s + k) % 7] for k in range(rng.randint(5, 40))) for s in (rng.randrange(7) for _ in range(n))]


def test_learned_order_scores_above_shuffled(spark):
    rng = random.Random(0)
    texts = corpus(1500, rng)
    rows = [(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "red", 1.0), (9001, None, 1.0), (9002, " \n", 1.0), (0, texts[0], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words double").repartition(3)
    vocabulary, net = M.fit(docs.select("doc_id", "text"))
    fresh = corpus(60, rng)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in fresh]
    test = spark.createDataFrame(list(enumerate(fresh + mixed)), "doc_id long, text string")
    got = {r.doc_id: r for r in M.score(test, vocabulary, net).collect()}
    assert sum(got[i].log_probability > got[i + 60].log_probability for i in range(60)) >= 55
    assert np.mean([got[i].pseudo_perplexity for i in range(60)]) < 7
    own = {r.doc_id: r for r in M.score(docs, vocabulary, net).collect()}
    assert own[9001].n_words == own[9002].n_words == 0 and own[9001].pseudo_perplexity is None
    assert own[9001].log_probability == 0.0 and own[None].n_words == 1
    words, at = word_hashes(pa.array([texts[7]]))
    assert abs(net.log_probability(*vocabulary.windows(words, at)).sum() - own[7].log_probability) < 1e-6


def test_counts_are_those_of_all_documents(spark):
    docs = spark.createDataFrame([(1, "a B a"), (2, "b"), (3, None)], "doc_id long, text string").repartition(2)
    got = {r.word: r.n for r in M.word_counts(docs).collect()}
    words, _ = word_hashes(pa.array(["a", "b"]))
    assert got == dict(zip(words.view(np.int64).tolist(), [2, 2]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.score(docs, *M.fit(docs)).count() == 0


def test_bucketed_words_have_their_own_share_of_the_bucket(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_BYTES", 3000)
    rng = random.Random(4)
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(names[:rng.choice((5, 900, 3000))]) for _ in range(rng.randint(0, 200))) for _ in range(90)]
    rows = [*enumerate(texts), (None, "w1 w2999 w2"), (3, texts[3]), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    vocabulary = M.Vocabulary([], 8, 8, 32)
    net = M.Network(vocabulary, seed=5)
    counts = {}
    for _, t in rows:
        for w in word_hashes(pa.array([t]))[0].tolist():
            counts[w] = counts.get(w, 0) + 1
    bucket = dict(zip(counts, vocabulary.ids(np.array(list(counts), np.uint64)).tolist()))
    total = {b: sum(n for w, n in counts.items() if bucket[w] == b) for b in set(bucket.values())}

    def want(t):
        words, at = word_hashes(pa.array([t]))
        p = net.log_probability(*vocabulary.windows(words, at)).sum() if len(words) else 0.0
        return p + sum(math.log(counts.get(w, 1) / (total[bucket[w]] + 1)) for w in words.tolist())
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.log_probability)
                  for r in M.score(docs, vocabulary, net).collect()))
    expected = sorted((-1 if i is None else i, len((t or "").split()), want(t)) for i, t in rows)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert max(abs(g[2] - e[2]) for g, e in zip(got, expected)) < 1e-4  # float32 network


def test_warm_start_learns_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x " * 3000 + "y z " * 3000)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(M, "stored", lambda df, name: seen.append((name, df.collect())) or df)
    monkeypatch.setattr(M, "discard", lambda *a: None)
    M.fit(docs)
    assert [len(r.text) for name, rows in seen if name == "lm-warm" for r in rows] == [18000]


def test_a_chunk_goes_over_batches(spark, monkeypatch):
    """A word is written once a chunk; small Arrow batches don't cut chunks."""
    rows = [(i, "alpha beta gamma") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()
    vocabulary = M.Vocabulary([], 8, 8, 32)
    net = M.Network(vocabulary, seed=5)
    written, own = {}, M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: written.setdefault(name, own(df, name)))
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(small)
    spark.conf.set(small, "7")
    try:
        got = M.score(docs, vocabulary, net).collect()
    finally:
        spark.conf.set(small, before)
    assert sorted(r.doc_id for r in got) == list(range(300)) and len({round(r.log_probability, 6) for r in got}) == 1
    chunks = written["lm-scored"].where("word IS NULL").count()
    assert chunks <= docs.rdd.getNumPartitions() and written["lm-scored"].where("word IS NOT NULL").count() == 3 * chunks


def test_a_step_takes_the_rows_of_all_classes_at_once(monkeypatch):
    """Errors and log probabilities are worked out once over all classes' rows, not class by class, and are those of
    each class's rows alone."""
    vocabulary, net = network(6)
    rng = np.random.default_rng(7)
    context, ids = rng.integers(0, vocabulary.size + 1, (300, 4)), rng.integers(0, vocabulary.size, 300)
    calls = []
    for name in ("_error", "_chosen"):
        own = getattr(M.Network, name)
        monkeypatch.setattr(M.Network, name, staticmethod(lambda *a, own=own, name=name: calls.append(name) or own(*a)))
    got = net.log_probability(context, ids)
    alone = np.concatenate([net.log_probability(context[i:i + 1], ids[i:i + 1]) for i in range(300)])
    assert abs(got - alone).max() < 1e-5 and calls == ["_chosen"] * 602
    h, w = net.hidden(context)[1], {k: v.copy() for k, v in net.weights.items()}
    for c in range(8):
        rows = np.flatnonzero(ids // 8 == c)
        p = np.exp(h[rows] @ w["word"][c] + w["word_bias"][c])
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), ids[rows] % 8] -= 1
        w["word"][c] = h[rows].T @ p / 300
    calls.clear()
    net.train(context, ids)
    assert calls == ["_error"] * 2
    assert abs(net.moments["word"][0] * 10 - w["word"]).max() < 1e-5


def test_counts_given_away_in_between_are_whole(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD_WORDS", 40)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randint(0, 30))) for _ in range(60)]
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(small)
    spark.conf.set(small, "3")
    try:
        got = {r.word: r.n for r in M.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    finally:
        spark.conf.set(small, before)
    words, n = np.unique(word_hashes(pa.array(texts))[0], return_counts=True)
    assert got == dict(zip(words.view(np.int64).tolist(), n.tolist()))
