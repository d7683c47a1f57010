"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words (runs of ASCII letters and digits and of all other characters beyond ASCII, in lower case)
and their first 4, 5 and 6 bytes, which stand for the stems of inflected words; each is a 64-bit hash, and a document
is the set of its terms. The machine has a weight per term and a vector per term whose inner products weigh pairs, so
an insult that counts only beside the mention of a group is learned, which no sum of weights can express. It is fitted
in numpy with per-coordinate steps and an L1 penalty that leaves most weights at zero (follow the regularised leader),
and only terms that keep a weight or a vector are sent to the tasks.

The machine is fitted on at most ``SAMPLE_ROWS`` labelled rows with together at most ``SAMPLE_TERMS`` terms, taken in the
order of a hash of their ids; a term must occur in ``MIN_DOCS`` of them. Scoring reads every row and whole text.

Defined cases: null text is empty, and an empty text has no terms and gets the score of the intercept; labels that are
null or belong to no document are not learned from, a document with several labels is learned from once per label, and
of several texts under one id the greatest; without any labels, or with one class only, every score is the share of
label 1 (0.5 without labels); repeated rows are scored row by row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.hashing import mix, slices, text_bytes
from convops.llm.shared import broadcast_value, documents, received, remainder, stored

SAMPLE_ROWS = 10_000
SAMPLE_TERMS = 16_000_000
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
FACTORS = 6
THRESHOLD = 0.5
EPOCHS, BATCH = 8, 64
#: Step sizes of weights and vectors, and the penalties: L1 on weights (an epoch), L2 on both.
RATE_W, RATE_V, L1_W, L2 = 0.3, 0.1, 2.0, 0.1

_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240815)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_KIND = _RNG.integers(1, 1 << 63, 1 + len(PREFIXES), dtype=np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all terms of all texts, repeated ones too, in no particular order."""
    raw, at = text_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    n = len(raw)
    letter = np.concatenate([_LETTER[raw], [False]])
    first, after = letter[:n].copy(), letter[:n].copy()
    first[1:] &= ~letter[:n - 1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = letter[begins]
    after &= ~letter[1:]
    ends = at[1:][at[:-1] < at[1:]] - 1
    after[ends] = letter[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(after) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(pow(_BASE, -1, 1 << 64), n)[start]
    row = np.searchsorted(at, start, "right") - 1
    rows, hashes = [row], [mix((total[end] - total[start]) * back + _KIND[0])]
    for kind, size in zip(_KIND[1:], PREFIXES):
        long = np.flatnonzero(end - start > size)
        rows.append(row[long])
        hashes.append(mix((total[start[long] + size] - total[start[long]]) * back[long] + kind))
    return np.concatenate(rows), np.concatenate(hashes)


def term_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text its distinct terms, sorted."""
    for part in slices(texts):
        row, h = terms(part)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
        yield from np.split(h[new], np.searchsorted(row[new], np.arange(1, len(part))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _rows_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets ``at``."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


@dataclass(frozen=True)
class Machine:
    """Terms in ascending order with their weights and vectors; a score is the logistic of all of them together."""
    keys: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    intercept: float

    def margin(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """intercept + sum of weights + sum over pairs of inner products, for rows of places in ``keys``."""
        v = self.vectors[places]
        pairs = (_rows_sum(v, at) ** 2 - _rows_sum(v.astype(np.float64) ** 2, at)).sum(1) / 2
        return self.intercept + _rows_sum(self.weights[places], at) + pairs

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text."""
        return np.concatenate([np.zeros(0), *(self._slice(part) for part in slices(texts))])

    def _slice(self, texts: pa.Array) -> np.ndarray:
        row, h = terms(texts)
        if not len(self.keys):
            return _sigmoid(np.full(len(texts), self.intercept))
        low = np.uint64((1 << 22) - 1)
        there = np.zeros(1 << 22, bool)  # most terms are unknown: look at some bits first
        there[(self.keys & low).astype(np.int64)] = True
        some = there[(h & low).astype(np.int64)]
        row, h = row[some], h[some]
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[place] == h
        pair = np.unique(row[known] * len(self.keys) + place[known])
        row, place = np.divmod(pair, len(self.keys))
        return _sigmoid(self.margin(place, np.searchsorted(row, np.arange(len(texts) + 1))))


def fit(sets: list[np.ndarray], y: np.ndarray, seed: int = 0, epochs: int = EPOCHS, min_docs: int = MIN_DOCS,
        factors: int = FACTORS) -> Machine:
    """The machine for sets of terms with labels 0 and 1."""
    none = np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, factors))
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9))
        return Machine(*none, float(np.log(share / (1 - share))))
    keys, place, count = np.unique(np.concatenate([none[0], *sets]), return_inverse=True, return_counts=True)
    often = count >= min_docs
    number = np.cumsum(often) - 1
    kept = often[place]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    at = np.concatenate([[0], np.cumsum(kept)])[at]
    place, keys = number[place[kept]], keys[often]
    rng = np.random.default_rng(seed)
    b = float(np.log(y.mean() / (1 - y.mean())))
    # weights alone first: the terms that keep one are those that pairs are sought among
    w, _, b = _descend(place, at, y, np.zeros(len(keys)), np.zeros((len(keys), 0)), b, rng, epochs)
    chosen = np.flatnonzero(w)
    number = np.full(len(keys), -1)
    number[chosen] = np.arange(len(chosen))
    kept = number[place] >= 0
    place, at = number[place[kept]], np.concatenate([[0], np.cumsum(kept)])[at]
    start = rng.normal(0, 0.03, (len(chosen), factors))
    w, v, b = _descend(place, at, y, w[chosen], start, b, rng, epochs)
    return Machine(keys[chosen], w, v, float(b))


def _descend(place: np.ndarray, at: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, b: float,
             rng: np.random.Generator, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, vectors and intercept after ``epochs`` passes in small batches, each coordinate with its own step.

    Weights follow the regularised leader: one whose gradients don't add up to more than the penalty is zero.
    """
    start_w, start_v, factors = w.copy(), v.copy(), v.shape[1]
    w, v = w.copy(), v.copy()
    l1 = 0.0 if factors else L1_W * epochs
    z_w, n_w = np.zeros(len(w)), np.zeros(len(w))
    z_v, n_v = np.zeros(v.shape), np.zeros(v.shape)
    n_b = 1.0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            docs = order[s:s + BATCH]
            sizes = at[docs + 1] - at[docs]
            own = np.concatenate([[0], np.cumsum(sizes)])
            idx = place[np.repeat(at[docs] - own[:-1], sizes) + np.arange(own[-1])]
            row = np.repeat(np.arange(len(docs)), sizes)
            vi = v[idx]
            total = _rows_sum(vi, own)
            margin = b + _rows_sum(w[idx], own) + (total ** 2 - _rows_sum(vi ** 2, own)).sum(1) / 2
            g = _sigmoid(margin) - y[docs]
            u, inverse = np.unique(idx, return_inverse=True)
            gw = np.bincount(inverse, g[row], len(u))
            step = (np.sqrt(n_w[u] + gw ** 2) - np.sqrt(n_w[u])) / RATE_W
            z_w[u] += gw - step * (w[u] - start_w[u])
            n_w[u] += gw ** 2
            z = np.sign(z_w[u]) * np.maximum(np.abs(z_w[u]) - l1, 0)
            w[u] = start_w[u] - z / ((1 + np.sqrt(n_w[u])) / RATE_W + L2)
            if factors:
                gv = np.stack([np.bincount(inverse, g[row] * (total[row, f] - vi[:, f]), len(u))
                               for f in range(factors)], 1)
                step = (np.sqrt(n_v[u] + gv ** 2) - np.sqrt(n_v[u])) / RATE_V
                z_v[u] += gv - step * (v[u] - start_v[u])
                n_v[u] += gv ** 2
                v[u] = start_v[u] - z_v[u] / ((1 + np.sqrt(n_v[u])) / RATE_V + L2)
            n_b += g.sum() ** 2
            b -= 0.1 * g.sum() / np.sqrt(n_b)
    return w, v, b


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_terms: int = SAMPLE_TERMS) -> Machine:
    """Fit on the labelled rows of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    some = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows))
    # some: at most sample_rows ids
    sample = (docs.select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id")
              .groupBy("doc_id", "toxic").agg(F.max(F.col("text").cast("string")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2)):
                sets = list(term_sets(part))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(2)),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "toxic", "n", "terms"])
                at += len(part)
    rows = stored(sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double"), "text")
                  .mapInArrow(run, "doc_id long, toxic double, n long, terms binary"), "toxicity-sample")
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    sizes = np.array([r["n"] for r in rows.orderBy(*order).select("n").collect()], np.int64)  # sample_rows at most
    fits = int(np.searchsorted(np.cumsum(sizes), sample_terms, "right"))
    taken = rows.orderBy(*order).limit(fits).collect() if fits else []
    return fit([np.frombuffer(r["terms"], np.uint64) for r in taken], np.array([r["toxic"] for r in taken], float))


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))],
                                             ["doc_id", "score"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, score double"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.where(remainder("doc_id", 5) != 0))
    return scored(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
