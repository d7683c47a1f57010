"""Documents scored by masked pseudo-likelihood.

Every word is predicted from the words on both sides of it, two on each, and a document's score is the sum of the log
probabilities of all its words. The network (numpy): an embedding per word id, one matrix per position, a tanh layer
with a bias, and a two-level softmax (class, then word in its class). The network's ids are the most frequent words and
hash buckets for all others; the bucket is the third level of the softmax for these: log P(word | bucket) is that of the
word's count among the bucket's. The counts are those of all words of all documents, so this part of the model grows
with the corpus; they stay in Spark and are joined to the words of the documents. A word never counted has the share of
one occurrence more, so the probabilities of a bucket's counted words and of one such word sum to 1.

Training goes over all documents: after a short warm start on a bounded number of whole texts, which puts all tasks in
one basin, every task runs one epoch over the documents it reads, and the weights are averaged in Spark, weighted by
words. Neither the counts nor texts nor the tasks' weights pass through the driver, only the frequent words, the
buckets' totals and the averaged weights, all of fixed size.

Scoring writes, for every chunk of texts, each bucketed word once with the places of its texts. Joined with the counts
and brought together by chunk, they add their log P(word | bucket) to the texts' sums.

Defined cases: null text is empty; a text without words has no words, log probability 0 and null perplexity; at a
text's edges the context is a pad id; repeated rows are scored (and learned from) row by row; without any words the
untrained network's uniform guess scores nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.hashing import mix, slices, word_hashes
from convops.llm.shared import broadcast_value, discard, documents, received, stored

CLASSES = 32
PER_CLASS = 32
BUCKETS = 256
DIM, HIDDEN, SIDE = 16, 24, 2
BATCH = 8192
RATE = 0.01
SCORE_LIMIT = 60.0
WARM_DOCS = 200
#: Bytes and rows of the texts whose bucketed words are written together, over however many Arrow batches they come: a
#: word is written once a chunk, so larger chunks write less.
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 1 << 16
#: Rows of a batch of them.
WRITE_ROWS = 1 << 18
#: A task gives its word counts away when it holds this many distinct words.
HELD_WORDS = 1 << 20


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held, merged = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            both, at = np.unique(np.concatenate(words), return_inverse=True)
            return both, np.bincount(at, np.concatenate(counts), len(both)).astype(np.int64)
        for batch in batches:
            for part in slices(batch.column(0), 4 << 20):
                w, n = np.unique(word_hashes(part)[0], return_counts=True)
                words.append(w)
                counts.append(n)
                held += len(w)
                if held > merged + HELD_WORDS // 2:  # merged once in a while, not at every slice
                    w, n = together()
                    held = merged = len(w)
                    if held > HELD_WORDS:
                        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])
                        w, n, held, merged = w[:0], n[:0], 0, 0
                    words, counts = [w], [n]
        w, n = together()
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])
    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Word hash -> id: frequent words have their own, in the order of their frequency, others a bucket."""

    def __init__(self, frequent: list[int], classes: int = CLASSES, per_class: int = PER_CLASS, buckets: int = BUCKETS):
        self.size, self.per_class, self.buckets = classes * per_class, per_class, buckets
        words = np.array(frequent[:self.size - buckets], np.int64).view(np.uint64)
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.pad = self.size

    def ids(self, words: np.ndarray) -> np.ndarray:
        out = (self.size - self.buckets + mix(words) % np.uint64(self.buckets)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = self.words[at] == words
            out[known] = self.order[at[known]]
        return out

    def bucketed(self, ids: np.ndarray) -> np.ndarray:
        return ids >= self.size - self.buckets

    def windows(self, words: np.ndarray, at: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
        """(contexts, ids) of all words; a text's neighbours lie within the text, else they are the pad."""
        ids = self.ids(words)
        n = len(ids)
        # the texts one after the other with pads around each
        place = np.arange(side, n + side) + np.repeat(np.arange(len(at) - 1) * side, np.diff(at))
        padded = np.full(n + side * (len(at) + 1), self.pad, np.int64)
        padded[place] = ids
        context = np.empty((n, 2 * side), np.int64)
        for c, step in enumerate([*range(-side, 0), *range(1, side + 1)]):
            context[:, c] = padded[place + step]
        return context, ids


class Network:
    """The weights; ``log_probability`` scores and ``train`` takes one Adam step a batch."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray | None = None, dim: int = DIM, hidden: int = HIDDEN,
                 side: int = SIDE, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.per_class, classes = vocabulary.per_class, vocabulary.size // vocabulary.per_class
        share = np.ones(vocabulary.size) if counts is None else counts + 1.0
        by_class = share.reshape(classes, -1)
        f = np.float32
        self.weights = {
            "embed": rng.normal(0, 0.3, (vocabulary.size + 1, dim)).astype(f),
            "place": rng.normal(0, 0.3, (2 * side * dim, hidden)).astype(f),
            "bias": np.zeros(hidden, f),
            "class": rng.normal(0, 0.1, (hidden, classes)).astype(f),
            "class_bias": np.log(by_class.sum(1) / share.sum()).astype(f),
            "word": rng.normal(0, 0.1, (classes, hidden, self.per_class)).astype(f),
            "word_bias": np.log(by_class / by_class.sum(1, keepdims=True)).astype(f),
        }
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        x = w["embed"].take(context, 0).reshape(len(context), -1)
        h = x @ w["place"]
        h += w["bias"]
        return x, np.tanh(h, out=h)

    @staticmethod
    def _exp_sums(z: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Sums of the exponentials of each row of scores, which are overwritten by them."""
        np.exp(z, out=z)
        out, ones = np.empty(len(z), z.dtype), np.ones(z.shape[1], z.dtype)
        for _, s, e in classes:  # float32 sums may depend on the rows summed together: those of a class, as scored
            np.matmul(z[s:e], ones, out=out[s:e])
        return out

    @classmethod
    def _chosen(cls, z: np.ndarray, which: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Log probability of one entry of each row of scores (which are overwritten; no score passes SCORE_LIMIT)."""
        np.clip(z, -SCORE_LIMIT, SCORE_LIMIT, out=z)
        own = z[np.arange(len(z)), which]
        return own - np.log(cls._exp_sums(z, classes))

    @classmethod
    def _error(cls, z: np.ndarray, which: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Gradient of the negative log probability: the row's probabilities, less one at its entry."""
        np.clip(z, -SCORE_LIMIT, SCORE_LIMIT, out=z)
        z *= (1 / cls._exp_sums(z, classes))[:, None]
        z[np.arange(len(z)), which] -= 1
        return z

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The rows in the order of their classes, and (class, start, end) of every class that occurs."""
        own = ids // self.per_class
        order = np.argsort(own.astype(np.int16) if self.weights["class"].shape[1] < 1 << 15 else own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(self.weights["class"].shape[1] + 1)).tolist()
        return order, [(c, s, e) for c, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]

    def _word_scores(self, h: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        """Scores of the words of each row's class; the rows of ``h`` are in the order of their classes."""
        w = self.weights
        z = np.empty((len(h), self.per_class), h.dtype)
        for c, s, e in classes:
            np.matmul(h[s:e], w["word"][c], out=z[s:e])
            z[s:e] += w["word_bias"][c]
        return z

    def log_probability(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.float64)
        w = self.weights
        for s in range(0, len(ids), 1 << 15):
            _, h = self.hidden(context[s:s + (1 << 15)])
            own = ids[s:s + (1 << 15)]
            z = h @ w["class"]
            z += w["class_bias"]
            p = self._chosen(z, own // self.per_class, [(0, 0, len(z))]).astype(np.float64)
            order, classes = self._by_class(own)
            z = self._word_scores(h.take(order, 0), classes)
            p[order] += self._chosen(z, own[order] % self.per_class, classes)
            out[s:s + (1 << 15)] = p
        return out

    def train(self, context: np.ndarray, ids: np.ndarray, rate: float = RATE) -> None:
        w, n = self.weights, len(ids)
        x, h = self.hidden(context)
        z = h @ w["class"]
        z += w["class_bias"]
        g = self._error(z, ids // self.per_class, [(0, 0, n)])
        grads = {"class": h.T @ g, "class_bias": g.sum(0), "word": np.zeros_like(w["word"]),
                 "word_bias": np.zeros_like(w["word_bias"])}
        dh = g @ w["class"].T
        order, classes = self._by_class(ids)
        own = h.take(order, 0)
        g = self._error(self._word_scores(own, classes), ids[order] % self.per_class, classes)
        back = np.empty_like(own)
        for c, s, e in classes:
            np.matmul(own[s:e].T, g[s:e], out=grads["word"][c])
            g[s:e].sum(0, out=grads["word_bias"][c])
            np.matmul(g[s:e], w["word"][c].T, out=back[s:e])
        places = np.empty_like(order)
        places[order] = np.arange(n)
        dh += back.take(places, 0)
        dh *= 1 - h * h
        grads["place"], grads["bias"] = x.T @ dh, dh.sum(0)
        dx = (dh @ w["place"].T).reshape(-1, w["embed"].shape[1])
        at = context.ravel()
        grads["embed"] = np.stack([np.bincount(at, d, len(w["embed"])) for d in np.ascontiguousarray(dx.T)], 1)
        self.steps += 1
        for name, grad in grads.items():
            grad = (grad / n).astype(np.float32)
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            self.moments[name] = (m, v)
            w[name] -= rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(v / (1 - 0.99 ** self.steps)) + 1e-6)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.weights):
            n = self.weights[k].size
            self.weights[k] = flat[at:at + n].reshape(self.weights[k].shape).astype(np.float32)
            at += n


def _warm(docs: DataFrame, vocabulary: Vocabulary, network: Network) -> None:
    """Three passes over the whole texts of WARM_DOCS documents, in a task that holds one batch of them at a time."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    texts = stored(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "lm-warm")
    for _ in range(3):
        shared = broadcast_value(docs.sparkSession, (vocabulary, network))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, network = received(shared)
            for batch in batches:
                for part in slices(batch.column(0)):
                    for context, ids in _batches(vocabulary, part):
                        network.train(context, ids)
            state = pickle.dumps((network.weights, network.moments, network.steps))
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], ["state"])
        for row in texts.coalesce(1).sortWithinPartitions("doc_id").select("text").mapInArrow(learn, "state binary").collect():
            network.weights, network.moments, network.steps = pickle.loads(row["state"])
    network.moments, network.steps = {}, 0
    discard(docs.sparkSession, texts)


def fit(docs: DataFrame, counted: DataFrame | None = None) -> tuple[Vocabulary, Network]:
    """Vocabulary and averaged weights from all of ``docs`` (doc_id, text); ``counted``: its word_counts, if at hand."""
    spark = docs.sparkSession
    top = CLASSES * PER_CLASS - BUCKETS
    # the filter makes the last step an exchange to one task; else every task would send its own best to the driver
    frequent = (word_counts(docs) if counted is None else counted).orderBy(F.desc("n"), "word").limit(top).where("n > 0").collect()
    vocabulary = Vocabulary([r["word"] for r in frequent])
    counts = np.zeros(vocabulary.size)
    counts[:len(frequent)] = [r["n"] for r in frequent]
    counts[vocabulary.size - BUCKETS:] = max(1.0, counts.sum() / 4 / BUCKETS)
    network = Network(vocabulary, counts)
    _warm(docs, vocabulary, network)
    shared = broadcast_value(spark, (vocabulary, network))

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = received(shared)
        network = Network(vocabulary)
        network.load(start.flat())
        seen = 0
        for batch in batches:
            for part in slices(batch.column(0), 2 << 20):
                for context, ids in _batches(vocabulary, part):
                    network.train(context, ids, RATE / 2)
                    seen += len(ids)
        if seen:
            flat = network.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen),
                                              pa.array(np.full(len(flat), float(seen)))], ["i", "total", "weight"])
    averaged = (docs.select("text").mapInArrow(epoch, "i int, total double, weight double").groupBy("i")
                .agg((F.sum("total") / F.sum("weight")).alias("value")).toPandas().sort_values("i"))
    if len(averaged):
        network.load(np.round(averaged["value"].to_numpy(), 6))
    return vocabulary, network


def _batches(vocabulary: Vocabulary, part: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    context, ids = vocabulary.windows(*word_hashes(part))
    for s in range(0, len(ids), BATCH):
        yield context[s:s + BATCH], ids[s:s + BATCH]


def bucket_totals(counted: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Occurrences of each bucket's words."""
    shared = broadcast_value(counted.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = received(shared)
        total = np.zeros(vocabulary.size, np.int64)
        for batch in batches:
            ids = vocabulary.ids(batch.column(0).to_numpy().view(np.uint64))
            np.add.at(total, ids, batch.column(1).to_numpy())
        first = vocabulary.size - vocabulary.buckets
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(vocabulary.buckets, dtype=np.int32)),
                                          pa.array(total[first:])], ["bucket", "n"])
    out = np.zeros(vocabulary.buckets)
    sums = counted.select("word", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


_SCORED = "doc_id array<long>, n_words array<long>, log_probability array<double>"


def score(docs: DataFrame, vocabulary: Vocabulary, network: Network, counted: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_probability, pseudo_perplexity of every row of ``docs`` (doc_id, text).

    ``counted``: the word_counts of the corpus that was learned; those of ``docs`` if not given.
    """
    spark = docs.sparkSession
    counted = stored(word_counts(docs), "lm-counts") if counted is None else counted
    shared = broadcast_value(spark, (vocabulary, network, np.log(bucket_totals(counted, vocabulary) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network, log_total = received(shared)
        names = ["chunk", "word", "at", "doc_id", "n_words", "log_probability"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()),
                 pa.list_(pa.float64())]
        chunk = TaskContext.get().partitionId() << 32
        n, total, rare, place, done = [], [], [], [], []

        def written() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays(done).to_pylist()
            lists = [pa.array([v], k) for v, k in zip((ids, np.concatenate(n), np.concatenate(total)), kinds[3:])]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.nulls(1, k) for k in kinds[1:3]), *lists], names)
            own, places = np.concatenate(rare), np.concatenate(place)
            order = np.argsort(own, kind="stable")
            words, first = np.unique(own[order], return_index=True)
            at = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), pa.array(places[order]))
            for s in range(0, len(words), WRITE_ROWS):
                some = words[s:s + WRITE_ROWS].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), chunk)), pa.array(some), at.slice(s, len(some)),
                     *(pa.nulls(len(some), k) for k in kinds[3:])], names)
            for held in (n, total, rare, place, done):
                held.clear()
        size, rows = 0, 0
        for batch in batches:
            row = 0
            for piece in slices(batch.column(1), min(CHUNK_BYTES, 2 << 20)):
                words, at = word_hashes(piece)
                context, ids = vocabulary.windows(words, at)
                p = network.log_probability(context, ids)
                own = vocabulary.bucketed(ids)
                p[own] -= log_total[ids[own] - (vocabulary.size - vocabulary.buckets)]
                sums = np.concatenate([[0.0], np.cumsum(p)])
                n.append(np.diff(at))
                total.append(np.where(np.diff(at) > 0, sums[at[1:]] - sums[at[:-1]], 0.0))
                rare.append(words[own])
                place.append(np.repeat(np.arange(rows, rows + len(piece), dtype=np.int32), np.diff(at))[own])
                done.append(batch.column(0).slice(row, len(piece)))
                row, rows, size = row + len(piece), rows + len(piece), size + piece.nbytes
                if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield from written()
                    chunk, size, rows = chunk + 1, 0, 0
        if rows:
            yield from written()
    scored = stored(docs.select("doc_id", "text").mapInArrow(run, f"chunk long, word long, at array<int>, {_SCORED}"),
                    "lm-scored")
    # the logarithm of a word counted once, or never, is 0 and adds nothing
    shares = (scored.where("word IS NOT NULL").select("chunk", "word", "at")
              .join(counted.where("n > 1").select("word", F.log("n").alias("log_n")), "word"))
    # empty lists, not null ones: Spark's Arrow writer goes back over all null lists of a batch at every row
    texts = scored.where("word IS NULL").withColumn("log_n", F.lit(0.0))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "log_probability"]
        head, more, of = None, None, None  # the chunk's row of texts comes first

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([head[0], head[1], pa.array(head[2] + more)], names)
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e == s:
                    continue
                part = batch.slice(s, e - s)
                if chunks[s] != of:
                    if head is not None:
                        yield finished()
                    of = chunks[s]
                    one = [part.column(k).slice(0, 1).flatten() for k in (3, 4, 5)]
                    head = (one[0], one[1], one[2].to_numpy(zero_copy_only=False))
                    more = np.zeros(len(head[2]))
                    part = part.slice(1)
                if len(part):
                    lists = part.column(1)
                    weights = np.repeat(part.column(2).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy())
                    more += np.bincount(lists.flatten().to_numpy(), weights, len(more))
        if head is not None:
            yield finished()
    empty = [F.array().cast(kind).alias(name) for name, kind in (c.split() for c in _SCORED.split(", "))]
    both = (texts.select("chunk", F.array().cast("array<int>").alias("at"), "log_n", "doc_id", "n_words",
                         "log_probability", "word")
            .unionByName(shares.select("chunk", "at", "log_n", *empty, "word"))
            .repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_first("word")).drop("word"))
    out = both.mapInArrow(together, "doc_id long, n_words long, log_probability double")
    return out.withColumn("pseudo_perplexity", F.when(
        F.col("n_words") > 0, F.exp(-F.col("log_probability") / F.col("n_words"))))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"),
                                           F.col("text").cast("string").alias("text"))
    counted = stored(word_counts(docs), "lm-counts")
    return score(docs, *fit(docs, counted), counted)
