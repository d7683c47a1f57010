"""Packing documents into fixed windows by non-negative least squares.

Documents are tokenised once; every full window of a long document is a sequence of its own, and the remainders
(1 .. window - 1 tokens) are packed: all combinations of at most three remainder lengths that fill a window exactly
are enumerated, non-negative least squares finds how often to repeat each so that together they use up the corpus'
histogram of lengths, and the rounded counts become a plan. What the plan leaves over is laid end to end, longest
first, and cut at the window's end; the last tokens go into sequences whose lengths are powers of two, so nothing is
padded.

Only the histogram (fewer than ``window`` counts) reaches the driver and only the plan (bounded by the window, not by
the corpus) is sent to the tasks. A remainder's rank within its length, which decides its place in the plan, is its
rank within its task plus the counts of earlier tasks.

Defined cases: null text is empty, and an empty text is the end token alone; a null ``doc_id`` is carried along;
repeated rows are packed once per row; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convops.llm.shared import documents, stored

WINDOW = 1024
END_ID = 0
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WINDOWS = "doc_id long, doc_tokens long, start long, length long, ids binary, part long, slot long"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequences of full windows are numbered part * 2**36 + their rank in the task, after the planned ones.
_PART_BITS = 36


def encoder(vocabulary: str, ranks: str):
    """text -> uint32 ids, as the library ``tokenizers`` gives them without added special tokens.

    The same merges run faster from the rank file; texts that hold the string of a special token, which
    ``tokenizers`` turns into its id, go through ``tokenizers`` itself.
    """
    import base64
    import json
    from functools import cache

    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

    @cache
    def reference():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(reference().encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")
    return encode


def token_windows(docs: DataFrame, vocabulary: str, ranks: str, window: int = WINDOW) -> DataFrame:
    """Each document's ids cut every ``window`` ids: full windows, and a remainder unless nothing remains.

    slot: rank of a full window among those of its task, of a remainder among those of its task and length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4")

        def cut(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              ["doc_id", "doc_tokens", "start", "length", "ids", "part", "slot"])
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    rows.append((doc_id, len(ids), start, len(piece), piece.tobytes(), part, seen[len(piece)]))
                    seen[len(piece)] += 1
                    held += piece.nbytes
                    if held > 8 << 20:
                        yield cut(rows)
                        rows, held = [], 0
        if rows:
            yield cut(rows)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _WINDOWS)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of two or three of ``lengths`` with sum ``window``, as rows ascending; a zero stands for none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a, b = np.triu_indices(window // 2 + 1)
    c = window - a - b
    ok = (b >= 1) & (c >= b) & (c < window) & there[c] & there[b] & ((a == 0) | there[a])
    return np.stack([a[ok], b[ok], c[ok]], 1)


def repeat_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: x >= 0 with sum_j x_j * rows_j ~ histogram."""
    if not len(rows):
        return np.zeros(0)
    scale = max(histogram.max(), 1)
    target = histogram / scale
    used = rows > 0

    def forward(x):
        return np.bincount(rows.ravel(), np.repeat(x, 3) * used.ravel(), len(histogram))

    def backward(r):
        return (r[rows] * used).sum(1)
    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - backward(forward(y) - target) / norm)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


class Plan:
    """Where the remainder of a given length and rank goes: planned combinations first, then the cut tail."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        rows = combinations(np.flatnonzero(histogram), window)
        counts = np.floor(repeat_counts(rows, histogram) + 0.5).astype(np.int64)
        left = histogram.astype(np.int64).copy()
        keys, values, sequences = [], [], 0
        taken = np.zeros(len(histogram), np.int64)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] <= 0:
                break
            need = Counter(int(n) for n in rows[j] if n)
            times = min([int(counts[j]), *(int(left[n]) // k for n, k in need.items())])
            if times <= 0:
                continue
            offset = 0
            for n, k in need.items():
                keys.append((n << 40) + int(taken[n]))
                values.append((int(taken[n]), k, sequences, offset))
                taken[n] += times * k
                left[n] -= times * k
                offset += n * k
            sequences += times
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int64).reshape(-1, 4)[order]
        self.taken = taken
        tokens = left * np.arange(len(left))
        self.tail_at = tokens.sum() - np.cumsum(tokens)  # longest first
        self.tail_sequences = sequences
        self.tail_whole = int(tokens.sum()) // window
        rest = int(tokens.sum()) % window
        powers = [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]
        self.tail_ends = self.tail_whole * window + np.cumsum([0, *powers])
        self.sequences = sequences + self.tail_whole + len(powers)

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece of this remainder."""
        if rank < self.taken[length]:
            base, k, sequence, offset = self.values[np.searchsorted(self.keys, (length << 40) + rank, "right") - 1]
            times, which = divmod(rank - int(base), int(k))
            return [(0, length, int(sequence) + times, int(offset) + which * length)]
        at = int(self.tail_at[length]) + (rank - int(self.taken[length])) * length
        out, done = [], 0
        while done < length:
            here = at + done
            if here < self.tail_ends[0]:
                sequence, offset = divmod(here, self.window)
                room = self.window - offset
            else:
                k = int(np.searchsorted(self.tail_ends, here, "right")) - 1
                sequence, offset = self.tail_whole + k, here - int(self.tail_ends[k])
                room = int(self.tail_ends[k + 1]) - here
            n = min(room, length - done)
            out.append((done, n, self.tail_sequences + sequence, offset))
            done += n
        return out


def pack(docs: DataFrame, vocabulary: str, ranks: str, window: int = WINDOW) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32 bit) and their place in a sequence."""
    spark = docs.sparkSession
    windows = stored(token_windows(docs, vocabulary, ranks, window), "packing-windows")
    rest = windows.where(F.col("length") < window)
    counts = stored(rest.groupBy("part", "length").count(), "packing-counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan = Plan(histogram, window)
    shared = spark.sparkContext.broadcast(plan.__dict__)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan.__new__(Plan)
        plan.__dict__.update(shared.value)
        for batch in batches:
            rows = []
            for doc_id, start, length, ids, doc_tokens, rank in zip(*(c.to_pylist() for c in batch.columns)):
                for at, n, sequence, offset in plan.places(length, rank):
                    rows.append((doc_id, start + at, n, ids[4 * at:4 * (at + n)], doc_tokens, sequence, offset))
            if rows:
                types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    placed = (rest.join(offsets, ["part", "length"])
              .select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("slot") + F.col("earlier")).alias("rank"))
              .mapInArrow(place, _PIECES))
    whole = windows.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.lit(plan.sequences) + F.shiftleft(F.col("part"), _PART_BITS) + F.col("slot")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(placed)


def public_vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(documents(spark, sf_dir), **public_vocabulary()))
