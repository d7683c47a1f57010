"""Alignment of the tokens of two tokenizers by sparse incidence products.

Both tokenizers cut the same bytes (a blank and the text). Each gives an incidence matrix of its tokens by bytes in
compressed sparse rows; the product A · Bᵀ, row by row (Gustavson), holds for every pair of tokens how many bytes they
share: the overlap links. Offsets where tokens of both end cut the bytes into groups, and the product of the two
incidence matrices of tokens by groups gives the shared-group links.

A text falls into units at each single blank between two characters that are not white space. No token of either
tokenizer crosses such a place, so a task aligns every distinct unit once (many units are the rows of one block-diagonal
product) and a document is the sequence of its units. How often an id pair is linked in the whole corpus is summed in
Spark; the ``hot`` most frequent pairs, a fixed number, go to the tasks of the second pass with their counts, and the
links of all other pairs are joined with theirs.

Defined cases: a text that is null, empty, or that one of the tokenizers does not give back byte for byte has no
tokens, zeros and an empty digest; a null ``doc_id`` is carried along; repeated rows are aligned row by row and each
counts; an empty table gives an empty result; ties for a B id's highest count all hold; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.hashing import slices
from convops.llm.shared import documents, stored

#: Id pairs whose corpus counts every task of the second pass knows (17 bytes each); the others are joined.
HOT_PAIRS = 1 << 18
#: Characters of distinct units that a task remembers, and text that it works on at a time.
REMEMBERED_CHARS = 3 << 20
SLICE_BYTES = 2 << 20
#: Units encoded in one call.
TOGETHER = 1000
#: Stored elements that a product expands at a time.
BLOCK = 1 << 20
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"
_UNIT_END = re.compile(r" (?<=\S )(?=\S)")


@dataclass(frozen=True)
class Csr:
    """A 0/1 matrix in compressed sparse rows."""
    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transposed(self) -> Csr:
        """The same entries by column: a counting sort of the column indices."""
        indptr = np.zeros(self.columns + 1, np.int64)
        np.cumsum(np.bincount(self.indices, minlength=self.columns), out=indptr[1:])
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        return Csr(indptr, row[order], self.rows)


def spans(ends: np.ndarray, size: int) -> Csr:
    """Tokens by bytes: token i holds the bytes from the end of the token before it to its own."""
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(size), size)


def members(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups, one group a token."""
    return Csr(np.arange(len(group) + 1), group, groups)


def products(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, value) of the non-zero entries of a · bᵀ in the order of rows, some rows of ``a`` at a time.

    Row i of the product is the sum of those rows of bᵀ that row i of ``a`` names (Gustavson): they are laid side by
    side and equal columns summed.
    """
    bt = b.transposed()
    width = np.diff(bt.indptr)
    work = np.concatenate([[0], np.cumsum(width[a.indices])])[a.indptr]  # entries that the rows before i expand to
    start = 0
    while start < a.rows:
        stop = max(start + 1, int(np.searchsorted(work, work[start] + block, "right")) - 1)
        inner = a.indices[a.indptr[start]:a.indptr[stop]]
        row = np.repeat(np.arange(start, stop), np.diff(a.indptr[start:stop + 1]))
        n = width[inner]
        first = np.cumsum(n) - n
        column = bt.indices[np.repeat(bt.indptr[inner] - first, n) + np.arange(n.sum())]
        row = np.repeat(row, n)
        key = row * b.rows + column
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, row, column = key[order], row[order], column[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield row[new], column[new], np.diff(np.append(new, len(key)))
        start = stop


def byte_of_symbol() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    rest are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, vocabulary: str, ranks: str, pieces: str):
        import base64
        import json

        import sentencepiece
        import tiktoken

        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_of_symbol()
        ids = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        ids |= {i: bytes(symbol[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in ids}
        self.a_bytes = np.array([ids.get(i, b"") for i in range(max(ids) + 1)], object)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.reference = None
        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.b_bytes = np.array([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode()
                                 for i, p in enumerate(names)], object)
        #: Units are cut at blanks only if no piece holds one after another character.
        self.splits = all(MARK not in p.lstrip(MARK) for p in names)
        self.a_length = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_length = np.array([len(b) for b in self.b_bytes], np.int64)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return _UNIT_END.split(text) if self.splits else [text]

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        except ValueError:  # a run of white space too long for its pattern
            if self.reference is None:
                from tokenizers import Tokenizer

                self.reference = Tokenizer.from_file(self.vocabulary)
                self.reference.encode_special_tokens = True
            return np.array(self.reference.encode(" " + text, add_special_tokens=False).ids, np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all units that both give back byte for byte, end to end, and which units those are.

        Units without white space at their ends are encoded together, as nothing crosses the blanks between them; where
        the bytes differ, the halves are tried.
        """
        ok = np.zeros(len(units), bool)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        alone = [i for i, u in enumerate(units) if u[0].isspace() or u[-1].isspace()]
        cuts = sorted({*range(0, len(units), TOGETHER), len(units), *alone, *(i + 1 for i in alone)})
        runs = [*zip(cuts[:-1], cuts[1:])][::-1]
        while runs:
            s, e = runs.pop()
            text = " ".join(units[s:e])
            own_a, own_b = self.encode_a(text), np.array(self.sp.encode(text, num_threads=1), np.int64)
            whole = (" " + text).encode()
            if b"".join(self.a_bytes[own_a].tolist()) == whole == b"".join(self.b_bytes[own_b].tolist()):
                ok[s:e] = True
                a.append(own_a)
                b.append(own_b)
            elif e - s > 1:
                runs += [((s + e) // 2, e), (s, (s + e) // 2)]
        return np.concatenate(a), np.concatenate(b), ok


class Aligned:
    """Alignments of units that both tokenizers give back, from their ids end to end: one block-diagonal product."""

    def __init__(self, tokenizers: Tokenizers, units: list[str], a_ids: np.ndarray, b_ids: np.ndarray):
        self.units = len(units)
        self.a_ids, self.b_ids = a_ids, b_ids
        a_end, b_end = np.cumsum(tokenizers.a_length[a_ids]), np.cumsum(tokenizers.b_length[b_ids])
        unit_end = np.cumsum([len(u.encode()) + 1 for u in units])
        self.a_unit, self.b_unit = np.searchsorted(unit_end, a_end), np.searchsorted(unit_end, b_end)
        size = int(a_end[-1]) if len(a_end) else 0
        shared = a_end[np.isin(a_end, b_end)]
        self.groups = len(shared)
        self.group_unit = self.a_unit[np.isin(a_end, b_end)]
        self.a_group, self.b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        self.a, self.b = spans(a_end, size), spans(b_end, size)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes)."""
        return products(self.a, self.b)

    def together(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of tokens in one group."""
        return products(members(self.a_group, self.groups), members(self.b_group, self.groups))

    def per_unit(self, unit: np.ndarray) -> np.ndarray:
        return np.bincount(unit, minlength=self.units)

    def spelled(self) -> list[bytes]:
        """Each unit's groups: a1,a2|b1;a3|b2,b3."""
        def written(ids: np.ndarray, group: np.ndarray, last: bytes) -> np.ndarray:
            known, at = np.unique(ids, return_inverse=True)
            digits = np.array([b"%d" % i for i in known.tolist()], object)
            ends = np.append(group[1:] != group[:-1], True)[:len(ids)]
            return np.where(ends, (digits + last)[at], (digits + b",")[at])
        text = np.concatenate([written(self.a_ids, self.a_group, b"|"), written(self.b_ids, self.b_group, b";")])
        order = np.argsort(np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        parts = text[order].tolist()
        ends = np.cumsum(self.per_unit(self.a_unit) + self.per_unit(self.b_unit)).tolist()
        return [b"".join(parts[s:e])[:-1] for s, e in zip([0, *ends[:-1]], ends)]


class Seen:
    """Distinct units with the id pairs that they link, and how often each unit stands in the texts added."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok = tokenizers
        self.at: dict[str, int] = {}
        self.whole: list[bool] = []
        self.times = np.zeros(0, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.chars = 0

    def add(self, texts: list[list[str]]) -> None:
        fresh = list({u for units in texts for u in units} - self.at.keys())
        if fresh:
            a, b, ok = self.tok.encode(fresh)
            good = np.flatnonzero(ok)
            block = Aligned(self.tok, [fresh[i] for i in good], a, b)
            base = len(self.whole)
            for row, column, _ in block.overlaps():
                self.links.append((base + good[block.a_unit[row]], (block.a_ids[row] << 32) + block.b_ids[column]))
            self.whole += ok.tolist()
            self.at.update(zip(fresh, range(base, base + len(fresh))))
            self.times = np.concatenate([self.times, np.zeros(len(fresh), np.int64)])
            self.chars += sum(map(len, fresh))
        places = []
        for units in texts:
            own = [self.at[u] for u in units]
            if all(map(self.whole.__getitem__, own)):
                places += own
        self.times += np.bincount(np.array(places, np.int64), minlength=len(self.times))

    def counts(self) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        unit = np.concatenate([none, *(u for u, _ in self.links)])
        key, at = np.unique(np.concatenate([none, *(k for _, k in self.links)]), return_inverse=True)
        n = np.bincount(at, self.times[unit], len(key)).astype(np.int64)
        key, n = key[n > 0], n[n > 0]
        return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)),
                                           pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)],
                                          ["a_id", "b_id", "n"])


def pair_counts(docs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """a_id, b_id, n: how many overlap links of the corpus hold this id pair. Summed in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers(**paths)
        seen = Seen(tok)
        for batch in batches:
            for part in slices(batch.column(0), SLICE_BYTES):
                if seen.chars > REMEMBERED_CHARS:
                    yield seen.counts()
                    seen = Seen(tok)
                seen.add([tok.units(t or "") for t in part.to_pylist()])
        yield seen.counts()
    return (docs.select(F.col("text").cast("string")).mapInArrow(run, "a_id int, b_id int, n long")
            .groupBy("a_id", "b_id").agg(F.sum("n").alias("n")))


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with best: no other A id is linked more often with this B id. One row per B id is aggregated."""
    top = counts.groupBy("b_id").agg(F.max("n").alias("top"))
    return counts.join(top, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"))


def frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least count, key, n, best) of the pairs that occur that often or more: as many as ``most`` allows.

    The least count is found from a histogram of counts (eight classes per doubling), so no rows are sorted and at
    most ``most`` reach the driver.
    """
    grade = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["grade"], r["count"]) for r in counts.groupBy(grade.alias("grade")).count().collect()),
                       reverse=True)
    total, least = 0, None
    for g, n in histogram:
        if total + n > most:
            break
        total, least = total + n, g
    if least is None:
        return 1 << 62, *(np.zeros(0, np.int64),) * 3
    rows = counts.where(grade >= least).select(
        (F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("key"), "n", "best").toPandas()
    rows = rows.sort_values("key")
    return least, rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)


_ROWS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, n_best long, "
         "count_sum long, groups_sha256 string, a_id int, b_id int, n long")
_VALUES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum")


class Known:
    """The distinct units that a task remembers: their digests as one row of numbers each, their group strings, and
    those of their links whose corpus counts have to be joined."""

    def __init__(self, tokenizers: Tokenizers, key: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.tok, self.key, self.n, self.best = tokenizers, key, n, best
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[bytes | None] = []
        self.values = np.zeros((0, len(_VALUES)), np.int64)
        self.cold: dict[int, np.ndarray] = {}
        self.chars = 0

    def add(self, units: list[str]) -> None:
        a, b, ok = self.tok.encode(units)
        good = np.flatnonzero(ok)
        block = Aligned(self.tok, [units[i] for i in good], a, b)
        base = len(self.text)
        own = np.zeros((len(units), len(_VALUES)), np.int64)
        sums = np.zeros((len(_VALUES), len(good)), np.int64)
        sums[0], sums[1] = block.per_unit(block.a_unit), block.per_unit(block.b_unit)
        sums[2] = block.per_unit(block.group_unit)
        for row, column, _ in block.overlaps():
            unit = block.a_unit[row]
            key = (block.a_ids[row] << 32) + block.b_ids[column]
            sums[3] += block.per_unit(unit)
            place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
            hot = self.key[place] == key if len(self.key) else np.zeros(len(key), bool)
            np.add.at(sums[5], unit[hot], self.best[place[hot]].astype(np.int64))
            np.add.at(sums[6], unit[hot], self.n[place[hot]])
            unit, key = base + good[unit[~hot]], key[~hot]
            cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e > s:
                    u = int(unit[s])
                    self.cold[u] = np.concatenate([self.cold[u], key[s:e]]) if u in self.cold else key[s:e].copy()
        for row, _, _ in block.together():
            sums[4] += block.per_unit(block.a_unit[row])
        own[good] = sums.T
        text: list[bytes | None] = [None] * len(units)
        for i, t in zip(good.tolist(), block.spelled()):
            text[i] = t
        self.values = np.concatenate([self.values, own])
        self.text += text
        self.at.update(zip(units, range(base, base + len(units))))
        self.chars += sum(map(len, units))


def digests(docs: DataFrame, paths: dict[str, str], hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of ``docs``: doc_id, the numbers of tokens, groups and links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stored(with_best(stored(pair_counts(docs.select("text"), paths), "alignment-counts")), "alignment-best")
    least, *hot = frequent(counts, hot_pairs)
    shared = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Tokenizers(**paths), *shared.value)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), SLICE_BYTES):
                if known.chars > REMEMBERED_CHARS:
                    known.forget()
                texts = [known.tok.units(t or "") for t in part.to_pylist()]
                fresh = {u for units in texts for u in units} - known.at.keys()
                if fresh:
                    known.add(list(fresh))
                ids = batch.column(0).slice(at, len(part))
                yield from rows(known, texts, ids, row)
                row += len(part)
                at += len(part)

    def rows(known: Known, texts: list[list[str]], ids: pa.Array, first: int) -> Iterator[pa.RecordBatch]:
        values = np.zeros((len(texts), len(_VALUES)), np.int64)
        digest, cold_rows, cold_keys = [""] * len(texts), [], []
        for i, units in enumerate(texts):
            places = [known.at[u] for u in units]
            strings = [known.text[p] for p in places]
            if not units or None in strings:
                continue
            values[i] = known.values[places].sum(0)
            digest[i] = hashlib.sha256(b";".join(strings)).hexdigest()
            for p in places:
                keys = known.cold.get(p)
                if keys is not None:
                    cold_rows.append(np.full(len(keys), first + i))
                    cold_keys.append(keys)
        own = np.arange(first, first + len(texts))
        none = pa.nulls(len(texts), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), ids, *(pa.array(v) for v in values.T.copy()), pa.array(digest), none, none,
             pa.nulls(len(texts), pa.int64())], names)
        if cold_keys:
            keys, of = np.concatenate(cold_keys), np.concatenate(cold_rows)
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
            n = np.diff(np.append(new, len(keys)))
            keys, of = keys[new], of[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of), pa.nulls(len(of), pa.int64()), *(pa.nulls(len(of), pa.int64()) for _ in _VALUES),
                 pa.nulls(len(of), pa.string()), pa.array((keys >> 32).astype(np.int32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names)
    names = [c.split()[0] for c in _ROWS.split(", ")]
    found = stored(docs.mapInArrow(run, _ROWS), "alignment-rows")
    rest = counts.select("a_id", "b_id", F.col("n").alias("count"), "best")
    joined = (found.where("a_id IS NOT NULL").select("row", "a_id", "b_id", "n").join(rest, ["a_id", "b_id"])
              .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("more_best"),
                                  F.sum(F.col("n") * F.col("count")).alias("more_count")))
    return (found.where("a_id IS NULL").drop("a_id", "b_id", "n").join(joined, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                    (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"),
                    "groups_sha256", "n_group_links"))


def links(docs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One row per link: doc_id, kind ('overlap' or 'group'), places of both tokens in the text's token lists, their
    ids, and the bytes that they share (1 for a shared group)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers(**paths)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                units = tok.units(text.as_py() or "")
                a, b, ok = tok.encode(units)
                if not ok.all():
                    continue
                block = Aligned(tok, units, a, b)
                for kind, found in (("overlap", block.overlaps()), ("group", block.together())):
                    for row, column, value in found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc_id] * len(row), pa.int64()), pa.array([kind] * len(row), pa.string()),
                             pa.array(row), pa.array(column), pa.array(block.a_ids[row].astype(np.int32)),
                             pa.array(block.b_ids[column].astype(np.int32)), pa.array(value)],
                            ["doc_id", "kind", "a_at", "b_at", "a_id", "b_id", "weight"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, kind string, a_at long, b_at long, a_id int, b_id int, weight long"))


def public_tokenizer_paths() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pieces": public_tokenizers.path("piece_bpe_32k.model")}


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizer_paths())
