import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from convops.llm import packing as P

PATHS = P.public_vocabulary()


def check_tiling(pieces, ids_of, window):
    """Every id in one piece, every sequence gapless, nothing padded beyond a power of two but full windows."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.length, bytes(p.ids), p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0
    for doc_id, parts in docs.items():
        whole = b"".join(b for _, _, b, _ in sorted(parts))
        starts = sorted(parts)
        assert [s for s, *_ in starts] == list(np.cumsum([0] + [n for _, n, *_ in starts])[:-1])
        assert whole == ids_of[doc_id].astype("<u4").tobytes()
        assert {n for *_, n in parts} == {len(ids_of[doc_id])}


def reference_ids(texts):
    tok = Tokenizer.from_file(PATHS["vocabulary"])
    return {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [P.END_ID]) for i, t in texts.items()}


def test_every_id_once_in_gapless_sequences(spark):
    texts = {1: None, 2: "", 3: "one two three", 4: "word " * 5000, 5: "a<|endoftext|>b", 6: "é ß 日本 😀\n\n x"}
    texts |= {100 + i: "some words here and there " * (i % 37) for i in range(150)}
    rows = [(i, t, 0, 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, length int").repartition(3)
    for window in (64, 1024):
        pieces = P.pack(docs, **PATHS, window=window).collect()
        check_tiling(pieces, reference_ids(texts), window)


def test_repeated_rows_and_null_ids_are_packed_row_by_row(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z")], "doc_id long, text string")
    pieces = P.pack(docs, **PATHS, window=16).collect()
    assert sum(p.length for p in pieces) == 3 + 3 + 2


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), **PATHS).count() == 0


def test_digest_is_crc32_of_little_endian_ids(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    got = P.digests(P.pack(docs, **PATHS)).collect()
    ids = reference_ids({1: "hello world"})[1].astype("<u4")
    assert sum(g.length for g in got) == len(ids)
    for g in got:
        assert g.ids_crc32 == zlib.crc32(ids[g.start:g.start + g.length].tobytes())


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_ranks_without_overlap(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([8, 32, 100, 256]))
    histogram = np.zeros(window, np.int64)
    histogram[1:] = rng.poisson(rng.choice([0.3, 5, 60]), window - 1)
    if seed == 5:
        histogram[1:] = 0
    plan = P.Plan(histogram, window)
    used = defaultdict(list)
    for length in range(1, window):
        for rank in range(histogram[length]):
            places = plan.places(length, rank)
            assert [a for a, *_ in places] == list(np.cumsum([0] + [n for _, n, *_ in places])[:-1])
            assert sum(n for _, n, *_ in places) == length
            for _, n, sequence, offset in places:
                used[sequence].append((offset, n))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or (at & (at - 1) == 0 and at < window)


def test_least_squares_uses_up_a_histogram_that_combinations_can_fill():
    rows = P.combinations(np.array([2, 3, 5, 6]), 8)
    assert sorted(map(tuple, rows.tolist())) == [(0, 2, 6), (0, 3, 5), (2, 3, 3)]
    histogram = np.zeros(8)
    histogram[[2, 3, 5, 6]] = [50, 100, 20, 10]  # 10 * (2,6) + 20 * (3,5) + 40 * (2,3,3)
    counts = dict(zip(map(tuple, rows.tolist()), P.repeat_counts(rows, histogram)))
    assert counts[0, 2, 6] == pytest.approx(10, abs=0.1)
    assert counts[0, 3, 5] == pytest.approx(20, abs=0.1)
    assert counts[2, 3, 3] == pytest.approx(40, abs=0.1)
