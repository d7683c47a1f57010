import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convops.llm import token_alignment as ta
from convops.llm.shared import documents
from tests.conftest import SF001

PATHS = ta.public_tokenizer_paths()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


@pytest.fixture(scope="module")
def tok():
    return ta.Tokenizers(**PATHS)


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, their byte ranges) by the libraries on whole texts, or None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(PATHS["vocabulary"])
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS["pieces"])
    vocabulary = {i: t for t, i in a_tok.get_vocab().items()}
    symbol = ta.byte_of_symbol()

    def ranges(tokens):
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    def one(text):
        if not text:
            return None
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        a_bytes = [bytes(symbol[c] for c in vocabulary[i]) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                   else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return None
        return a, b, ranges(a_bytes), ranges(b_bytes)
    return one


def by_hand(rows, plain):
    """The digests by loops over all pairs of neighbouring tokens."""
    found = [(doc_id, plain(text)) for doc_id, text in rows]
    linked, counts = [], Counter()
    for _, f in found:
        pairs = []
        if f:
            a, b, ra, rb = f
            start = 0
            for i, (s, e) in enumerate(ra):
                while start < len(rb) and rb[start][1] <= s:
                    start += 1
                j = start
                while j < len(rb) and rb[j][0] < e:
                    pairs.append((a[i], b[j]))
                    j += 1
        linked.append(pairs)
        counts.update(pairs)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (doc_id, f), pairs in zip(found, linked):
        if not f:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, ra, rb = f
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = [([], []) for _ in cuts]
        for ids, ranges, side in ((a, ra, 0), (b, rb, 1)):
            for i, (x, _) in zip(ids, ranges):
                groups[bisect.bisect_right(cuts, x)][side].append(i)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(counts[p] == top[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest(),
                    sum(len(x) * len(y) for x, y in groups)))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


TEXTS = ["Hello world, it's fine.", "", None, "Hello world, it's fine.", "  two  blanks \n and\ttabs ", "a\n \nb  c ",
         "naïve 東京 \U0001f600 x", "<|endoftext|> <s> </s> <unk> <0x41>", "marked▁word", "x", " ", "\x00\x01 \x85 　y",
         "unbelievable " * 50 + "re.\n Foo", "ﬁne ½ ™  nbsp", "é combining", "a" * 3000, " \n" * 300 + "z"]


@pytest.mark.parametrize("hot_pairs", [0, 30, ta.HOT_PAIRS])
def test_digests_equal_loops(spark, plain, hot_pairs):
    rows = [*enumerate(TEXTS), (None, "Hello world"), (3, "Hello again")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, row string, a_id int")
    assert collected(ta.digests(df.repartition(3), PATHS, hot_pairs)) == by_hand(rows, plain)


def test_documents_equal_loops(spark, plain):
    docs = documents(spark, SF001)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert collected(ta.op11_token_alignment(spark, SF001)) == by_hand(rows, plain)


def test_forgetting_changes_nothing(spark, plain, monkeypatch):
    monkeypatch.setattr(ta, "REMEMBERED_CHARS", 40)
    monkeypatch.setattr(ta, "SLICE_BYTES", 50)
    monkeypatch.setattr(ta, "BLOCK", 7)
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert collected(ta.digests(df, PATHS, 20)) == by_hand(rows, plain)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.digests(df, PATHS).collect() == [] and ta.links(df, PATHS).collect() == []


def test_links_rows(spark, plain):
    rows = list(enumerate(TEXTS))
    got = ta.links(spark.createDataFrame(rows, "doc_id long, text string"), PATHS).collect()
    want = set()
    for i, text in rows:
        f = plain(text)
        if f:
            want |= {(i, x, y, f[0][x], f[1][y], min(e, v) - max(s, u)) for x, (s, e) in enumerate(f[2])
                     for y, (u, v) in enumerate(f[3]) if min(e, v) > max(s, u)}
    assert {tuple(r)[:1] + tuple(r)[2:] for r in got if r["kind"] == "overlap"} == want
    per_doc = {r[0]: r[-1] for r in by_hand(rows, plain)}
    groups = Counter(r["doc_id"] for r in got if r["kind"] == "group")
    assert {i: groups.get(i, 0) for i in per_doc} == per_doc


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'.é1▁"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_equal_whole_texts(tok, plain, text):
    units = tok.units(text)
    a, b, ok = tok.encode(units)
    want = plain(text)
    if want is None:
        assert not units or not ok.all()
    else:
        assert ok.all() and a.tolist() == want[0] and b.tolist() == want[1]


def test_units_that_fail_do_not_take_others_along(tok, plain):
    units = ["fine", "▁bad", "a\n", "x▁", " b", "naïve", "\u3000y", "end"]
    a, b, ok = tok.encode(units)
    want = [plain(u) for u in units]
    assert ok.tolist() == [w is not None for w in want] and not ok.all()
    assert a.tolist() == [i for w in want if w for i in w[0]] and b.tolist() == [i for w in want if w for i in w[1]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(0, 9), st.integers(0, 9), st.integers(1, 7), st.integers(1, 30))
def test_products_equal_dense(seed, n, m, columns, block):
    rng = np.random.default_rng(seed)
    x, y = rng.random((n, columns)) < 0.4, rng.random((m, columns)) < 0.4

    def csr(dense):
        row, column = np.nonzero(dense)
        return ta.Csr(np.concatenate([[0], np.cumsum(dense.sum(1))]).astype(np.int64), column, columns)
    got = np.zeros((n, m), int)
    for row, column, value in ta.products(csr(x), csr(y), block):
        got[row, column] += value
    assert (got == x.astype(int) @ y.astype(int).T).all()


def test_long_white_space(tok):
    a, b, ok = tok.encode([" " * 1_000_000 + "x"])
    assert ok.all() and len(a) > 1000
