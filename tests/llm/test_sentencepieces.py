import itertools
import random

import public_tokenizers
import pytest
import sentencepiece

from convops.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(spark, library):
    rng = random.Random(1)
    texts = [None, "", " ", "Hello  world", " lead", "tab\there\r\nnl", "a▁b", "naïve ﬁ", "日本語 😀", "a\x00b",
             "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaaa", "    " * 9 + "x", "1234567 89", "...!!!" * 9, "x" * 30_000,
             "word " * 20_000]
    texts += ["".join(rng.choice(" abcdeinotrsth▁.,1é") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "z", 0), (3, texts[3], 0)],
                                 "doc_id long, text string, ids int")
    rows = S.decoded(S.encoded(docs, PATH), PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "z" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == library.encode(text)
        assert r.text == library.decode(r.ids)
        if S.MARK not in text:
            assert r.text == text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.decoded(S.encoded(docs, PATH), PATH).count() == 0


def best_by_force(word, scores):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        pieces = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in scores or len(p) == 1 for p in pieces):
            total = sum(scores.get(p, -100.0) for p in pieces)
            best = max(best or (total, pieces), (total, pieces), key=lambda x: x[0])
    return best[0]


def test_unigram_walk_finds_the_best_segmentation():
    rng = random.Random(4)
    for _ in range(20):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 10 for _ in range(15)}
        words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(30)})
        for word, pieces in S.segment(words, S.Unigram(scores)):
            assert "".join(pieces) == word
            assert sum(scores.get(p, -100.0) for p in pieces) == pytest.approx(best_by_force(word, scores))


def test_bpe_walk_equals_merging_the_whole_word():
    rng = random.Random(5)
    for _ in range(30):
        scores = {"".join(rng.choice("ab▁") for _ in range(rng.randint(2, 4))): -float(k) for k in range(14)}
        model = S.Bpe(scores)
        words = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 12))) for _ in range(60)})
        for word, pieces in S.segment(words, model):
            assert pieces == S.Bpe(scores).merges(word)[0]


def test_a_walk_over_known_beginnings_looks_up_no_piece():
    """Which pieces end at a character is worked out once; pieces that don't exist aren't tried word by word."""
    class Counting(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)
    scores = Counting({p: -float(k) for k, p in enumerate(["ab", "cd", "abcd", "xabcd", "▁a", "▁abcd"])})
    words = sorted(["zzabcd", "zabcd", "xabcd", "abcd", "▁abcd", "dabcdabcd"])
    model = S.Bpe(scores)
    first = list(S.segment(words, model))
    assert first == [(w, S.Bpe(dict(scores)).merges(w)[0]) for w in words]
    asked = scores.asked
    assert list(S.segment(words, model)) == first and scores.asked == asked
