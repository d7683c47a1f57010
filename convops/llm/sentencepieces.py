"""SentencePiece encoding and decoding over a trie of distinct marked words.

A text, with a mark for each blank and one in front, falls into marked words that no piece crosses. The distinct words
of a batch are sorted, which is a depth-first walk over their trie, and the forward state of every prefix is kept on
the path: a word computes states only beyond the prefix it shares with the word before.

The forward state of a prefix is its last piece. With unigram scores (``Unigram``) that is the end of the best
segmentation of the prefix. The public model is a BPE model, for which the best sum of scores isn't the encoding: there
(``Bpe``) a prefix' encoding is its last piece after the encoding of what precedes it, and the last piece is the one
that the pair of it and the piece before would not have merged otherwise. Both go through the same walk; the BPE walk
gives the ids of the sentencepiece library.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become byte pieces (or the unknown
piece if the model has none); a mark in the text itself decodes as a blank, as in the library, so such a text doesn't
round-trip; repeated rows are encoded row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.hashing import slices
from convops.llm.shared import documents

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct words whose ids a task remembers from batch to batch.
REMEMBERED = 600_000


class Bpe:
    """Forward states by merges: which piece may follow which.

    The pieces that end at a character are found by an automaton over the pieces' beginnings: its node is the longest
    beginning of a piece that the prefix ends with, and a step of it is worked out once.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.beginnings = {""}.union(*({piece[:k] for k in range(1, len(piece) + 1)} for piece in scores))
        # node -> next character -> (next node, the pieces that end there, longest first)
        self.steps: dict[str, dict[str, tuple[str, tuple]]] = {node: {} for node in self.beginnings}
        self.endings: dict[str, tuple] = {}
        self.histories: dict[str, tuple | None] = {}
        # piece -> piece before it -> may it follow
        self.pairs: dict[str, dict[str, bool]] = {}

    def merges(self, word: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The word merged on its own: symbols left, and after each merge its score and the two end symbols."""
        symbols, did, left, right = list(word), [], [word[:1]], [word[-1:]]
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.scores.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            did.append(best)
            left.append(symbols[0])
            right.append(symbols[-1])
        return symbols, did, left, right

    def history(self, piece: str) -> tuple | None:
        """Merge scores and end symbols on the way to this piece; None if merging never makes it."""
        if piece not in self.histories:
            symbols, *rest = self.merges(piece)
            self.histories[piece] = tuple(rest) if len(symbols) == 1 else None
        return self.histories[piece]

    def may_follow(self, a: str, b: str) -> bool:
        """Would merging a + b end with exactly these two pieces?"""
        before = self.pairs.setdefault(b, {})
        known = before.get(a)
        if known is None:
            known = before[a] = self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        one, two = self.history(a), self.history(b)
        if one is None or two is None:
            return False
        (did_a, _, right), (did_b, left, _) = one, two
        i = j = 0
        never = float("-inf")
        while True:
            across = self.scores.get(right[i] + left[j], never)
            next_a = did_a[i] if i < len(did_a) else never
            next_b = did_b[j] if j < len(did_b) else never
            if across > next_a and across >= next_b and across > never:  # of equal scores the leftmost merges first
                return False
            if next_a == never and next_b == never:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def step(self, node: str, char: str) -> tuple[str, tuple]:
        """The node after this character, and (length, piece, its pairs) of the pieces that end there, longest first."""
        after = node + char
        while after not in self.beginnings:
            after = after[1:]
        ending = self.endings.get(after)
        if ending is None:
            ends = (after[k:] for k in range(len(after) - 1))
            ending = self.endings[after] = tuple(
                (len(piece), piece, self.pairs.setdefault(piece, {})) for piece in ends if piece in self.scores)
        found = self.steps[node][char] = (after, ending)
        return found

    def extend(self, word: str, i: int, states: list) -> tuple[int, str, str]:
        """The last piece of word[:i], as (its start, itself), and the node, from the states of shorter prefixes."""
        node, char = states[i - 1][2] if i > 1 else "", word[i - 1]
        node, ending = self.steps[node].get(char) or self.step(node, char)
        for n, piece, pairs in ending:
            j = i - n
            if not j:
                if self.history(piece) is None:
                    continue
                return j, piece, node
            before = states[j][1]
            known = pairs.get(before)
            if known or (known is None and self.may_follow(before, piece)):
                return j, piece, node
        return i - 1, char, node


class Unigram:
    """Forward states by the best sum of scores; a character outside the vocabulary costs ``unknown``."""

    def __init__(self, scores: dict[str, float], unknown: float = -100.0):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)

    def extend(self, word: str, i: int, states: list) -> tuple[int, str, float]:
        best = None
        for j in range(max(0, i - self.longest), i):
            piece = word[j:i]
            s = self.scores.get(piece, self.unknown if j == i - 1 else None)
            if s is not None:
                total = s + (states[j][2] if j else 0.0)
                if best is None or total > best[2]:
                    best = (j, piece, total)
        return best


def segment(words: list[str], model: Bpe | Unigram) -> Iterator[tuple[str, list[str]]]:
    """(word, pieces) of sorted distinct words: a depth-first walk that keeps the states of the current path."""
    states: list = [None]
    previous = ""
    for word in words:
        same = min(len(previous), len(word))
        while same and previous[:same] != word[:same]:
            same -= 1
        del states[same + 1:]
        for i in range(same + 1, len(word) + 1):
            states.append(model.extend(word, i, states))
        pieces, i = [], len(word)
        while i:
            j, piece = states[i][:2]
            pieces.append(piece)
            i = j
        pieces.reverse()
        previous = word
        yield word, pieces


class Codec:
    """Encoder and decoder for a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.model = Bpe({self.pieces[i]: sp.get_score(i) for i in plain})
        self.known: dict[str, bytes] = {}
        self.spelled = np.array([bytes([self.byte_of[i]]) if i in self.byte_of else b"" if sp.is_control(i)
                                 else " \u2047 ".encode() if i == self.unknown else self.pieces[i].encode()
                                 for i in range(n)], object)

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def words(self, text: str) -> list[str]:
        """The text's marked words, a lone leading mark left away."""
        if MARK not in text and "  " not in text and not text.startswith(" "):
            return text.split(" ") if text else []
        marked = _WORD.findall(MARK + text.replace(" ", MARK)) if text else []
        return [w if MARK in w[1:] else w[1:] for w in marked]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = sorted(w if MARK in w else MARK + w for w in set().union(*split) - self.known.keys())
        ids = self.ids
        for word, pieces in segment(new, self.model):
            try:
                found = [ids[p] for p in pieces]
            except KeyError:
                found = [i for p in pieces for i in self.piece_ids(p)]
            self.known[word if MARK in word[1:] else word[1:]] = array("i", found).tobytes()
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.spelled[ids].tolist()).decode("utf-8", "replace")
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int> of every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and looking for cycles among millions of words takes a third of the time
        codec = Codec(model_path)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 4 << 20):
                ids = codec.encode([t or "" for t in part.to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), _lists(ids)], ["doc_id", "ids"])
                at += len(part)
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, ids array<int>"))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text of every row of ``rows`` (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        codec = Codec(model_path)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                ids = part.column(1)
                at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                texts = [codec.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "text"])
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return decoded(encoded(documents(spark, sf_dir), path), path).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "text")
