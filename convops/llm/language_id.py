"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its learned texts. The letters of a text are cut into
blocks; a block's cost in a language is its compressed size given that dictionary, and the language with the smallest
sum wins. A narrow win is looked at once more, each language's cost now being what the text adds to a block of learned
text, whose letter frequencies then count too. A text whose two best languages still lie close together is marked
unreliable.

The dictionaries are the classifier: they come from a bounded sample (at most ``SAMPLE_DOCS`` documents a language,
taken in the order of a hash of their ids, at most ``DICTIONARY_BYTES`` in all), which leaves a long text a share of
``PIECES`` pieces of ``PIECE_CHARS`` characters spread evenly from its start to its end. The ``LANGUAGES`` most frequent
values are learned. Every text is judged whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not reliable; languages whose
dictionaries tie are ordered by the learned documents' number, then by name; with nothing to learn from every text is ``und``; null languages and null ids
are not learned from; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convops.llm.shared import documents, remainder

SAMPLE_DOCS = 400
PIECES, PIECE_CHARS = 6, 250
LANGUAGES = 1000
DICTIONARY_BYTES = 160_000
BLOCK = 8192
#: Learned text before a text that is looked at again; not part of the dictionary.
PRIME_BYTES = 16_384
#: A short block is searched for shorter matches, which a slower level finds.
SHORT, SHORT_LEVEL, LEVEL = 1024, 19, 3
#: The runner-up must cost at least this much more, in bytes and as a share, for a reliable answer.
MARGIN_BYTES, MARGIN_SHARE = 3, 0.01
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters, one blank between them."""
    return _NOT_LETTERS.sub(" ", text or "").strip().lower()


def dictionaries(learned: DataFrame) -> dict[str, bytes]:
    """Language -> learned content, most frequent language first, from (doc_id, text, lang)."""
    known = learned.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    size = {r["lang"]: r["count"] for r in sizes.collect()}
    counts = known.sparkSession.createDataFrame(list(size.items()), "lang string, n long")  # at most LANGUAGES rows
    # a language's smallest hashes: those below a bound that about twice as many as are taken lie under come together
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    some = (known.select("doc_id", "lang", place.alias("place")).join(F.broadcast(counts), "lang")
            .where(F.col("place").cast("double") * F.col("n") < F.lit(float(2 * SAMPLE_DOCS << 40)))
            .select("doc_id", "lang", "place").distinct().withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= SAMPLE_DOCS).select("doc_id", "lang", "rank"))
    # at most SAMPLE_DOCS ids a language; of several texts under one id the greatest is learned
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(some), ["doc_id", "lang"])
    sample = (texts.groupBy("lang", "rank").agg(F.max("text").alias("text"))
              .select("lang", "rank", spread("text").alias("text")).collect())
    return content_of([(r["lang"], r["text"]) for r in sorted(sample, key=lambda r: (r["rank"], r["text"]))], size)


def spread(c: str) -> Column:
    """The text, or of one longer than PIECES * PIECE_CHARS as many pieces as that, evenly spread over all of it."""
    step = (F.length(c) - PIECE_CHARS) / F.lit(PIECES - 1)
    pieces = [F.substring(F.col(c), F.floor(step * i).cast("int") + 1, F.lit(PIECE_CHARS)) for i in range(PIECES)]
    return F.when(F.length(c) <= PIECES * PIECE_CHARS, F.col(c)).otherwise(F.concat_ws(" ", *pieces))


def content_of(sample: list[tuple[str, str]], size: dict[str, int]) -> dict[str, bytes]:
    out: dict[str, bytes] = {k: b"" for k in sorted(size, key=lambda k: (-size[k], k))}
    for lang, text in sample:
        piece = (letters(text) + " ").encode()
        if len(piece) > 1 and len(out[lang]) + len(piece) <= DICTIONARY_BYTES:
            out[lang] += piece
    return {k: v for k, v in out.items() if len(v) >= 16}


def classifier(content: dict[str, bytes]):
    """text -> (language, score, reliable)."""
    import zstandard as zstd

    names = list(content)
    fast, fine, again = [], [], []
    for name in names:
        known = content[name]
        prime = known[:min(PRIME_BYTES, len(known) // 2)]
        for level, out in ((LEVEL, fast), (SHORT_LEVEL, fine)):
            raw = zstd.ZstdCompressionDict(known[len(prime):], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            out.append(zstd.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False))
        again.append((fast[-1], prime, len(fast[-1].compress(prime))))

    def close(sizes: np.ndarray) -> bool:
        if len(sizes) < 2:
            return False
        best, second = np.partition(sizes, 1)[:2]
        return second - best < max(MARGIN_BYTES, MARGIN_SHARE * best)

    def judge(text: str | None) -> tuple[str, float, bool]:
        body = letters(text).encode()
        if not body or not names:
            return "und", 0.0, False
        blocks = [body[at:at + BLOCK] for at in range(0, len(body), BLOCK)]
        sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in (fine if len(body) <= SHORT else fast)], float)
        if close(sizes):
            sizes = np.array([sum(len(c.compress(prime + b)) - base for b in blocks) for c, prime, base in again], float)
        best = int(np.argmin(sizes))
        score = 1.0 / np.exp2(-np.minimum(sizes - sizes[best], 60.0)).sum()
        return names[best], float(score), not close(sizes)
    return judge


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, reliable for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = classifier(shared.value)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            lang, score, reliable = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(reliable, pa.bool_())], ["doc_id", "lang_pred", "score", "reliable"])
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, reliable boolean"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    learned = docs.where(~held).select("doc_id", "text", "lang")
    out = identify(docs, dictionaries(learned))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "reliable")
