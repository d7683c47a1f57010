"""Quality classification by a sparse rule ensemble.

Statistics of the whole text are Spark columns. On labelled documents, boosted shallow trees over these statistics
give conjunctive rules (the path to every node); a logistic regression with an L1 penalty weighs rules and keeps few;
the result is compiled into one Spark column expression, so scoring is a projection without Python.

The classifier is fitted in numpy on at most ``SAMPLE_ROWS`` labelled rows, taken in the order of a hash of their
ids. Scoring reads every row and whole text.

Defined cases: null text scores as empty text, and an empty text has statistics of its own (all zero), so it gets a
score like any other; labels that are null or belong to no document are not learned from, a document with several
labels is learned from once per label, and of several texts under one id the greatest; without any labels, or with one class only, every score is the share of
label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.shared import documents, remainder

SAMPLE_ROWS = 10_000
TREES, DEPTH, CUTS, RATE = 40, 3, 24, 0.3
PENALTIES = (0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0003)
THRESHOLD = 0.3


STATISTICS = ("chars", "words", "lines", "word_length", "line_words", "distinct_words", "distinct_lines", "upper",
              "digits", "symbols", "exclaims", "stops", "commas")


def statistics(docs: DataFrame) -> DataFrame:
    """(row: all columns of ``docs``, then one double per name in STATISTICS, zero for an empty text).

    Projections follow one another so that each split of a text is computed once.
    """
    t = F.col("text_")
    counts = {"words": F.size("words_"), "distinct_words": F.size(F.array_distinct("words_")),
              "lines": F.size("lines_"), "distinct_lines": F.size(F.array_distinct("lines_")), "chars": F.length(t),
              "upper": F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")),
              "digits": F.length(F.regexp_replace(t, "[^0-9]+", "")),
              "symbols": F.length(F.regexp_replace(t, "[^#$%&*|<>{}=~^\\\\@_]+", "")),
              **{name: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
                 for name, c in (("exclaims", "!"), ("stops", "."), ("commas", ","))}}
    per = {"word_length": ("chars", "words"), "line_words": ("words", "lines"), "distinct_words": ("distinct_words", "words"),
           "distinct_lines": ("distinct_lines", "lines"),
           **{n: (n, "chars") for n in ("upper", "digits", "symbols", "exclaims", "stops", "commas")}}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = (docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text_"))
             .select("row", "text_", F.split("text_", " ").alias("words_"), F.split("text_", "\n").alias("lines_"))
             .select("row", *(c.cast("double").alias(n) for n, c in counts.items())))
    some = F.col("chars") > 0
    return parts.select("row", *(F.when(some, F.col(per[n][0]) / F.col(per[n][1]) if n in per else F.col(n))
                                 .otherwise(F.lit(0.0)).alias(n) for n in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, True for 'at least' / False for 'below', cut) with its weight."""
    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, cut in self.tests:
            out = out & ((stats[name] >= cut) if at_least else (stats[name] < cut))
        return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stats: dict[str, Column]) -> Column:
        terms = [F.lit(self.intercept)] + [F.when(r.column(stats), F.lit(r.weight)).otherwise(F.lit(0.0))
                                           for r in self.rules]
        while len(terms) > 1:  # a shallow sum
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def tree_paths(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator) -> list[tuple]:
    """Distinct node paths of boosted trees for the logistic loss; every tree sees a random half of the rows."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(k)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], "right") for j in range(k)], 1)
    z = np.full(n, np.log(y.mean() / (1 - y.mean())))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        p = _sigmoid(z)
        g, h = y - p, p * (1 - p)
        half = rng.random(n) < 0.5
        some = rng.permutation(k)[:max(2, (2 * k) // 3)]
        stack = [(np.ones(n, bool), ())]
        while stack:
            mask, path = stack.pop()
            mine = mask & half
            best = None
            if len(path) < DEPTH and mine.sum() >= 10:
                total_g, total_h = g[mine].sum(), h[mine].sum() + 1.0
                for j in some:
                    m = len(cuts[j]) + 1
                    gs = np.bincount(bins[mine, j], g[mine], m).cumsum()[:-1]
                    hs = np.bincount(bins[mine, j], h[mine], m).cumsum()[:-1] + 1.0
                    if not len(gs):
                        continue
                    gain = gs ** 2 / hs + (total_g - gs) ** 2 / (total_h - hs + 2.0) - total_g ** 2 / total_h
                    c = int(np.argmax(gain))
                    if gain[c] > 1e-3 and (best is None or gain[c] > best[0]):
                        best = (gain[c], j, c)
            if best is None:
                if path and mine.any():
                    z[mask] += RATE * g[mine].sum() / (h[mine].sum() + 1.0)
                continue
            _, j, c = best
            for at_least in (False, True):
                own = mask & ((bins[:, j] > c) == at_least)
                step = (*path, (names[j], at_least, float(cuts[j][c])))
                paths[tuple(sorted(step))] = None
                stack.append((own, step))
    return list(paths)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None,
          steps: int = 200) -> np.ndarray:
    """Logistic loss plus penalty * |w|_1 by accelerated proximal gradient; the last weight is the free intercept."""
    n, k = a.shape
    v = np.ones(k + 1)
    b = np.hstack([a, np.ones((n, 1), a.dtype)])
    for _ in range(15):
        v = b.T @ (b @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (b.T @ (b @ v))), 1e-9)
    w = u = np.zeros(k + 1) if start is None else start
    t = 1.0
    shrink = np.append(np.full(k, penalty), 0.0)
    for _ in range(steps):
        new = u - rate * (b.T @ (_sigmoid(b @ u) - y)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * shrink, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 0) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9))
        return Ensemble((), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    paths = tree_paths(x, y, names, rng)
    at = {n: j for j, n in enumerate(names)}
    a = np.stack([np.all([(x[:, at[s]] >= c) == up for s, up, c in p], axis=0) for p in paths], 1).astype(np.float32)
    _, first = np.unique(np.packbits(a.astype(bool), axis=0), axis=1, return_index=True)
    keep = np.sort(first)
    a, paths = a[:, keep], [paths[i] for i in keep]
    fold = rng.random(len(y)) < 0.25
    penalty, w, tried = PENALTIES[0], None, []
    if fold.any() and not fold.all():
        for penalty in PENALTIES:  # along the path, each fit starts from the last
            w = lasso(a[~fold], y[~fold], penalty, w)
            p = np.clip(_sigmoid(a[fold] @ w[:-1] + w[-1]), 1e-6, 1 - 1e-6)
            loss = -(y[fold] * np.log(p) + (1 - y[fold]) * np.log(1 - p))
            tried.append((float(loss.mean()), penalty))
        penalty = min(tried)[1]
    w = lasso(a, y, penalty, steps=600)
    rules = tuple(Rule(p, round(float(v), 6)) for p, v in zip(paths, w) if abs(v) > 1e-3)
    return Ensemble(rules, round(float(w[-1]), 6))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on the labelled rows of ``docs`` (doc_id, text) with ``labels`` (doc_id, quality)."""
    some = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows))
    # some: at most sample_rows ids
    sample = (docs.select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id")
              .groupBy("doc_id", "quality").agg(F.max("text").alias("text")))
    rows = (statistics(sample)
            .select("row.doc_id", F.col("row.quality").cast("double").alias("quality"), *STATISTICS)
            .toPandas().sort_values(["doc_id", "quality", *STATISTICS], kind="stable"))
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float), list(STATISTICS))


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(row: all columns of ``docs``, score)."""
    return statistics(docs).select("row", model.score({n: F.col(n) for n in STATISTICS}).alias("score"))


def accepted(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``.

    The condition also looks at a column that is not deterministic, and so is not pushed below the projections: there
    every use of a statistic would measure the text again.
    """
    out = scored(docs, model).withColumn("at", F.monotonically_increasing_id())
    return out.where((F.col("score") >= threshold) & (F.col("at") >= 0)).select("row.*")


def learnable(labels: DataFrame) -> DataFrame:
    """The labels of documents outside the held-out fold."""
    return labels.where(remainder("doc_id", 5) != 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, learnable(labels))
    return scored(docs, model).select("row.doc_id", "score").select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
