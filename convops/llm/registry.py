"""Query name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from convops.llm import (
    ann, centroids, exact_dedup, html_extraction, language_id, masked_lm, ngram_join, packing, pii, quality, sentencepieces,
    token_alignment, toxicity,
)
from convops.llm.shared import small_batches


def _bounded(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        small_batches(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_sentencepieces": sentencepieces.op4_sentencepieces,
    "op5_nearest_neighbours": ann.op5_nearest_neighbours,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_masked_lm": masked_lm.op8_masked_lm,
    "op9_language_id": language_id.op9_language_id,
    "op10_html_extraction": html_extraction.op10_html_extraction,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroid_clusters": centroids.op13_centroid_clusters,
}
QUERIES = {name: _bounded(fn) for name, fn in QUERIES.items()}

ORACLE_SQL = {
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_centroid_clusters": centroids.ORACLE_SQL,
}
