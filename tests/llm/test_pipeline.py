"""The stages one after the other on the smallest tables, each against a plain version; the registered queries."""

import re

import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from convops.llm import quality, registry
from convops.llm.shared import stored
from tests.conftest import SF001
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check_tiling, reference_ids
from tests.oracle_check import compare_key, duck

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(stored(stage(spark, out[-1], SF001), "test-" + name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert [name for name, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]


def test_rejected_documents_go_and_good_ones_stay(spark, stages):
    docs, kept = stages[0], texts(stages[1])
    model = quality.learn(docs, quality.learnable(spark.read.parquet(f"{SF001}/labels.parquet")))
    want = {r.row.doc_id for r in quality.scored(docs, model).collect() if r.score >= quality.THRESHOLD}
    assert set(kept) == want
    good = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(kept)) >= 0.97 * len(good & set(texts(docs)))


def test_of_equal_texts_the_largest_id_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    last = {}
    for i in sorted(before):
        last[before[i]] = i
    assert after == {i: t for t, i in last.items()}


def test_one_document_of_each_group_of_near_copies_stays(stages):
    before = texts(stages[2])
    components = {i: c for i, _, c in brute(sorted(before.items()))}
    assert texts(stages[3]) == {i: t for i, t in before.items() if components[i] == i}


def test_personal_data_is_gone_and_the_rest_is_unchanged(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    found = re.compile(r"\S+@\S+\.\w+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+\d+ \(\d+\) \d+-\d+|\b\d{13,19}\b|password=\w+|token = \"\w+")
    changed = 0
    for i, text in before.items():
        mentions = found.findall(text)
        changed += bool(mentions)
        assert all(m not in after[i] for m in mentions)
        assert found.sub("", text) == found.sub("", after[i])
        if not mentions:
            assert after[i] == text
    assert changed
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_every_token_is_packed_once(spark, stages):
    docs = stages[4]
    pieces = C.packing.pack(docs, **C.packing.public_vocabulary()).collect()
    check_tiling(pieces, reference_ids(texts(docs)), C.packing.WINDOW)
    assert stages[5].count() == len(pieces)


def test_stages_take_empty_docs_and_extra_columns(spark, stages):
    docs = stages[0].selectExpr("*", "1 AS row", "'x' AS at", "2.0 AS score", "'k' AS key", "3 AS maybe", "4 AS bitmap",
                                 "5 AS file", "'t' AS text_").limit(12)
    for empty in (False, True):
        df = stored(docs.limit(0) if empty else docs, "test-extra")
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, df, SF001)
            assert out.columns == df.columns
            df = stored(out, "test-extra")
        assert (C.STAGES[-1][1](spark, df, SF001).count() == 0) == empty


def test_all_queries_are_registered():
    names = E.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == sorted(
        registry.QUERIES, key=lambda n: int(re.match(r"op(\d+)", n)[1]))
    assert "pipeline" in names and set(registry.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    res = compare_key(spark, duck(SF001), registry.QUERIES, registry.ORACLE_SQL, name, SF001)
    assert res["cols_match"] and res["values_match"], res


def test_every_stage_begins_with_collected_garbage(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in beans)
    C.give_back(spark)
    assert sum(b.getCollectionCount() for b in beans) > before

    class Called(Exception):
        pass

    def called(_):
        raise Called
    monkeypatch.setattr(C, "give_back", called)
    for _, stage in C.STAGES:
        with pytest.raises(Called):
            stage(spark, None, SF001)
