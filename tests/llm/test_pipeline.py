"""The pipeline, stage by stage, against brute force on the smallest tables."""

import re

import duckdb
import pytest
from corpora import classes
from oracle import connect, differences
from test_others import ids_of, luhn

import corpus_pipeline
from popgauge.llm import decontaminate, quality, queries, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas())
        out.append(docs.toPandas())
    return [t.set_index("doc_id", drop=False) for t in out]


def test_rejected_documents_go(spark, stages):
    docs, labels = (queries.table(spark, FOLDER, t) for t in ("documents", "labels"))
    predicted = {r["doc_id"]: r["predicted"] for r in quality.scores(docs, labels).collect()}
    assert set(stages[1].index) == {i for i, p in predicted.items() if p}
    marked = labels.toPandas().set_index("doc_id").quality
    good = marked[marked == 1].index
    assert len(set(good) - set(stages[1].index)) <= 0.02 * len(good)


def test_one_of_each_group_stays(stages):
    texts = stages[1].text
    prints = [simhash.fingerprint(simhash.shingles(t.encode(), 3))[0] & (2 ** 64 - 1) for t in texts]
    alike = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    want = {min(texts.index[j] for j in range(len(prints)) if root[j] == r) for root in [classes(len(prints), alike)] for r in root}
    assert set(stages[2].index) == want


def test_benchmark_passages_are_cut(spark, stages):
    bench = queries.table(spark, FOLDER, "benchmark")
    before, after = (spark.createDataFrame(t.reset_index(drop=True)) for t in stages[2:4])
    hit = {r["doc_id"] for r in decontaminate.contamination(before, bench).where("n_hit > 0").collect()}
    assert hit and decontaminate.contamination(after, bench).where("n_hit > 0").count() == 0
    assert {i for i in stages[2].index if stages[2].text[i] != stages[3].text[i]} == hit


def test_personal_numbers_are_replaced(stages):
    valid = 0
    for i in stages[3].index:
        old, new = stages[3].text[i], stages[4].text[i]
        found = [c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", old) if luhn(c)] + re.findall(r"\+\d \(\d{3}\) \d{3}-\d{4}", old)
        assert not any(c in new for c in found)
        valid += len(found)
        if not re.search(r"\d{7}|@|\d\.\d|\d-\d|\d/\d", old):
            assert old == new
    assert valid


def test_every_token_is_packed(stages):
    want = {i: len(ids_of(t)) + 1 for i, t in stages[4].text.items()}
    assert stages[5].reset_index(drop=True).groupby("doc_id").n_tokens.sum().to_dict() == want


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, stages[5][columns].values.tolist()))
    assert [len(t) for t in stages[:5]] == sorted([len(t) for t in stages[:5]], reverse=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con: duckdb.DuckDBPyConnection = connect(FOLDER)
    assert differences(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name]) == []
