"""The best of each query by impact blocks against the full sum, and how little is read."""

import random

import pytest

from corpusloom.operators import impact, index
from corpusloom.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 120)))) for i in range(3000)] + [(5000 + i, "w0 w1") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, index.build(docs, str(tmp_path_factory.mktemp("impact") / "index"), buckets=4)


QUERIES = [(1, "w0 w1 w2"), (2, "w0 w250"), (3, "w290"), (4, "w0"), (5, "w3 w3 w40 w41 w5"), (6, "nothing here"), (7, ""), (8, "w299 w298 w0 w1 w2 w3 w4")]


@pytest.mark.parametrize("k", [1, 10])
def test_equal_to_the_full_sum(spark, corpus, monkeypatch, k):
    docs, found = corpus
    monkeypatch.setattr(impact, "LITERALS", 400 if k == 10 else 2)
    impact.build(found, shard_docs=64)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    counts = impact.Read()
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in impact.bm25_top(found, queries, k, counts).collect()}
    want = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in R.top_k(found.bm25(queries), k).collect()}
    assert set(got) == set(want) and len(want) > 4
    for key, (doc, score) in want.items():
        assert got[key][0] == doc and got[key][1] == pytest.approx(score, abs=1e-9)
    assert counts.first + counts.more + counts.rest <= counts.all


def test_common_terms_are_mostly_passed_over(spark, corpus):
    _, found = corpus
    impact.build(found, shard_docs=64)
    counts = impact.Read()
    queries = spark.createDataFrame([(1, "w290 w0 w1"), (2, "w285 w0 w2")], "query_id int, query string")
    got = impact.bm25_top(found, queries, 3, counts).collect()
    assert len(got) == 6 and counts.first + counts.more + counts.rest < counts.all / 2
