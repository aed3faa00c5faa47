"""Searches of many long queries: the best of each against the full sum, whatever the blocks and tasks."""

import random

import numpy as np
import pytest

from corpusloom.operators import impact, index
from corpusloom.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i * 3, " ".join(draw.choices(words, weights, k=draw.randint(1, 90)))) for i in range(1500)]
    rows += [(9000 + i, "w0 w1 w7 w7") for i in range(60)] + [(9900, None), (9901, ""), (9902, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = index.build(docs, str(tmp_path_factory.mktemp("batch") / "index"), features=150, buckets=4)
    asked = [(f"q{i}", " ".join(draw.choices(words, weights, k=40))) for i in range(30)] + [("copies", "w7 w7 w0"), ("one", "alone"), ("none", "zzz"), ("empty", "")]
    return found, spark.createDataFrame(asked, "query_id string, query string")


def ranked(df):
    return {(r["query_id"], r["rank"]): (r["doc_id"], pytest.approx(r["score"], abs=1e-9)) for r in df.collect()}


@pytest.mark.parametrize("cells", [1 << 22, 3000])
def test_equal_to_the_sum_over_postings(corpus, monkeypatch, cells):
    found, asked = corpus
    monkeypatch.setattr(index, "CELLS", cells)  # many blocks of queries, or one
    for k in (1, 7):
        assert ranked(found.best_bm25(asked, k)) == ranked(R.top_k(found.bm25(asked), k))
        assert ranked(found.best_tfidf(asked, k)) == ranked(R.top_k(found.tfidf(asked), k))


def test_of_equal_scores_the_lesser_ids(corpus):
    found, asked = corpus
    got = [r["doc_id"] for r in found.best_bm25(asked.where("query_id = 'copies'"), 25).orderBy("rank").collect()]
    copies = [d for d in got if 9000 <= d < 9100]
    assert len(copies) > 3 and copies == list(range(9000, 9000 + len(copies)))


def test_a_batch_beyond_the_bound_meets_the_postings(corpus, monkeypatch):
    found, asked = corpus
    monkeypatch.setattr(index, "ASKED", 10)
    assert ranked(found.best_bm25(asked, 3)) == ranked(R.top_k(found.bm25(asked), 3))


def test_long_batches_do_not_read_levels(corpus, monkeypatch):
    found, asked = corpus
    monkeypatch.setattr(impact, "MOST_TERMS", 50)
    monkeypatch.setattr(impact, "_read", None)
    assert ranked(impact.bm25_top(found, asked, 5)) == ranked(R.top_k(found.bm25(asked), 5))


def test_the_head_keeps_what_the_whole_order_has():
    draw = np.random.default_rng(3)
    scores = np.round(draw.random((500, 4)), 2)  # many ties
    ids = draw.permutation(500)
    head = index.Head(4, 6)
    for at in range(0, 500, 37):
        head.add(ids[at : at + 37], scores[at : at + 37])
    query, doc, _ = head.best()
    for q in range(4):
        want = sorted(range(500), key=lambda i: (-scores[i, q], ids[i]))[:6]
        assert list(doc[query == q]) == [ids[i] for i in want if scores[i, q] > 0]


def test_postings_are_stored_as_arrays(spark, corpus):
    found, _ = corpus
    assert spark.read.parquet(f"{found.path}/words").count() < found.table("words").count() / 2
    assert found.table("words").groupBy("term").count().exceptAll(found.table("terms").selectExpr("term", "df")).isEmpty()


def test_texts_of_hits_come_once_and_no_text_is_shuffled(spark):
    hits = R.written(spark.createDataFrame([(1, 5), (2, 5), (1, 7), (1, 99)], "query_id int, doc_id bigint"), "hits")
    texts = R.written(spark.range(20).selectExpr("id as doc_id", "repeat('x', 100) || id as text"), "many")
    assert sorted(r["doc_id"] for r in R.of_hits(hits, texts).collect()) == [5, 7]
    plan = texts.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
