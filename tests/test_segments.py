"""The segmented index against an index built anew, after every change."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index
from corpusloom.operators import retrieval as R
from corpusloom.operators import segments as S

WORDS = [f"w{i}" for i in range(40)]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def scores(df):
    return {(r["query_id"], r["doc_id"]): r["score"] for r in df.collect()}


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MERGE", 3)
    draw, index, docs = random.Random(2), S.SegmentedIndex(spark, str(tmp_path / "index"), 4), {}
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w7 nothing"), (3, "")], "query_id int, query string")
    text = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 12)))
    merged = 0
    for step in range(6):
        batch, want = {}, dict.fromkeys(("added", "modified", "deleted", "unchanged"), 0)
        for i in draw.sample(range(40), 3 if step else 30):
            gone = step > 0 and draw.random() < 0.3
            batch[i] = (docs[i] if i in docs and draw.random() < 0.2 else text(), gone)
        for i, (t, gone) in batch.items():
            kind = ("deleted" if i in docs else None) if gone else "added" if i not in docs else "unchanged" if docs[i] == t else "modified"
            if kind:
                want[kind] += 1
            if gone:
                docs.pop(i, None)
            else:
                docs[i] = t
        rows = [(i, t, g, "x") for i, (t, g) in batch.items()] + [(None, "w1", False, "x")]
        got = index.apply(spark.createDataFrame(rows, "doc_id bigint, text string, deleted boolean, segment string"), step)
        assert got == want
        merged += any(s["segment"].endswith("m") for s in index.state())
        live = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
        assert scores(index.bm25(queries)) == pytest.approx(scores(R.bm25(queries, live)))
    assert merged and len(index.state()) < 6
    before = scores(index.bm25(queries))
    # the last batch again, as after a failure
    index.apply(spark.createDataFrame(rows, "doc_id bigint, text string, deleted boolean, segment string"), step)
    assert scores(index.bm25(queries)) == pytest.approx(before)
    assert index.vacuum() > 0 and scores(index.bm25(queries)) == pytest.approx(before) and len(index.versions()) == 1


def test_what_is_written_follows_the_change(spark, tmp_path):
    index, draw = S.SegmentedIndex(spark, str(tmp_path / "index"), 4), random.Random(3)
    rows = [(i, " ".join(f"t{draw.randint(0, 30000)}" for _ in range(300))) for i in range(600)]
    index.apply(spark.createDataFrame(rows, "doc_id bigint, text string"))
    whole = size(tmp_path)
    index.apply(spark.createDataFrame([(5, "one new text"), (7, None), (7, "of two rows")], "doc_id bigint, text string"))
    assert size(tmp_path) - whole < whole / 20
    index.apply(spark.createDataFrame([(5, "one new text")], "doc_id bigint, text string"))
    assert [s["docs"] for s in index.state()] == [600, 2] and index.state()[0]["dead"] == 2
    assert scores(index.bm25(spark.createDataFrame([(1, "new rows")], "query_id int, query string"))).keys() == {(1, 5), (1, 7)}
    empty = S.SegmentedIndex(spark, str(tmp_path / "empty"))
    assert empty.bm25(spark.createDataFrame([(1, "new")], "query_id int, query string")).collect() == []


def test_a_stream_of_changes(spark, tmp_path):
    source = tmp_path / "in"
    index = S.SegmentedIndex(spark, str(tmp_path / "index"), 2)
    batches = [[(1, "a b", False), (2, "b c", False)], [(1, "c c", False), (3, "a", False)], [(2, None, True)]]
    schema = "doc_id bigint, text string, deleted boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        S.follow(spark.readStream.schema(schema).parquet(str(source)), index, str(tmp_path / "checkpoint")).awaitTermination()
        assert len(index.versions()) == k + 1
    live = spark.createDataFrame([(1, "c c"), (3, "a")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a b c")], "query_id int, query string")
    assert scores(index.bm25(queries)) == pytest.approx(scores(R.bm25(queries, live)))
    assert index.documents(index.state()).select(F.sum("len")).first()[0] == 3


def test_counts_by_slices_are_those_of_each_document(spark, monkeypatch):
    monkeypatch.setattr(index, "SLICE", 5)
    docs = [(1, "a b a b c".split()), (2, []), (3, ["b"]), (4, "c a b a b a b x y".split()), (5, "é a b".split())]
    tokens = spark.createDataFrame(docs, "doc_id int, t array<string>").coalesce(1)
    got = {(r["doc_id"], r["term"]): (r["len"], r["tf"]) for r in index.counted(tokens).collect()}
    assert got == {(i, w): (len(t), t.count(w)) for i, t in docs for w in t}
    words = ["a", "b", "é"]
    few = {r["term"]: (r["cf"], r["df"]) for r in index.pair_counts(tokens, words).collect()}
    every = {r["term"]: (r["cf"], r["df"]) for r in index.pair_counts(tokens, None).collect()}
    assert few == {t: n for t, n in every.items() if set(t.split()) <= set(words)} and every["a b"] == (6, 3) and few["b a"] == (3, 2)
    weights = {"a b": 2.0, "b": 1.0, "x": 3.0, "q q": 1.0}
    w = {(r["doc_id"], r["term"]): r["w"] for r in index.counted(tokens, weights).collect()}
    size = (6.0**2 + 3.0**2 + 3.0**2) ** 0.5
    assert {t: round(x * size, 9) for (i, t), x in w.items() if i == 4} == {"a b": 6.0, "b": 3.0, "x": 3.0} and w[3, "b"] == 1.0 and {i for i, _ in w} == {1, 3, 4, 5}


def test_workers_get_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BATCH", 7)
    monkeypatch.setattr(S, "BATCH_BYTES", 40_000)
    monkeypatch.setattr(index, "SMALL", 5)
    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    before, seen, segment = [spark.conf.get(k) for k in keys], [], S.SegmentedIndex._segment

    def watched(self, name, postings, docs, dead):
        seen.append([spark.conf.get(k) for k in keys])
        sizes = postings.sparkSession.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t")).mapInArrow(lambda batches: (b.select(["t"]).set_column(0, "t", [str(b.num_rows)] * b.num_rows) for b in batches), "t string")
        seen.append({int(r["t"]) for r in sizes.collect()})
        return segment(self, name, postings, docs, dead)

    monkeypatch.setattr(S.SegmentedIndex, "_segment", watched)
    docs = spark.createDataFrame([(i, f"a b w{i} w{i} a") for i in range(60)], "doc_id bigint, text string")
    found = S.SegmentedIndex(spark, str(tmp_path / "index"), 2)
    found.apply(docs)
    assert seen[0] == ["7", "40000"] and max(seen[1]) <= 7 and [spark.conf.get(k) for k in keys] == before
    queries = spark.createDataFrame([(1, "a w5"), (2, "b")], "query_id int, query string")
    assert scores(found.bm25(queries)) == pytest.approx(scores(R.bm25(queries, docs)))
