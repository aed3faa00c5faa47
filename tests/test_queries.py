"""Every registered query with SQL against DuckDB on the smallest tables, and units on literals."""

import os

import pandas as pd
import pytest

from corpusloom.plans import REGISTRY
from corpusloom.session import TABLES

#: Queries whose answer on the smallest tables is empty: nothing is wrong there.
EMPTY: set[str] = set()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(value):
    if pd.isna(value):
        return ""
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.6g}"
    if isinstance(value, bool):
        return str(int(value))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(shown(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_and_sql_agree(spark, duck, name):
    got = rows(REGISTRY.queries[name](spark, SF).toPandas())
    assert got[1] or name in EMPTY
    assert got == rows(duck.sql(REGISTRY.oracles[name]).df())


def other_fold(parts, size, least, overlap):
    """The chunks of sentences, written anew: each by where it starts and ends."""
    out, start = [], 0
    upto = [0]
    for p in parts:
        upto.append(upto[-1] + len(p))
    while start < len(parts):
        end = next((e for e in range(start + 1, len(parts)) if upto[e + 1] - upto[start] > size and upto[e] - upto[start] >= least), len(parts))
        if upto[-1] - upto[end] < least:
            end = len(parts)
        out.append("".join(parts[start:end]).strip())
        if end == len(parts) or not out[-1]:
            break
        start = max(start + 1, max((k for k in range(start, end + 1) if upto[end] - upto[k] >= overlap), default=start))
    return [x for x in out if x]


def test_sentence_chunks_are_those_of_another_fold(spark, duck):
    import random
    import re

    from corpusloom.operators.paging import pack

    # by hand: two sentences a chunk, the second of them again at the head of the next
    assert pack(["aaaa.", "bbbb.", "cccc.", "dddd."], 10, 4, 3) == ["aaaa.bbbb.", "bbbb.cccc.", "cccc.dddd."]
    assert pack(["aaaa.", "bbbb.", "cc."], 10, 4, 3) == ["aaaa.bbbb.cc."] and pack([], 10, 4, 3) == []
    draw = random.Random(6)
    for _ in range(300):
        parts = ["x" * draw.randint(1, 40) for _ in range(draw.randint(0, 30))]
        rule = draw.randint(10, 90), draw.randint(1, 40), draw.randint(0, 40)
        assert pack(parts, *rule) == other_fold(parts, *rule)
    want = []
    for doc, text in duck.sql("select doc_id, text from documents").fetchall():
        found = [x.strip(" ") for x in re.findall(r"[^。！？；.!?;\n]+[。！？；.!?;]?", text or "")]
        want += [(doc, i, c) for i, c in enumerate(other_fold([x for x in found if x], 680, 180, 120))]
    got = REGISTRY.queries["k07_k09_sentence_chunks"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 200


def test_page_chunks(spark):
    from corpusloom.operators.paging import chunk_pages

    rows = [
        (1, 0, 1, "opening words that say little. "), (1, 1, 1, "HEAD One"), (1, 2, 1, "first sentence of it is here. second sentence of it is here."), (1, 3, 2, "third sentence of it is here. fourth sentence of it is here."),
        (1, 4, 2, "HEAD two"), (1, 5, 2, "tiny."), (1, 6, 3, "HEAD One"), (1, 7, 3, "another text under the same name."), (2, 0, 1, ""), (2, 1, 1, "12"), (3, 0, 7, None), (4, 0, 4, "only one sentence stands in this one."),
    ]
    lines = spark.createDataFrame(rows, "doc_id bigint, pos int, page int, line string")
    from pyspark.sql import functions as F

    heads = F.when(F.col("line").startswith("HEAD One"), 1).when(F.col("line").startswith("HEAD"), 2)
    titles = spark.createDataFrame([(1, "Doc")], "doc_id bigint, title string")
    got = chunk_pages(lines, titles, 60, 20, 25, "latin", heads, []).orderBy("doc_id", "chunk_no").collect()
    assert [(r["doc_id"], r["chunk_no"], r["path"], r["page_from"], r["page_to"], r["text"]) for r in got] == [
        (1, 0, "文档概览", 1, 1, "opening words that say little."),
        (1, 1, "HEAD One", 1, 2, "first sentence of it is here.second sentence of it is here."),
        (1, 2, "HEAD One", 1, 2, "second sentence of it is here.third sentence of it is here."),
        (1, 3, "HEAD One", 1, 2, "third sentence of it is here.fourth sentence of it is here."),
        (1, 4, "HEAD One", 3, 3, "another text under the same name."),
        (4, 0, "文档概览", 4, 4, "only one sentence stands in this one."),
    ]
    assert got[1]["prefix"].startswith("Doc；") and got[1]["prefix"].endswith("HEAD One；页 1-2") and got[5]["prefix"].endswith("文档概览；页 4")
    assert chunk_pages(lines.where("false"), titles, heading=heads).collect() == []


def test_joined_sources(spark):
    from corpusloom.operators.retrieval import join_sections

    long = "word " * 20
    rows = [(1, 1, 0.9, long, "a"), (1, 2, 0.8, long + "end.", "a"), (1, 3, 0.7, "short end.", "b"), (1, 4, 0.6, "other " * 20 + "end.", "b"), (1, 5, 0.1, long + "low.", "b"), (1, 6, 0.5, None, "b"), (2, 7, 0.9, long + "x.", None), (2, 8, 0.8, long + "x.", None)]
    got = join_sections(spark.createDataFrame(rows, "query_id int, doc_id bigint, score double, text string, section string")).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["place"], r["doc_id"], r["section"]) for r in got] == [(1, 1, 1, "a"), (1, 2, 4, "b"), (2, 1, 7, "")]
    assert got[0]["text"] == long + long + "end." and got[1]["text"] == "other " * 20 + "end." and got[2]["score"] == 0.9


def test_every_query_is_tested():
    # these are held against plain code: here, in test_graph_and_agent.py, test_exact_joins.py, test_dispatch.py and test_presentation.py
    assert set(REGISTRY.queries) - set(REGISTRY.oracles) == {"k07_k09_sentence_chunks", "r30_joined_sources", "g10_louvain", "r28_agent_loop", "q13_corpus_variants", "g13_dispatched", "k09_page_chunks", "t11_display_blocks", "a15_decision_trees", "r23_cross_pipeline", "x13_answers"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
