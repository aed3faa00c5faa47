"""Behaviour on literals: rules that the tables of other languages never reach, folds, streams and plans."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assembly, evaluation, graph, maintenance, retrieval, sections, understanding
from corpusloom.sources import readers
from corpusloom.streaming import windows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.collapse, "　a \t b　", "a b"), (T.page_noise, "第 12 页", True), (T.page_noise, "3 / 9", True), (T.page_noise, "第一章", False), (T.toc_line, "绪论........12", True), (T.toc_line, "目录", True),
        (T.corpus_noise, "12 - 34", True), (T.corpus_noise, "普通的一行文字", False), (T.table_like, "支撑关系 1 2", True), (T.code_like, "import java.util", True), (T.noise_line, "….…", True),
        (T.fragment, "1. abc", True), (T.without_prefix, "一、培养目标", "培养目标"), (T.mask_secrets, 'password="x1", a', 'password: ***", a'), (T.to_last_sentence, "一句。两句！半", "一句。两句！"), (T.to_last_sentence, "没有", "没有"),
        (T.slug, "A b/培养 C", "a-b-培养-c"), (T.concept_id, " A  b ", "ab"), (T.normal_path, "/api/123e4567-e89b/x", "/api/{id}/x"), (T.section_title, "见第三章内容", "第三章"), (T.page_reference, "p. 12", "p. 12"),
        (lambda c: T.tagged(c, "answer"), "<answer> a\nb </answer>", "a\nb"), (T.half_width, "（ａ）：“x”", "(ａ):x"), (T.heading_level, "第二章 总则", 1), (T.heading_level, "正文", None), (T.course_mentions, "CSE203《数据库》", ["CSE203", "数据库"]),
    ],
)
def test_text(spark, function, text, want):
    assert one(spark, text, function) == want


def test_tokens_and_keywords(spark):
    assert one(spark, "B a b A the b", T.tokens) == ["b", "a", "b", "a", "the", "b"]
    assert one(spark, "培养目标", lambda c: T.tokens(c, "cjk_bigram")) == ["培养", "养目", "目标"]
    assert one(spark, "xx yy xx zz yy qq", lambda c: T.top_keywords(c, 2)) == ["xx", "yy"]
    assert one(spark, "", T.first_keywords) == []


def test_truncation_and_cleaning(spark):
    assert one(spark, "aaaa. bbbb cccc", lambda c: T.truncate_at_boundary(c, 12, [".", " "])) == "aaaa. bbbb"
    assert one(spark, "行一\n行一\n123\n好的内容。。", T.deep_clean) == "行一\n好的内容。"
    assert one(spark, "课程名称: 数据结构 课程代码: CS101 任课教师: 某某某某某某某某", lambda c: T.labelled(c, ["课程名称", "课程代码"])) is True


def test_chunks_keep_every_sentence():
    parts = [f"Sentence number {i} ends here." for i in range(40)]
    chunks = sections.pack_sentences(parts, 120, 60, 30)
    assert all(any(p in c for c in chunks) for p in parts) and all(len(c) <= 220 for c in chunks) and chunks[0].startswith(parts[0])
    text = "".join(parts)
    kids = sections.split_children(text, 100, 20, 30)
    assert kids[0] == text[: len(kids[0])] and kids[-1] == text[-len(kids[-1]) :] and max(map(len, kids)) <= 130
    assert sections.pack_sentences([], 10, 5, 2) == sections.split_children("", 10, 2, 3) == []


def test_chunk_quality(spark):
    rows = [("d", 1, "这是一个内容完整且足够长的句子，用于检查质量。", "路径"), ("d", 2, "第一章 总则", "路径"), ("d", 3, "这是一个内容完整且足够长的句子，用于检查质量。", "路径"), ("d", 4, "这是一个没有结束标点并且足够长的句子内容如此", None), ("d", 5, None, None)]
    got = {r["ord"]: r for r in sections.assess(spark.createDataFrame(rows, "doc_id string, ord int, text string, section_path string")).collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["pass", "reject", "reject", "warn", "reject"]
    assert got[4]["flags"] == "incomplete_sentence,missing_section_path" and got[4]["score"] == 0.75


def test_analysis(spark):
    q = spark.createDataFrame([(1, "人工智能专业的培养目标是什么？"), (2, "Python课程有多少学分"), (3, "你好"), (4, "先修课程与后续课程的关系以及毕业设计")], "query_id int, query string")
    got = {r["query_id"]: r for r in understanding.analyse(q).collect()}
    assert got[1]["intents"] == ["training"] and got[1]["category"] == "program"
    assert got[2]["category"] == "technical" and got[2]["weights"]["keyword"] > 0.4
    assert got[3]["route"] == "simple" and got[3]["intents"] == ["general"] and got[4]["route"] == "complex"
    assert all(1 <= len(r["variants"]) <= 3 and abs(r["weights"]["vector"] + r["weights"]["keyword"] - 1) < 1e-9 for r in got.values())


def test_bm25_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "")], "doc_id bigint, text string")
    score = lambda q: {r["doc_id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame([(1, q)], "query_id int, query string"), docs).collect()}
    assert score("b b")[1] == pytest.approx(2 * score("b")[1]) and set(score("a")) == {1} and score("zz") == {}


def test_zero_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = retrieval.dense_knn(spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vector array<float>"), v, 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(2, 1.0), (3, 0.707107), (1, 0.0)]


def test_metrics_with_fewer_than_k(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    got = evaluation.ranking_metrics(ranked, spark.createDataFrame([(1, 11), (1, 12)], "query_id int, doc_id int"), 5).first()
    assert (got["precision"], got["recall"], got["mrr"]) == (0.5, 0.5, 0.5)


def test_graph_diamond(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (8, 9)], "src bigint, dst bigint")
    got = {(r["node"], r["depth"]) for r in graph.reach(e, spark.createDataFrame([(1,)], "seed bigint"), 5).collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {r["id"]: r["community"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    path = graph.shortest_paths(e, spark.createDataFrame([(1, 4)], "seed bigint, goal bigint"), 3).first()
    assert path["path"] == [1, 2, 4]


def test_cache(spark):
    rows = [("a", "r", "2024-01-01 00:00:00", 0), ("b", "r", "2024-01-01 00:00:00", 60), ("c", "r", "2024-01-01 00:00:00", 7200)]
    entries = spark.createDataFrame(rows, "key string, result string, ts string, ttl int").withColumn("ts", F.col("ts").cast("timestamp"))
    hit = maintenance.cache_hits(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), entries, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert {r["key"] for r in hit.collect()} == {"a", "c"}
    more = spark.createDataFrame([(k, n, f"2024-01-0{d} 00:00:00") for k, n, d in (("a", 1, 1), ("b", 1, 2), ("c", 5, 1), ("d", 1, 3))], "key string, hit_count int, ts string")
    assert {r["key"] for r in maintenance.evict(more, 2).collect()} == {"c", "d"}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["event_type"], r["start"], r["n"], r["total"])
    assert sorted(map(key, spark.table("tumbling").collect())) == sorted(map(key, windows.tumbling(events).collect()))
    state = windows.last_values(stream, 5).writeStream.outputMode("update").format("memory").queryName("last").trigger(availableNow=True).start()
    state.awaitTermination()
    assert {r["user_id"]: (r["n"], r["total"]) for r in spark.table("last").collect()} == {u: (5, float(sum(range(57 + u - 12, 60, 3)))) for u in range(3)}


def test_sources(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.json").write_text('{"metadata": {"version": "1"}, "chunks": [{"id": "1", "text": "' + "x" * 50 + '", "section": " "}, {"id": "2", "text": "short", "section": "s"}]}')
    got = readers.knowledge_base(spark, str(tmp_path / "kb")).collect()
    assert [(r["id"], r["section"], r["char_count"]) for r in got] == [("1", "unknown", 50)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("one\ntwo")
    assert readers.combined(spark, str(tmp_path / "t")).first()["text"] == "===== b.txt =====\none\ntwo"
    files = readers.discover(spark, str(tmp_path / "t"), "*.txt")
    lines = readers.page_lines(files, lambda raw: [raw.decode().split("\n")]).collect()
    assert [(r["page"], r["line_no"], r["line"]) for r in lines] == [(1, 0, "one"), (1, 1, "two")]


def test_point_lookup_is_pushed_to_the_scan(spark):
    from corpusloom.plans import REGISTRY

    plan = REGISTRY.queries["s13_point_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "text" not in plan.split("ReadSchema")[-1]


def test_index_follows_a_stream(spark, tmp_path):
    source = tmp_path / "docs"
    spark.createDataFrame([(1, "a" * 900), (2, "b"), (3, "c")], "doc_id bigint, text string").coalesce(1).write.parquet(str(source))
    run = lambda: windows.keep_index(spark.readStream.schema("doc_id bigint, text string").parquet(str(source)), str(tmp_path / "index"), sections.fixed_windows, str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([(2, "new"), (4, "d"), (3, "c"), (4, "dd")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(source))
    run()
    newest = sorted((tmp_path / "index").glob("v*"))[-1]
    got = spark.read.parquet(f"{newest}/chunks").orderBy("doc_id", "chunk_no").collect()
    assert [(r["doc_id"], r["chunk_no"], len(r["chunk"])) for r in got] == [(1, 0, 680), (1, 1, 340), (2, 0, 3), (3, 0, 1), (4, 0, 2)]
    assert [r["chunk"] for r in got][2:] == ["new", "c", "dd"]


def test_state_forgets_old_values(spark, tmp_path):
    rows = [(7, "2024-01-01 00:00:00", 1.0), (7, "2024-01-01 02:00:00", 4.0), (7, "2024-01-01 01:30:00", 2.0), (8, "2024-01-01 00:00:00", 5.0)]
    events = spark.createDataFrame(rows, "user_id bigint, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) as ts", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    windows.last_values(stream, 2, ttl_seconds=3600).writeStream.outputMode("update").format("memory").queryName("forgets").trigger(availableNow=True).start().awaitTermination()
    assert {r["user_id"]: (r["n"], r["total"]) for r in spark.table("forgets").collect()} == {7: (2, 6.0), 8: (1, 5.0)}


def test_index_is_built_anew_when_a_text_changes(spark, tmp_path):
    from corpusloom.operators import index

    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "")], "doc_id bigint, text string")
    one = index.indexed(docs)
    assert index.indexed(docs.orderBy("doc_id", ascending=False)).path == one.path
    q = spark.createDataFrame([(1, "red fox"), (2, "green")], "query_id int, query string")
    assert {(r["query_id"], r["doc_id"]) for r in one.bm25(q).collect()} == {(1, 1), (1, 2)}
    scores = {r["doc_id"]: r["score"] for r in one.tfidf(q).collect()}
    assert scores[1] > scores[2] and one.table("features").where("term = 'red fox'").count() == 1
    other = index.indexed(docs.where("doc_id <> 2").union(spark.createDataFrame([(2, "blue ox")], docs.schema)))
    assert other.path != one.path and {r["doc_id"] for r in other.bm25(q).collect()} == {1}


def test_knowledge_base_is_rebuilt(spark, tmp_path):
    from corpusloom.sources import readers

    docs = spark.createDataFrame([(1, "One sentence is here. " * 60), (2, "Another short text stands here alone."), (3, None)], "doc_id bigint, text string")
    report = readers.rebuild(docs, str(tmp_path / "kb"))
    row = report.first()
    assert row["documents"] == 2 and row["chunks"] == row["short"] + row["medium"] + row["long"] >= 3
    text = readers.markdown(report, "Chunks")
    assert text.startswith("# Chunks") and f"| 2 | {row['chunks']} |" in text
    meta = spark.read.json(str(tmp_path / "kb" / "metadata")).first()
    assert meta["total_chunks"] == row["chunks"] and "sentence" in meta["keywords"][:5]
    with pytest.raises(ValueError):
        readers.markdown(spark.range(20), "x", most=10)


def test_section_lines(spark):
    lines = ["第一章 总则", "本课程面向全体学生开设并且", "覆盖主要内容。", "本课程面向全体学生开设并且", "12", "支撑关系 1 2", "import java.util.List;", "第二节 要求", "学生应当完成", "", "全部实验"]
    want = ["第一章 总则 本课程面向全体学生开设并且 覆盖主要内容。", "第二节 要求 学生应当完成 全部实验"]
    frame = spark.createDataFrame([(lines,)], "l array<string>")
    assert frame.select(assembly.clean_section_lines(F.col("l"), outline=True)).first()[0] == want
    assert "import" in " ".join(frame.select(assembly.clean_section_lines(F.col("l"))).first()[0])


def test_a_line_is_cleaned_once(spark):
    rows = [(1, 0, 1, " 12Intro\u3000 text "), (1, 1, 1, "345"), (1, 2, 1, None), (1, 3, 2, "1234four digits"), (1, 4, 2, "7 apart"), (1, 5, 3, "  "), (1, 6, 3, "a | b")]
    kept = sections.chunk_lines(spark.createDataFrame(rows, "doc_id int, pos int, page int, line string"), "latin", [])
    assert sorted(map(tuple, kept.collect())) == [(1, 0, 12, "Intro text"), (1, 3, 2, "1234four digits"), (1, 4, 2, "7 apart")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2  # and not again for each test of a line
