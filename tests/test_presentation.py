"""What is shown of results against plain code, and the pipelines as one call."""

import re

from pyspark.sql import functions as F

from corpusloom.operators import presentation as P
from corpusloom.operators import retrieval as R
from corpusloom.plans import REGISTRY

SF = "/root/testdata/sf0.001"


def shown(parts, most, blocks, chars, each):
    """Finalised fragments put into blocks, one after the other."""
    done, now, n = [], "", 0
    for x in parts:
        if now and (len(now) + len(x) > chars or n >= each):
            done.append(now)
            now, n = x, 1
        else:
            now, n = now + x, n + 1
        if len(done) >= blocks:
            break
    if now and len(done) < blocks:
        done.append(now)
    return "\n\n".join(done)


def test_blocks_hold_what_fits(spark):
    rows = [
        (1, ["first sentence of some length", "second sentence of some length.", "third one of some length！", "fourth one of length, ", "fifth one of some length"]),
        (2, ["short", "only letters count 1 2", "毕业要求3 the rest is long enough", "| a | table's edge |", ""]), (3, []), (4, None), (5, ["x" * 300 + " yes this is long"]), (6, ["12. numbered sentence of it"] * 3),
    ]
    df = spark.createDataFrame(rows, "id int, parts array<string>")
    got = {r["id"]: r["t"] for r in df.select("id", P.display_blocks(F.col("parts"), 400, 2, 60, 2, "latin", []).alias("t")).collect()}
    own = {r["id"]: r["t"] for r in df.select("id", F.transform("parts", lambda x: P.finalised(x, "latin", [])).alias("t")).collect()}
    assert own[1] == ["first sentence of some length。", "second sentence of some length。", "third one of some length！", "fourth one of length。", "fifth one of some length。"]
    assert own[2][0] == "" and own[2][2] == "the rest is long enough。" and own[2][4] == "" and not own[6][0].startswith("12")
    for i in (1, 2, 3, 5, 6):
        assert got[i] == shown([x for x in own[i] if x], 400, 2, 60, 2)
    assert got[1] == "first sentence of some length。\n\nsecond sentence of some length。third one of some length！" or got[1].count("\n\n") == 1
    assert got[3] == "" and not got[4]
    cut = df.where("id = 1").select(P.display_blocks(F.col("parts"), 40, 2, 60, 2, "latin", [])).first()[0]
    assert len(cut) <= 41 and cut.endswith("。")
    assert df.where("id = 1").select(P.answer_markdown(F.col("parts"), "latin", [])).first()[0].split("\n")[2] == "- third one of some length！"


def test_excerpts_of_texts(spark):
    text = "Alpha comes first in this sentence. Beta comes second in this one. Gamma is the third of the sentences. Delta ends the list of them. Epsilon is one too many here."
    df = spark.createDataFrame([(1, text), (2, "a line without end\nshort\nanother line without an end"), (3, None), (4, "")], "id int, text string")
    row = {r["id"]: r for r in df.select("id", P.query_display(F.col("text"), F.array(F.lit("Gamma"), F.lit("x")), script="latin", hints=[]).alias("q"), P.display(F.col("text"), script="latin", hints=[]).alias("d"), P.source_excerpt(F.col("text"), script="latin", hints=[]).alias("s")).collect()}
    assert row[1]["q"] == "Gamma is the third of the sentences。"
    assert row[1]["d"] == "Alpha comes first in this sentence。Beta comes second in this one。\n\nGamma is the third of the sentences。Delta ends the list of them。"
    assert row[1]["s"] == "Alpha comes first in this sentence。Beta comes second in this one。\n\nGamma is the third of the sentences。"
    assert row[2]["d"].startswith("a line without end。another line") and row[2]["q"] == row[2]["d"] and not row[3]["d"] and row[4]["d"] == ""


def test_decision_trees(spark):
    rows = [(1, 1, "factual", "vector_search", 3, 0.5, "again"), (1, 2, "complex", "hybrid_search", 5, 0.75, None), (2, 1, "policy", "keyword_search", 0, 0.0, None)]
    got = {r["query_id"]: r for r in P.decision_trees(spark.createDataFrame(rows, "query_id int, iteration int, kind string, strategy string, results int, confidence double, refined string")).collect()}
    assert got[1]["tree"] == "\n".join([
        "决策树:", "┌─ 开始", "├─ 迭代1 [→]", "│   ├─ Think: factual", "│   ├─ Decide: vector_search", "│   ├─ Act: 3个结果", "│   └─ Observe: 置信度50.0%", "│      └─ 改进查询",
        "└─ 迭代2 [✓]", "    ├─ Think: complex", "    ├─ Decide: hybrid_search", "    ├─ Act: 5个结果", "    └─ Observe: 置信度75.0%", "└─ 结束"])
    assert got[1]["series"] == "█" * 10 + " 50.00%\n" + "█" * 15 + " 75.00%" and got[2]["series"] == " 0.00%"


def test_durations_of_short_runs(spark):
    steps = spark.createDataFrame([(1, i, f"s{i}") for i in range(4)] + [(2, 0, "s")], "run_id int, ord int, name string")
    totals = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 1.0)], "run_id int, seconds double")
    got = sorted(map(tuple, P.split_durations(steps, totals).collect()))
    assert got == [*((1, i, f"s{i}", 500.0) for i in range(4)), (2, 1, "默认推理", 500.0), (3, 1, "默认推理", 1000.0)]


DOCS = [(1, "alpha beta is here.", "a"), (2, "alpha gamma is there.", "a"), (3, "beta gamma delta stands alone here.", "b"), (4, "nothing of it at all", "c")]


def search(docs, k):
    return lambda asked: R.top_k(R.bm25(asked, docs), k)


def test_cross_pipeline_in_order(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, section string")
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "zzzz"), (3, "delta")], "query_id int, query string")
    found, summary = P.cross_pipeline(queries, search(docs, 5), docs, k=5, keep=3)
    ranked = {w: [r["doc_id"] for r in R.top_k(R.bm25(spark.createDataFrame([(1, w)], "query_id int, query string"), docs), 5).orderBy("rank").collect()] for w in ("alpha", "gamma", "delta")}
    want = list(dict.fromkeys(ranked["alpha"] + ranked["gamma"]))[:3]
    rows = found.orderBy("query_id", "place").collect()
    assert [r["doc_id"] for r in rows if r["query_id"] == 1] == want and [r["doc_id"] for r in rows if r["query_id"] == 3] == ranked["delta"]
    by = {r["query_id"]: r for r in summary.collect()}
    assert by[1]["searches"] == 2 and by[1]["found"] == 4 and by[1]["sections"].startswith("a（关键词 2，文档 2，several keywords）") and by[2]["found"] == 0 and by[2]["sections"] is None


def test_answers_as_one_call(spark):
    docs = spark.createDataFrame([(i, t + " More is said in this sentence of the text." * 2, s) for i, t, s in DOCS], "doc_id bigint, text string, section string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "zzzz"), (3, "gamma delta"), (4, "hello")], "query_id int, query string")
    model = spark.createDataFrame([(3, "said by a model"), (1, "  ")], "query_id int, response string")
    got = {r["query_id"]: r for r in P.answers(queries, search(docs, 30), docs, "agent", written_by=model).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3]["response"] == "said by a model" and got[3]["used_model"] and not got[1]["used_model"]
    assert got[1]["context_used"] and "- alpha beta is here." in got[1]["response"] and not got[2]["context_used"] and got[2]["sources"] == 0 and "zzzz" in got[2]["response"]
    assert "agent" in got[4]["response"]


def test_queries_over_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    blocks = REGISTRY.queries["t11_display_blocks"](spark, SF).collect()
    assert len(blocks) == n and all(len(r["shown"]) <= 321 and len(r["excerpt"]) <= 221 and r["shown"].count("\n\n") <= 1 for r in blocks) and sum(r["shown"] != "" for r in blocks) > n / 2
    assert all(re.fullmatch(r"(- [^\n]+[。！？]\n?)*", r["bullets"]) for r in blocks)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert REGISTRY.queries["x13_answers"](spark, SF).count() == REGISTRY.queries["r23_cross_pipeline"](spark, SF).count() == items


def test_cross_encoder_scores_in_batches(spark):
    """Any scorer of pairs, in batches of the size asked for, its order of rows kept."""

    def score(pairs):
        assert len(pairs) <= 3
        return [float(len(q) * 100 + len(t)) for q, t in pairs]

    rows = [(i, i * 10, "q" * (i % 4), "t" * i) for i in range(10)]
    df = spark.createDataFrame(rows, "query_id int, doc_id bigint, query string, text string")
    assert sorted(map(tuple, R.cross_encode(df, score, batch=3).collect())) == [(i, d, float(len(q) * 100 + len(t))) for i, d, q, t in rows]
    assert R.cross_encode(df.where("false"), score).collect() == []


def test_entities_and_fragments(spark):
    from corpusloom.functions import text as T
    from corpusloom.operators import assembly

    df = spark.createDataFrame([(1, "严重警告后还能评国家奖学金吗，补考呢"), (2, "hello"), (3, None)], "id int, q string")
    assert {r["id"]: list(r["e"]) for r in df.select("id", assembly.entities(F.col("q")).alias("e")).collect()} == {1: ["国家奖学金", "补考", "警告", "严重警告"], 2: [], 3: []}
    rows = spark.createDataFrame([("课程代码：C1001 课程名称：算法设计与分析 学分 3 授课对象：计算机专业二年级。后面是一个普通的句子没有标签。短。",), (None,)], "t string")
    got = [r["f"] for r in rows.select(T.fragments(F.col("t"), ["课程代码", "课程名称", "学分", "授课对象"], 6).alias("f")).collect()]
    assert got[0] == ["课程代码：C1001", "课程名称：算法设计与分析 学分 3", "授课对象：计算机专业二年级。", "后面是一个普通的句子没有标签。"] and not got[1]
