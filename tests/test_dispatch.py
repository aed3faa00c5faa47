"""Questions dispatched to traversals, on a graph small enough to answer by hand, and on tables."""

import hashlib

from corpusloom.operators import dispatch
from corpusloom.plans import graph_queries

NODES = [
    (1, "course", "算法", "C1", 1), (2, "course", "编译", "C2", 2), (3, "course", "系统", "C3", 3), (4, "course", "图形", "C4", 4), (10, "concept", "递归", "", None), (11, "concept", "栈", "", None),
    (20, "requirement", "工程知识", "", None), (21, "requirement", "沟通", "", None), (22, "requirement", "终身学习", None, None),
]
EDGES = [(1, 2, "prerequisite"), (2, 3, "prerequisite"), (1, 2, "leads_to"), (2, 3, "leads_to"), (1, 10, "teaches"), (2, 10, "teaches"), (3, 10, "teaches"), (3, 11, "teaches"), (1, 20, "supports"), (2, 20, "supports"), (3, 21, "supports"), (4, 99, "leads_to")]
QUERIES = [(1, "先修 编译", ["zz", "编译"]), (2, "覆盖度", ["x"]), (3, "概述", ["算法", "图形"]), (4, "what about", ["算法", "系统"]), (5, "nothing", ["qqqq"]), (6, "no words", []), (7, None, ["终身学习"])]


def digest(prefix, text):
    return prefix + hashlib.md5(text.encode()).hexdigest()[:8]


def test_answers_by_hand(spark):
    nodes = spark.createDataFrame(NODES, "id bigint, type string, name string, code string, semester int")
    edges = spark.createDataFrame(EDGES, "src bigint, dst bigint, type string")
    groups = spark.createDataFrame([(n[0], n[0] % 2) for n in NODES], "id bigint, community bigint")
    queries = spark.createDataFrame(QUERIES, "query_id int, query string, keywords array<string>")
    got = {}
    for r in dispatch.dispatched(queries, nodes, edges, groups).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(tuple(r)[1:])
    path = "[学习路径推荐]\n  → 算法(C1) 第1学期\n  ★ 编译(C2) 第2学期\n  → 系统(C3) 第3学期"
    around = "[图谱检索结果]\n涉及课程：算法、编译、系统\n核心知识点：递归、栈\n关联毕业要求：工程知识、沟通"
    assert got[1] == [("path", 1, digest("graph_lpath_", path), "学习路径推荐", path, 0.90), ("path", 2, digest("graph_subgraph_", around), "知识图谱检索", around, 0.85)]
    overview = "[培养方案一致性分析]\n课程总数：4  知识点总数：2  毕业要求：3\n发现断层：2 处  知识冗余：1 处"
    gaps = [f"毕业要求 [{n}] 仅有 {c} 门课程支撑，建议增加支撑课程" for n, c in (("沟通", 1), ("终身学习", 0))]
    over = "知识点 [递归] 在 3 门课程中重复出现，建议差异化教学"
    assert [(x[2], x[4], x[5]) for x in got[2]] == [("graph_alignment_overview", overview, 0.92), *((digest("graph_gap_", g), g, 0.88) for g in gaps), (digest("graph_overlap_", over), over, 0.85)]
    assert [(x[2], x[5]) for x in got[3]] == [("graph_community_0", 0.8), ("graph_community_1", 0.8)]
    line = "算法 → 编译 → 系统"
    assert got[4] == [
        ("subgraph", 1, digest("graph_subgraph_", around + f"\n推理路径：\n  {line}"), "知识图谱检索", around + f"\n推理路径：\n  {line}", 0.85),
        ("subgraph", 2, digest("graph_path_", f"[知识推理路径] 算法 → 系统\n路径：{line}"), "图谱推理路径", f"[知识推理路径] 算法 → 系统\n路径：{line}", 0.80),
    ]
    alone = "[图谱检索结果]\n关联毕业要求：终身学习"
    assert got[7] == [("subgraph", 1, digest("graph_subgraph_", alone), "知识图谱检索", alone, 0.85)] and set(got) == {1, 2, 3, 4, 7}
    assert dispatch.dispatched(queries.where("false"), nodes, edges, groups).collect() == []


def test_answers_of_tables(spark):
    rows = graph_queries.g13_all(spark, "/root/testdata/sf0.001").collect()
    assert {r["strategy"] for r in rows} == {"path", "alignment", "community", "subgraph"} and max(r["place"] for r in rows) <= 5
    assert len({(r["query_id"], r["place"]) for r in rows}) == len(rows)
