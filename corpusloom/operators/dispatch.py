"""Questions to a graph, each answered by the traversal that its words ask for.

Queries are routed first. Every traversal then runs once, over the queries that chose it, and the answers are united. A strategy that
no query chose is not run at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.session import written

#: Scores of what the traversals find, sections and texts.
SUBGRAPH, REASONING, PATH, OVERVIEW, GAP, OVERLAP = 0.85, 0.80, 0.90, 0.92, 0.88, 0.85
SECTIONS = {"subgraph": "知识图谱检索", "reasoning": "图谱推理路径", "path": "学习路径推荐", "overview": "一致性分析总览", "gap": "知识断层检测", "overlap": "知识冗余检测", "community": "知识社区"}
#: Seeds of a query, hops and nodes of its subgraph, seeds that a seed is paired with, edges of a path between them, and rows of a kind.
SEEDS, HOPS, NODES, NEXT, STEPS, HEAD = 10, 2, 25, 3, 4, 3
#: Edges of a chain of courses.
CHAIN = 12


def strategy(query: Column) -> Column:
    """The first strategy of which the query holds a word, else the subgraph."""
    name = F.lit("subgraph")
    for own, words, _ in reversed(G.STRATEGIES):
        name = F.when(reduce(lambda a, w: a | F.contains(query, F.lit(w)), words, F.lit(False)), own).otherwise(name)
    return name


def _named(kind: str, prefix: str, score: float | Column, text: Column) -> list[Column]:
    key = F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 8))
    return [key.alias("id"), F.lit(SECTIONS[kind]).alias("section"), text.alias("text"), F.lit(score).alias("score") if isinstance(score, float) else score.alias("score")]


def seeds(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, nth): the first SEEDS nodes by id whose name or code holds a keyword of two characters or more, or whose name is in one."""
    name, code = F.coalesce("name", F.lit("")), F.coalesce("code", F.lit(""))
    fits = F.exists("keywords", lambda w: (F.length(w) >= 2) & (F.contains(name, w) | F.contains(code, w) | F.contains(w, name)))
    hit = nodes.select("id", "name", "code").crossJoin(queries.select("query_id", "keywords")).where(fits).select("query_id", "id")
    return hit.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("nth") <= SEEDS)


def subgraphs(start: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each query the summary of what lies around its seeds, then up to three paths between seeds: (query_id, order, id, section, text, score)."""
    seen = written(start.select("query_id", F.col("id").alias("node"), F.lit(0).alias("depth")), "seen")
    both, front = G.undirected(edges), seen
    for depth in range(1, HOPS + 1):
        step = front.join(both, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "node"))
    held = written(seen.join(nodes.select(F.col("id").alias("node"), "name", "type"), "node").withColumn("place", place).where(F.col("place") <= NODES), "subgraph")
    pairs = start.select("query_id", F.col("id").alias("seed"), F.col("nth").alias("i")).join(start.select("query_id", F.col("id").alias("goal"), F.col("nth").alias("j")), "query_id").where((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + NEXT))
    pairs = written(pairs, "pairs")
    found = G.shortest_paths(edges, pairs.select("seed", "goal").distinct(), STEPS).join(pairs, ["seed", "goal"])
    steps = found.select("query_id", "i", "j", F.size("path").alias("n"), F.posexplode("path").alias("at", "node")).join(held.select("query_id", "node", "name"), ["query_id", "node"])
    names = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    whole = steps.groupBy("query_id", "i", "j", "n").agg(names.alias("names")).where(F.size("names") == F.col("n"))  # all of it in the subgraph
    paths = written(whole.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("i", "j"))).where(F.col("nth") <= HEAD).select("query_id", "nth", "names", F.array_join("names", " → ").alias("line")), "paths")
    lines = paths.groupBy("query_id").agg(F.concat(F.lit("推理路径：\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: F.concat(F.lit("  "), x["line"])), "\n")).alias("lines"))
    summary = G.summarise(held.select("query_id", F.col("node").alias("id"), "name", "type"), "query_id").join(lines, "query_id", "left")
    text = F.concat_ws("\n", "summary", "lines")
    first = summary.select("query_id", F.lit(1).alias("order"), *_named("subgraph", "graph_subgraph_", SUBGRAPH, text))
    said = F.concat(F.lit("[知识推理路径] "), F.element_at("names", 1), F.lit(" → "), F.element_at("names", -1), F.lit("\n路径："), F.col("line"))
    return first.unionByName(paths.select("query_id", (F.col("nth") + 1).alias("order"), *_named("reasoning", "graph_path_", REASONING, said)))


def course_paths(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of the first keyword that names a course, what comes before the course and after it: (query_id, order, id, section, text, score)."""
    courses = nodes.where("type = 'course'")
    name, code = F.coalesce("name", F.lit("")), F.coalesce("code", F.lit(""))
    words = queries.select("query_id", F.posexplode("keywords").alias("at", "word"))
    hit = courses.select("id", "name", "code").crossJoin(words).where(F.contains(name, F.col("word")) | F.contains(code, F.col("word")) | F.contains(F.col("word"), name))
    target = written(hit.groupBy("query_id").agg(F.min(F.struct("at", "id")).alias("m")).select("query_id", F.col("m.id").alias("target")), "targets")
    between = lambda kind: edges.where(F.col("type") == kind).join(courses.select(F.col("id").alias("src")), "src", "left_semi").join(courses.select(F.col("id").alias("dst")), "dst", "left_semi")
    back = between("prerequisite").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ask = target.select(F.col("target").alias("seed")).distinct()
    before = G.reach(back, ask, CHAIN).where("depth > 0").withColumn("depth", -F.col("depth"))
    chain = before.unionByName(G.reach(between("leads_to").select("src", "dst"), ask, CHAIN))
    rows = chain.join(nodes.select(F.col("id").alias("node"), "name", "code", "semester"), "node")
    mark = F.when(F.col("depth") == 0, "★").otherwise("→")
    line = F.concat(F.lit("  "), mark, F.lit(" "), "name", F.lit("("), F.coalesce("code", F.lit("")), F.lit(") 第"), F.coalesce(F.col("semester").cast("string"), F.lit("")), F.lit("学期"))
    text = rows.groupBy("seed").agg(F.concat(F.lit("[学习路径推荐]\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))
    return target.join(text, F.col("target") == F.col("seed")).select("query_id", F.lit(0).alias("order"), *_named("path", "graph_lpath_", PATH, F.col("text")))


def alignment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The overview of gaps and overlaps, and the first three of each by node: (order, id, section, text, score); at most seven rows."""
    courses = nodes.where("type = 'course'").select(F.col("id").alias("src"))
    to = lambda kind: nodes.where(F.col("type") == kind).select("id", "name").join(edges.join(courses, "src", "left_semi").select("src", F.col("dst").alias("id")).distinct(), "id", "left").groupBy("id", "name").agg(F.count("src").alias("n"))
    gaps, overlaps = written(to("requirement").where("n < 2"), "gaps"), written(to("concept").where("n >= 3"), "overlaps")
    kinds = nodes.agg(*(F.count_if(F.col("type") == t).alias(t) for t in ("course", "concept", "requirement"))).crossJoin(gaps.agg(F.count("*").alias("gaps"))).crossJoin(overlaps.agg(F.count("*").alias("overlaps")))
    text = F.format_string("[培养方案一致性分析]\n课程总数：%d  知识点总数：%d  毕业要求：%d\n发现断层：%d 处  知识冗余：%d 处", "course", "concept", "requirement", "gaps", "overlaps")
    out = kinds.select(F.lit(1).alias("order"), F.lit("graph_alignment_overview").alias("id"), F.lit(SECTIONS["overview"]).alias("section"), text.alias("text"), F.lit(OVERVIEW).alias("score"))
    # the head of each is a limited sort
    gap = F.format_string("毕业要求 [%s] 仅有 %d 门课程支撑，建议增加支撑课程", F.coalesce("name", F.lit("")), "n")
    over = F.format_string("知识点 [%s] 在 %d 门课程中重复出现，建议差异化教学", F.coalesce("name", F.lit("")), "n")
    for base, rows, said, kind, prefix, score in ((2, gaps, gap, "gap", "graph_gap_", GAP), (2 + HEAD, overlaps, over, "overlap", "graph_overlap_", OVERLAP)):
        head = rows.orderBy("id").limit(HEAD).withColumnRenamed("id", "node")
        nth = F.row_number().over(Window.orderBy("node"))  # three rows
        out = out.unionByName(head.select((nth + base - 1).alias("order"), *_named(kind, prefix, score, said)))
    return out


def dispatched(queries: DataFrame, nodes: DataFrame, edges: DataFrame, communities: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, strategy, place, id, section, text, score): up to ``k`` answers of each query (query_id, query, keywords).

    ``nodes`` has (id, type, name, code, semester), ``edges`` (src, dst, type), ``communities`` (id, community). A path is followed by
    its query's subgraph. Queries without keywords, and those that nothing answers, have no row. Nodes count in the order of
    their ids. The queries are a set of questions, which meets the nodes' names pair by pair; the graph itself is only joined.
    """
    asked = queries.where(F.size("keywords") > 0).select("query_id", "query", "keywords")
    asked = written(asked.withColumn("strategy", strategy(F.coalesce("query", F.lit("")))), "routes")
    chosen = {r[0] for r in asked.select("strategy").distinct().collect()}  # four names at most
    of = lambda *names: asked.where(F.col("strategy").isin(*names)).select("query_id", "query", "keywords")
    parts = []
    if chosen & {"subgraph", "path"}:
        parts.append(subgraphs(written(seeds(of("subgraph", "path"), nodes), "seeds"), nodes, edges))
    if "path" in chosen:
        parts.append(course_paths(of("path"), nodes, edges))
    if "alignment" in chosen:
        parts.append(of("alignment").select("query_id").crossJoin(F.broadcast(alignment(nodes, edges))))  # seven rows
    if "community" in chosen:
        summaries = G.community_summaries(nodes, communities)
        hit = G.search_communities(of("community").select("query_id", "keywords"), summaries, k).join(summaries.select("community", F.col("summary").alias("text")), "community")
        parts.append(hit.select("query_id", F.col("rank").alias("order"), F.concat(F.lit("graph_community_"), F.col("community").cast("string")).alias("id"), F.lit(SECTIONS["community"]).alias("section"), "text", "score"))
    if not parts:
        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, strategy string, place int, id string, section string, text string, score double")
    every = reduce(DataFrame.unionByName, parts).join(asked.select("query_id", "strategy"), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("order", "id"))  # a few rows a query
    return every.withColumn("place", place).where(F.col("place") <= k).select("query_id", "strategy", "place", "id", "section", "text", "score")
