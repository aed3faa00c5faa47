"""Property graphs as two tables: nodes (id, type, ...) and edges (src, dst, type, ...). Traversals are bounded loops of
joins, each step written to shared storage so that lineage stays short and a lost executor loses nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import counted, forget, shared_dir, shuffled, written

#: Members of a category in one block, about; a cell has as many pairs as its square.
BLOCK = 512


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the folder that the cluster names for checkpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, depth): what can be reached along ``edges`` (src, dst) in at most ``hops`` steps, first arrival."""
    seen = cut(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes kept by id and the edges between them, by two semi joins."""
    ids = keep.select(F.col("node").alias("id")).distinct()
    inside = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """(seed, goal, depth, path) of the first arrival, of equally short ones the smallest path."""
    front = pairs.select("seed", "goal", F.col("seed").alias("node"), F.array(F.col("seed")).alias("path"))
    found = None
    for depth in range(1, hops + 1):
        step = front.join(edges.select("src", "dst"), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("seed", "goal", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.groupBy("seed", "goal", "node").agg(F.min("path").alias("path")))
        done = front.where("node = goal").select("seed", "goal", F.lit(depth).alias("depth"), "path")
        found = done if found is None else found.unionByName(done)
        front = front.join(done.select("seed", "goal"), ["seed", "goal"], "left_anti")
    return found


def co_occurrence(items: DataFrame, band: int = 7) -> DataFrame:
    """(group, pos, item): pairs of a group's items at most ``band`` places apart, counted over groups."""
    a, b = items.alias("a"), items.alias("b")
    # a band join: an item meets the places after it, spread over the band
    near = a.select(F.col("a.group").alias("group"), F.col("a.item").alias("x"), F.explode(F.sequence(F.col("a.pos") + 1, F.col("a.pos") + band)).alias("pos"))
    j = near.join(b.select(F.col("b.group").alias("group"), F.col("b.pos").alias("pos"), F.col("b.item").alias("y")), ["group", "pos"]).where("x <> y")
    return j.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("n"))


def same_category(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The pairs (by id) of a category that no edge links yet, with weight .3.

    All pairs of a category are its answer, so it grows with the square of the category. A category is cut into blocks of about BLOCK
    members and two blocks make a cell: cells are dealt over all tasks and a pair arises in its task, so no pair is shuffled. Edges go
    to the cells of their ends and are left out there. ``category_members`` says the same in a row for each member.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.select(F.col(key).alias("k"), "id").where("k is not null and id is not null")
    n = n.join(n.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "k").withColumn("b", F.pmod(F.xxhash64("id"), "blocks"))
    blocks = n.groupBy("k", "blocks", "b").agg(F.collect_list("id").alias("ids"))
    left = blocks.select("k", F.col("b").alias("i"), F.col("ids").alias("xs"), F.explode(F.sequence(F.col("b"), F.col("blocks") - 1)).alias("j"))
    cells = left.join(blocks.select("k", F.col("b").alias("j"), F.col("ids").alias("ys")), ["k", "j"])
    # an edge within a category: its end in the cell's first block, or its smaller end, and the other
    links, ends = undirected(edges).where("src < dst"), n.select("k", "id", "b").distinct()
    links = links.join(ends.select("k", F.col("id").alias("src"), F.col("b").alias("sb")), "src").join(ends.select("k", F.col("id").alias("dst"), F.col("b").alias("db")), ["k", "dst"])
    first = F.col("sb") <= F.col("db")
    links = links.select("k", F.least("sb", "db").alias("i"), F.greatest("sb", "db").alias("j"), F.struct(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("y")).alias("link"))
    linked = links.groupBy("k", "i", "j").agg(F.collect_list("link").alias("linked"))
    # by a hash, as Spark leaves out a shuffle by the columns of the join before it
    cells = cells.join(linked, ["k", "i", "j"], "left").repartition(tasks, F.xxhash64("k", "i", "j"))
    own = F.coalesce(F.transform(F.filter("linked", lambda e: e["x"] == F.col("x")), lambda e: e["y"]), F.array())
    met = cells.withColumn("x", F.explode("xs")).select("i", "j", "x", "ys", own.alias("own"))
    # within a block each pair once; "own" is nearly always empty
    met = met.select("x", F.when(F.col("i") == F.col("j"), F.filter("ys", lambda y: y > F.col("x"))).otherwise(F.col("ys")).alias("ys"), "own")
    met = met.select("x", F.when(F.size("own") == 0, F.col("ys")).otherwise(F.filter("ys", lambda y: ~F.array_contains("own", y))).alias("ys"))
    return met.select("x", F.explode("ys").alias("y")).select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), F.lit(0.3).alias("weight"))


def category_members(nodes: DataFrame, key: str) -> DataFrame:
    """(key, id, links): each member of a category of several with the number of others it is linked to."""
    n = nodes.groupBy(key).agg((F.count("*") - 1).alias("links")).where("links > 0")
    return nodes.join(n, key).select(key, "id", "links")


def overlaps(teaches: DataFrame, least: int = 3) -> DataFrame:
    """Concepts that ``least`` courses or more teach, with the courses' names in order."""
    g = teaches.distinct().groupBy("concept").agg(F.count("*").alias("courses"), F.array_join(F.sort_array(F.collect_list("course")), ",").alias("names"))
    return g.where(F.col("courses") >= least)


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, most: int) -> DataFrame:
    """(seed, node, depth): what lies within ``hops`` steps of undirected edges, the first ``most`` by depth and id."""
    w = Window.partitionBy("seed").orderBy("depth", "node")
    return reach(undirected(edges), seeds, hops).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def learning_path(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): for targets that have something before them their prerequisites at negative depths, for
    others what follows, each node once."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    before = targets.join(back.select(F.col("src").alias("seed")).distinct(), "seed", "left_semi")
    up = reach(back, before, depth).withColumn("depth", -F.col("depth"))
    return up.unionByName(reach(edges, targets.join(before, "seed", "left_anti"), depth))


def cards(nodes: DataFrame, edges: DataFrame, label: str, most: int = 4) -> DataFrame:
    """(id, card): a line for each node with the names of the first ``most`` nodes that its edges lead to."""
    w = Window.partitionBy("src").orderBy("dst")
    head = edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst")
    lists = head.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", "to"))), lambda x: x["to"]), "、").alias("names"))
    return lists.join(nodes, "id").select("id", F.concat(F.lit("["), "name", F.lit(f"] {label}："), "names").alias("card"))


#: What a subgraph's summary shows of each type, and how many.
SUMMARY = [("course", "涉及课程：", 6), ("concept", "核心知识点：", 10), ("requirement", "关联毕业要求：", 5)]


def summarise(nodes: DataFrame, key: str) -> DataFrame:
    """(key, summary): the first names of each type in a subgraph, one line for each type that it has. ``nodes`` has
    (key, id, name, type)."""
    w = Window.partitionBy(key, "type").orderBy("id")
    r = nodes.withColumn("rn", F.row_number().over(w))
    lines = []
    for kind, title, most in SUMMARY:
        names = F.transform(F.sort_array(F.collect_list(F.when((F.col("type") == kind) & (F.col("rn") <= most), F.struct("id", "name")))), lambda x: x["name"])
        lines.append(F.when(F.size(names) > 0, F.concat(F.lit(title), F.array_join(names, "、"))))
    return r.where("rn <= 10").groupBy(key).agg(F.concat_ws("\n", F.lit("[图谱检索结果]"), *lines).alias("summary"))


def components(edges: DataFrame) -> DataFrame:
    """(id, community): connected components by the smallest id.

    Each node takes the first of itself and its neighbours in an order drawn by a hash, and those that have taken the same become one node
    of the next round, so a good part of the nodes goes in every round, however long the paths are.
    """
    left, found, turn = written(undirected(edges)), None, 0
    while True:
        place = lambda end: F.struct(F.xxhash64(end, F.lit(turn)).alias("place"), F.col(end).alias("id"))  # noqa: B023, E731
        to = written(left.groupBy("src").agg(F.least(place("src"), F.min(place("dst"))).alias("to")).select(F.col("src").alias("id"), F.col("to.id").alias("to")))
        older, found = found, to if found is None else written(found.join(shuffled(to.select(F.col("id").alias("to"), F.col("to").alias("next"))), "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        a, b = (shuffled(to.withColumnsRenamed({"id": end, "to": f"{end}_to"})) for end in ("src", "dst"))
        rest, n = counted(left.join(a, "src").join(b, "dst").where("src_to <> dst_to").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct(), F.count("*"))
        forget(left, older, None if found is to else to)
        left, turn = rest, turn + 1
        if not n:
            names = found.groupBy("to").agg(F.min("id").alias("community"))
            named = written(found.join(shuffled(names), "to").select("id", "community"))
            forget(left, found)
            return named


def degrees(edges: DataFrame) -> DataFrame:
    """V1: (id, degree), undirected."""
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def last_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """V2: of edges with the same ends and type the last."""
    w = Window.partitionBy("src", "dst", "type").orderBy(F.desc(order))
    return edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merge_nodes(base: DataFrame, over: DataFrame, columns: list[str]) -> DataFrame:
    """V2: nodes of both; where both have one, the second's values win."""
    o = over.select("id", *(F.col(c).alias(f"{c}__o") for c in columns))
    return base.join(o, "id", "full").select("id", *(F.coalesce(f"{c}__o", c).alias(c) for c in columns))


def coverage_gaps(required: DataFrame, support: DataFrame, least: int = 2) -> DataFrame:
    """Requirements with fewer than ``least`` distinct supporters, with a severity."""
    n = required.join(support, "requirement", "left").groupBy("requirement").agg(F.countDistinct("supporter").alias("supporters"))
    severity = F.when(F.col("supporters") == 0, "high").otherwise("medium")
    return n.where(F.col("supporters") < least).withColumn("severity", severity)


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that no node has."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def find_nodes(queries: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id): nodes whose name holds the query's term or is held by it, the first ``limit`` in node order.
    Terms and names shorter than two characters match nothing. The terms asked are a bounded set."""
    q = queries.where(F.length("term") >= 2)
    hit = nodes.where(F.length("name") >= 2).crossJoin(q).where(F.contains(F.lower("name"), F.lower("term")) | F.contains(F.lower("term"), F.lower("name")))
    w = Window.partitionBy("query_id").orderBy("id")
    return hit.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("query_id", "id", "rn")


def chain(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """The first prerequisite, its first, and so on."""
    first = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    out = start.select("id", F.col("id").alias("p0"))
    for i in range(depth):
        out = out.join(first.select(F.col("src").alias(f"p{i}"), F.col("dst").alias(f"p{i + 1}")), f"p{i}", "left")
    return out.select("id", F.array_join(F.array(*(F.col(f"p{i}").cast("string") for i in range(1, depth + 1))), ">").alias("chain"))


def strategy(query: Column) -> Column:
    """Which traversal answers a question."""
    return F.when(query.rlike("先修|后续|路径|顺序|path|before"), "path").when(query.rlike("一致|覆盖|重叠|gap|overlap"), "alignment").when(query.rlike("社区|体系|结构|community"), "community").otherwise("subgraph")


def ego(edges: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """V3: (center, kind, place, node): of each course the first ``most`` that lead to it (prerequisite), follow it (next) and,
    of its category, stand nearest in name without such an edge (related). ``nodes`` has (id, name, category)."""
    before = edges.select(F.col("dst").alias("center"), F.lit("prerequisite").alias("kind"), F.col("src").alias("node"))
    both = before.unionByName(edges.select(F.col("src").alias("center"), F.lit("next").alias("kind"), F.col("dst").alias("node"))).distinct()
    w = Window.partitionBy("center", "kind").orderBy("name", "node")
    named = lambda rows: rows.join(nodes.select(F.col("id").alias("node"), "name"), "node").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    # a course's neighbours by name in its category, enough of them to leave ``most`` beside those with an edge
    spot = nodes.withColumn("at", F.row_number().over(Window.partitionBy("category").orderBy("name", "id")))
    a = spot.select(F.col("id").alias("center"), "category", "at").withColumn("at", F.explode(F.sequence(F.col("at") - most, F.col("at") + most)))
    near = a.join(spot.select("category", "at", F.col("id").alias("node")), ["category", "at"]).where("center <> node").select("center", F.lit("related").alias("kind"), "node")
    related = near.join(both.select("center", "node"), ["center", "node"], "left_anti").select("center", "kind", "node")
    return named(both.unionByName(related)).select("center", "kind", "place", "node")


#: Words that ask for a traversal, in the order in which they are tried, and the score of what it finds.
STRATEGIES = [
    ("path", ["学习路径", "先修", "后续", "课程链", "先导", "前置", "衔接", "课程顺序", "学完之后", "之前学"], 0.85),
    ("alignment", ["一致性", "覆盖度", "断层", "冗余", "对齐", "支撑", "培养目标", "毕业要求"], 0.80),
    ("community", ["概述", "总体", "全景", "整体", "所有课程", "专业特色", "专业介绍"], 0.70),
]


def routed(queries: DataFrame, scores: Column | None = None) -> DataFrame:
    """(query_id, strategy, score, id): the traversal for each query (query_id, query, hits), the score of its result
    and the result's id; a community's score grows by .1 a hit up to .95, a subgraph's is .75."""
    name, score = F.lit("subgraph"), F.lit(0.75)
    for strategy_, words, fixed in reversed(STRATEGIES):
        asked = F.lit(False)
        for w in words:
            asked = asked | F.contains(F.col("query"), F.lit(w))
        value = F.least(F.lit(0.95), fixed + 0.1 * F.col("hits")) if strategy_ == "community" else F.lit(fixed)
        name, score = F.when(asked, strategy_).otherwise(name), F.when(asked, value).otherwise(score)
    return queries.select("query_id", name.alias("strategy"), F.round(score, 6).alias("score"), F.substring(F.md5(F.concat_ws("|", name, "query")), 1, 8).alias("id"))


def community_summaries(nodes: DataFrame, communities: DataFrame, most: int = 10) -> DataFrame:
    """(community, size, summary): the names of the first ``most`` members of each community by id. ``communities`` has (id,
    community), as ``components`` and ``louvain`` give them or any other partition. Sizes are counted apart, so only the first rows of a
    community are ordered."""
    w = Window.partitionBy("community").orderBy("id")
    named = communities.join(nodes.select("id", "name"), "id")
    head = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    first = head.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), "、").alias("summary"))
    return named.groupBy("community").agg(F.count("*").alias("size")).join(first, "community")


def search_communities(queries: DataFrame, summaries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, community, score, rank): communities whose summary holds keywords of a query (query_id, keywords): .70 and
    .1 for each, at most .95; the best ``k``. The queries asked are a bounded set."""
    j = summaries.crossJoin(queries).withColumn("hits", F.size(F.filter("keywords", lambda w: F.contains(F.lower("summary"), F.lower(w))))).where("hits > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("size"), "community")
    scored = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scored.select("query_id", "community", F.round(F.least(F.lit(0.95), 0.70 + 0.1 * F.col("hits")), 6).alias("score"), "rank")
