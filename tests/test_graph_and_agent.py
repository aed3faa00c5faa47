"""Communities and the agent's loop against plain code."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import agent, communities, evaluation, graph, understanding
from corpusloom.plans import graph_queries

SF = "/root/testdata/sf0.001"
#: The links of a well-known club of 34 members, each with the members of greater number that it knows.
CLUB = {1: [2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32], 2: [3, 4, 8, 14, 18, 20, 22, 31], 3: [4, 8, 9, 10, 14, 28, 29, 33], 4: [8, 13, 14], 5: [7, 11], 6: [7, 11, 17], 7: [17], 9: [31, 33, 34], 10: [34], 14: [34], 15: [33, 34], 16: [33, 34], 19: [33, 34], 20: [34], 21: [33, 34], 23: [33, 34], 24: [26, 28, 30, 33, 34], 25: [26, 28, 32], 26: [32], 27: [30, 34], 28: [34], 29: [32, 34], 30: [33, 34], 31: [33, 34], 32: [33, 34], 33: [34]}


def plain_modularity(edges, label):
    total, inside, m2 = defaultdict(float), defaultdict(float), 0.0
    for a, b, w in edges:
        m2 += 2 * w
        total[label[a]] += w
        total[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / m2 - (t / m2) ** 2 for c, t in total.items()) if m2 else 0.0


def plain_louvain(edges, seed=1):
    """One node at a time, as published."""
    draw, nodes = random.Random(seed), sorted({x for a, b, _ in edges for x in (a, b)})
    member = {x: x for x in nodes}
    links = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    m2 = sum(sum(v.values()) for v in links.values())
    while True:
        label, k = {x: x for x in links}, {x: sum(links[x].values()) for x in links}
        total = dict(k)
        moved = True
        while moved:
            moved = False
            order = list(links)
            draw.shuffle(order)
            for x in order:
                to = defaultdict(float)
                for y, w in links[x].items():
                    if y != x:
                        to[label[y]] += w
                total[label[x]] -= k[x]
                best = max([label[x], *to], key=lambda c: (round(to[c] - k[x] * total[c] / m2, 12), c == label[x]))
                moved |= best != label[x]
                label[x] = best
                total[best] += k[x]
        if len(set(label.values())) == len(links):
            return member
        member = {x: label[c] for x, c in member.items()}
        up = defaultdict(lambda: defaultdict(float))
        for x, ys in links.items():
            for y, w in ys.items():
                up[label[x]][label[y]] += w
        links = up


def connected(edges, label):
    near, seen = defaultdict(set), {}
    for a, b, _ in edges:
        if label[a] == label[b]:
            near[a].add(b)
            near[b].add(a)
    for x in label:
        if x in seen:
            continue
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen[y] = x
                todo += near[y]
    return len(set(seen.values())) == len(set(label.values()))


def planted(groups, size, inside, outside):
    draw = random.Random(7)
    n = groups * size
    return [(i, j, 1.0) for i in range(n) for j in range(i) if draw.random() < (inside if i // size == j // size else outside)]


GRAPHS = {
    "club": [(a, b, 1.0) for a, bs in CLUB.items() for b in bs],
    "cliques": [(6 * g + i, 6 * g + j, 1.0) for g in range(10) for i in range(6) for j in range(i)] + [(6 * g, 6 * ((g + 1) % 10), 1.0) for g in range(10)],
    "planted": planted(6, 25, 0.4, 0.02),
    "star": [(0, i, 1.0) for i in range(1, 300)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_louvain_is_as_good_as_the_plain_one(spark, name):
    edges = GRAPHS[name]
    got = {r["id"]: r["community"] for r in communities.louvain(spark.createDataFrame(edges, "src bigint, dst bigint, weight double")).collect()}
    want = max(plain_modularity(edges, plain_louvain(edges, s)) for s in range(5))
    mine = plain_modularity(edges, got)
    assert set(got) == {x for e in edges for x in e[:2]} and connected(edges, got)
    assert mine >= 0.95 * want - 1e-12
    assert all(got[c] == c for c in set(got.values())) and all(c <= x for x, c in got.items())
    sums = communities.modularity(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"), spark.createDataFrame(list(got.items()), "id bigint, community bigint")).first()[0]
    assert abs(sums - mine) < 1e-9


def test_louvain_on_hard_rows(spark):
    rows = [(None, 1, 1.0), (1, None, 1.0), (1, 2, 0.0), (3, 4, 1.0), (4, 3, 1.0), (3, 4, 1.0), (5, 5, 2.0), (6, 7, None)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    assert sorted(map(tuple, communities.louvain(e).collect())) == [(3, 3), (4, 3), (5, 5)]
    assert communities.louvain(e.where("false")).collect() == []
    assert communities.modularity(e.where("false"), spark.createDataFrame([], "id bigint, community bigint")).first()[0] == 0.0


def test_louvain_of_a_table(spark):
    edges = [tuple(r) for r in graph_queries.trade(spark, SF).collect()]
    got = {r["id"]: r["community"] for r in graph_queries.g10_louvain(spark, SF).collect()}
    assert plain_modularity(edges, got) >= 0.95 * plain_modularity(edges, plain_louvain(edges)) and connected(edges, got)


@pytest.mark.parametrize("name", ["cliques", "planted"])
def test_louvain_in_many_blocks(spark, name, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK", 40)
    edges = GRAPHS[name]
    got = {r["id"]: r["community"] for r in communities.louvain(spark.createDataFrame(edges, "src bigint, dst bigint, weight double")).collect()}
    want = max(plain_modularity(edges, plain_louvain(edges, s)) for s in range(5))
    assert connected(edges, got) and plain_modularity(edges, got) >= 0.95 * want


def jobs(spark, what):
    """Jobs that a call starts; the driver holds what it knows of each."""
    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", group := f"jobs of {what}")
    try:
        return what(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_louvain_needs_few_jobs(spark):
    edges = spark.createDataFrame(GRAPHS["planted"], "src bigint, dst bigint, weight double")
    _, n = jobs(spark, lambda: communities.louvain(edges).count())
    assert n < 250


def test_components_of_a_long_path(spark):
    nodes = random.Random(3).sample(range(10_000), 600)
    edges = spark.createDataFrame([*zip(nodes, nodes[1:], strict=False), (20_001, 20_000), (20_002, 20_002)], "src bigint, dst bigint")
    got, n = jobs(spark, lambda: dict(map(tuple, graph.components(edges).collect())))
    assert got == dict.fromkeys(nodes, min(nodes)) | {20_000: 20_000, 20_001: 20_000}
    assert n < 250
    assert graph.components(edges.where("false")).collect() == []


DOCS = [
    (1, "alpha beta gamma " * 12 + "delta"), (2, "alpha beta epsilon " * 15), (3, "zeta eta theta"), (4, "the credit rules of the alpha course and what it asks for " * 4), (5, "beta"), (6, "iota kappa lambda mu nu xi " * 10), (7, "alpha and beta and gamma. " * 9),
]
QUERIES = [(1, "what is alpha beta gamma"), (2, "how to kappa lambda"), (3, "unknown words, nothing"), (4, "credit rules"), (5, None), (6, "how does zeta and eta and theta work?"), (7, "alpha beta gamma"), (8, "mu nu xi iota kappa lambda")]
KINDS = [("factual", ["what"], "vector_search"), ("policy", ["credit"], "keyword_search"), ("procedural", ["how"], "no such tool")]


def overlap(power):
    """A tool and its plain twin: the share of a query's words that a document has, raised to a power."""

    def tool(docs):
        def run_(queries):
            own = docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("own"))
            q = queries.withColumn("ask", F.array_distinct(T.tokens(F.col("query"))))
            hit = q.crossJoin(own).withColumn("score", F.pow(F.size(F.array_intersect("ask", "own")) / F.greatest(F.size("ask"), F.lit(1)), F.lit(power))).where("score > 0")
            ranked = hit.selectExpr("*", "cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank")
            return ranked.where("rank <= 3")

        return run_

    def plain(query):
        import re

        ask = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
        found = [(d, (sum(w in set(re.findall(r"[^\W_]+", t.lower())) for w in ask) / max(1, len(ask))) ** power) for d, t in DOCS]
        return sorted([x for x in found if x[1] > 0], key=lambda x: (-x[1], x[0]))[:3]

    return tool, plain


def test_agent_equals_a_plain_loop(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    pairs = {"vector_search": overlap(1.0), "keyword_search": overlap(2.0), "hybrid_search": overlap(0.5)}
    history, best = agent.run(spark.createDataFrame(QUERIES, "query_id bigint, query string"), {n: p[0](docs) for n, p in pairs.items()}, docs, types=KINDS)
    got = {(r["query_id"], r["iteration"]): r for r in history.collect()}
    texts, want, want_best = dict(DOCS), {}, {}
    for query_id, query in QUERIES:
        text, top = query or "", None
        for iteration in (1, 2, 3):
            kind = next((n for n, ws, _ in KINDS if any(w in text.lower() for w in ws)), "complex")
            name = {"factual": "vector_search", "policy": "keyword_search"}.get(kind, "hybrid_search") if iteration == 1 else ("hybrid_search" if iteration == 2 else "keyword_search")
            hits = pairs[name][1](text)
            rows = [(query_id, text, i + 1, d, s, texts[d]) for i, (d, s) in enumerate(hits)]
            quality, weak = 0.0, "similarity"
            if rows:
                one = evaluation.result_quality(spark.createDataFrame(rows, "query_id bigint, query string, rank int, doc_id bigint, score double, text string")).first()
                quality, weak = one["confidence"], one["weakness"]
            if hits and (top is None or quality > top[0]):
                top = (quality, iteration, hits)
            decision = "enough" if quality >= 0.7 else "last" if iteration == 3 else "refine"
            refined = None
            if decision == "refine":
                df = spark.createDataFrame([(text, weak)], "query string, weakness string")
                synonyms = understanding.synonym_variant(T.first_keywords(F.col("query")))
                refined = df.select(understanding.refine(F.col("query"), F.col("weakness"), F.when(synonyms != "", synonyms))).first()[0]
            want[query_id, iteration] = (text, kind, name, len(hits), quality, weak, decision, refined)
            if decision != "refine":
                break
            text = refined
        if top:
            want_best[query_id] = top
    assert {k: (r["query"], r["kind"], r["strategy"], r["results"], r["confidence"], r["weakness"], r["decision"], r["refined"]) for k, r in got.items()} == want
    assert {k[1] for k in want} == {1, 2, 3} and {v[6] for v in want.values()} == {"enough", "refine", "last"} and len({v[2] for v in want.values()}) == 3
    rows = defaultdict(list)
    for r in best.orderBy("query_id", "rank").collect():
        rows[r["query_id"]].append((r["confidence"], r["iteration"], r["doc_id"], round(r["score"], 9)))
    assert dict(rows) == {q: [(c, i, d, round(s, 9)) for d, s in hits] for q, (c, i, hits) in want_best.items()}
    assert agent.best_so_far(history).where("best < confidence").count() == 0
    none, nothing = agent.run(spark.createDataFrame([], "query_id bigint, query string"), {n: p[0](docs) for n, p in pairs.items()}, docs)
    assert none.collect() == [] and nothing.collect() == []
