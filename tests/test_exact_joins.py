"""Edit-distance and cosine joins and exact percentiles against all pairs and whole sorts."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import graph
from corpusloom.operators import maintenance as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import similar
from corpusloom.plans import REGISTRY


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.9, 0.75, 0.5])
def test_similar_words_are_those_of_all_pairs(spark, least):
    draw = random.Random(4)
    base = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 14))) for _ in range(40)] + ["a", "ab", "aaaaaaaaaaaaaaaa", "été", "ß"]

    def edited(w):
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(w))
            w = draw.choice([w[:at] + "x" + w[at:], w[:at] + w[at + 1 :], w[:at] + "c" + w[at + 1 :]])
        return w

    left, right = base + base[:3], [edited(w) for w in base for _ in range(2)] + base[:5]
    want = {(a, b) for a in left for b in right if a and b and 1 - lev(a, b) / max(len(a), len(b)) >= least}
    frame = lambda ws: spark.createDataFrame([(w,) for w in [*ws, None, ""]], "term string")
    got = [tuple(r) for r in similar.similar_words(frame(left), frame(right), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert similar.similar_words(frame(left).where("false"), frame(right), least).collect() == []


def test_words_that_begin_alike_do_not_all_meet(spark):
    names = spark.range(10_000).select(F.format_string("supplier#%09d", "id").alias("term"))
    began = time.time()
    assert E.fuzzy_pairs(names, 0.9).count() == 10_000 * 4 * 9  # one of four digits is another
    assert time.time() - began < 60  # half of each name is the same, so all pairs of them met


def test_words_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select(F.format_string("Supplier#%09d", "id").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = REGISTRY.queries["q13_fuzzy_pairs"](spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # what is left of the words is many times as large as they are
    assert pairs.count() == 1000 * 3 * 9


def test_edits_in_bytes(spark):
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "term string")
    left, right = frame(["enlichä", "ciónta", "abcdefg"]), frame(["enlichs", "cióntas", "abcdefx", "enlichö"])
    found = lambda b: {tuple(r) for r in similar.similar_words(left, right, 0.85, b).collect()}
    bytewise = {("ciónta", "cióntas"), ("abcdefg", "abcdefx"), ("enlichä", "enlichö")}  # these differ in one byte: ä is c3 a4, ö c3 b6
    assert found(True) == bytewise and found(False) == bytewise | {("enlichä", "enlichs")}


def test_a_part_without_a_name_has_no_words(spark, tmp_path):
    spark.createDataFrame([(1, None, "LARGE"), (2, "hot bolt", "SMALL")], "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "qq qq larges smalls")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["term"] for r in REGISTRY.queries["q13_expansion"](spark, str(tmp_path)).collect()}
    assert found == {"qq", "larges", "smalls"}  # 'small' is 5 of 6 characters: below .85


def test_no_nested_loop_in_the_plans(spark):
    words = spark.createDataFrame([("abc",)], "term string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vector array<double>")
    for df in (similar.similar_words(words, words, 0.8), similar.cosine_join(vectors, vectors, 0.88)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("least", [0.88, 0.5, 0.999])
def test_cosine_join_is_all_pairs(spark, least):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + draw.normal(size=16) * draw.choice([0.05, 0.3, 1.0])).tolist()) for i in range(150)]
    left = rows[:50] + [(900, [0.0] * 16), (901, None), (902, [])]
    right = rows[40:] + [(500, rows[60][1]), (501, rows[60][1]), (502, [0.0] * 16), (503, None), (504, [5 * x for x in rows[0][1]])]
    want = {}
    for a, v in left:
        for b, w in right:
            if v and w and np.linalg.norm(v) and np.linalg.norm(w):
                c = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
                if round(c, 6) >= least:
                    want[a, b] = round(c, 6)
    frame = lambda xs: spark.createDataFrame(xs, "id bigint, vector array<double>")
    got = similar.cosine_join(frame(left), frame(right), least, pivots=8).collect()
    assert {(r[0], r[1]): r[2] for r in got} == pytest.approx(want, abs=2e-6) and len(got) == len(want)
    assert similar.cosine_join(frame(left), frame(right).where("false"), least).collect() == []


def test_percentiles_in_rounds(spark):
    draw = random.Random(8)
    values = {"even": [draw.random() for _ in range(5000)], "hot": [7.0] * 4000 + [draw.random() * 1e9 for _ in range(100)], "wide": [10.0 ** draw.uniform(-300, 300) * draw.choice([-1, 1]) for _ in range(3000)], "one": [3.5], "two": [1.0, 2.0], None: [float(i) for i in range(999)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", None), ("none", None)]
    draw.shuffle(rows)
    got = M.percentile_stats(spark.createDataFrame(rows, "k string, value double"), ["k"], "value", (0.0, 0.5, 0.95, 0.99), accuracy=200, most=5).collect()
    assert {r["k"] for r in got} == set(values)
    for r in got:
        ordered = sorted(values[r["k"]])
        n = len(ordered)
        assert r["n"] == n and [r[f"p{p}"] for p in (0, 50, 95, 99)] == pytest.approx([ordered[min(int(n * p), n - 1)] for p in (0.0, 0.5, 0.95, 0.99)], rel=1e-9, abs=1e-6)
    assert M.percentile_stats(spark.createDataFrame([], "k string, value double"), ["k"], "value").collect() == []


def test_cache_by_threshold(spark):
    entries = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.9, 0.1], 0), ("c", [0.9, 0.1], 0), ("old", [0.0, 1.0], 1), ("z", None, 0)], "key string, vector array<double>, ttl int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    asked = spark.createDataFrame([(1, "a", [0.0, 1.0]), (2, "q", [0.9, 0.1]), (3, "r", [0.0, 1.0]), (4, "s", [0.0, 0.0]), (5, "z", [1.0, 1.0])], "query_id int, key string, vector array<double>")
    got = M.cached(asked, entries, F.lit("2024-01-01 00:01:00").cast("timestamp")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "exact", 1.0), (2, "b", "similar", 1.0), (5, "z", "exact", 1.0)]
    counts = defaultdict(int)
    for r in got:
        counts[r["kind"]] += 1
    assert counts == {"exact": 2, "similar": 1}


def test_corpus_variants(spark):
    import re

    from corpusloom.plans import REGISTRY

    words = lambda t: {w for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select("text").collect() for w in re.findall(r"[^\W_]+", (r[0] or "").lower())}
    near = lambda a, b: abs(len(a) - len(b)) <= 0.15 * max(len(a), len(b)) + 1e-6 and len(set(a) ^ set(b)) <= 4
    vocabulary = words("documents")
    want = {(a, b) for a in words("benchmark") for b in vocabulary if near(a, b) and 1 - lev(a, b) / max(len(a), len(b)) >= 0.85}
    assert {tuple(r) for r in REGISTRY.queries["q13_corpus_variants"](spark, "/root/testdata/sf0.001").collect()} == want and len(want) > 100


def test_the_nearest_of_a_cosine_join_comes_once(spark, monkeypatch):
    for name, n in (("LEFT_BLOCK", 7), ("RIGHT_BLOCK", 9), ("SLICE", 20)):
        monkeypatch.setattr(similar, name, n)
    draw = np.random.default_rng(5)
    points = draw.normal(size=(12, 8))
    right = [(f"k{i}", points[i % 12].tolist()) for i in range(200)]  # each vector many times
    left = [(i, (points[i % 12] + draw.normal(size=8) * 0.1).tolist()) for i in range(30)]
    frame = lambda rows, kind: spark.createDataFrame(rows, f"id {kind}, vector array<double>")
    every = similar.cosine_join(frame(left, "int"), frame(right, "string"), 0.4).collect()
    want = {i: min((-r["similarity"], r["right_id"]) for r in every if r["left_id"] == i) for i in {r["left_id"] for r in every}}
    got = similar.cosine_join(frame(left, "int"), frame(right, "string"), 0.4, nearest=True).collect()
    assert len(want) == len(got) == 30 and {r["left_id"]: (-r["similarity"], r["right_id"]) for r in got} == want
    v = frame(right, "string").selectExpr("cast(substr(id, 2) as int) as vec_id", "vector as embedding")
    ids = R.dense_knn(frame(left, "int").withColumnRenamed("id", "query_id"), v, 3).where("query_id = 0").orderBy("rank").collect()
    assert [r["doc_id"] for r in ids] == [0, 12, 24]
    # a group passes on no more than it must, however many rows are as near
    side = lambda rows: spark.createDataFrame([(i, x, 0, 0, 0) for i, (_, x) in enumerate(rows)], "id int, vector array<double>, cell int, block int, part int")
    assert similar.blockwise(side(left), side(right), k=3).count() == 90


def test_pairs_of_a_category_are_all_but_the_linked(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    draw = random.Random(8)
    nodes = [(i, draw.choice("aab")) for i in range(40)] + [(7, "a"), (7, "b"), (41, None), (42, None), (None, "a"), (43, "c")]
    nodes += [(50 + i, "d") for i in range(12)]
    edges = [(draw.randrange(45), draw.randrange(45)) for _ in range(300)] + [(3, 3), (None, 4)] + [(50 + i, 50 + j) for i in range(12) for j in range(12) if i != j and (i, j) != (2, 9) and (j, i) != (2, 9)]
    linked = {frozenset(e) for e in edges}
    want = sorted((a, b, 0.3) for a, k in nodes for b, m in nodes if k is not None and k == m and a is not None and b is not None and a < b and frozenset((a, b)) not in linked)
    got = graph.same_category(spark.createDataFrame(nodes, "id bigint, category string"), spark.createDataFrame(edges, "src bigint, dst bigint"), "category")
    assert sorted(map(tuple, got.collect())) == want and (52, 59, 0.3) in want and len(want) > 100
    # no pair is shuffled to meet the edges
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_part_without_a_brand_or_size_has_no_pair(spark, tmp_path):
    rows = [(1, None, 5), (2, None, 5), (3, "x", None), (6, "x", None), (9, "x", 5), (11, "x", 5)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in REGISTRY.queries["g03_same_category"](spark, str(tmp_path)).collect()] == [(9, 11, 0.3)]
