"""Ranking metrics, quality of results, grading and gating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.similar import similar_words


def is_relevant(chunk: dict[str, Column], case: dict[str, Column]) -> Column:
    """Listed by id, or every selector that the case has fits: one of its keywords (all of ``must_include``). A case
    without selectors fits nothing."""
    any_of = lambda text, words: F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w)))
    tests = [
        (case["documents"], any_of(chunk["document"], case["documents"])), (case["sections"], any_of(chunk["section"], case["sections"])),
        (case["types"], F.array_contains(case["types"], chunk["type"])), (case["must"], F.forall(case["must"], lambda w: F.contains(F.lower(chunk["text"]), F.lower(w)))),
        (case["acceptable"], any_of(chunk["text"], case["acceptable"])),
    ]
    present = reduce(lambda a, t: a | (F.size(t[0]) > 0), tests, F.lit(False))
    fits = reduce(lambda a, t: a & ((F.size(t[0]) <= 0) | t[1]), tests, F.lit(True))
    return F.array_contains(case["ids"], chunk["id"]) | (present & fits)


def evaluate(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5), pool: DataFrame | None = None) -> DataFrame:
    """A row for each query and each k: precision (over what was returned, if less than k), recall over the whole
    pool, MRR, nDCG whose ideal is cut to what was returned, and the share of what is not relevant.

    Queries that return nothing have rows too, of zeros. Relevant ids count once. Where ``pool`` (query_id, pool) tells how many are
    relevant, ``relevant`` needs to hold those among the ranked alone.
    """
    relevant = relevant.select("query_id", "doc_id").distinct()
    if pool is None:
        pool = relevant.groupBy("query_id").agg(F.count("*").alias("pool"))
    marked = ranked.where(F.col("rank") <= max(ks)).join(relevant.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    at = marked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    m = at.groupBy("query_id", "k").agg(
        F.sum("rel").alias("hits"), F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    every = queries.select("query_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    m = every.join(m, ["query_id", "k"], "left").join(pool, "query_id", "left").fillna(0, ["hits", "n", "mrr", "dcg", "pool"])
    upto = F.least("pool", "n").cast("int")
    ideal = F.when(upto > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)
    r = lambda c, name: F.round(c, 6).alias(name)
    denominator = F.when(F.col("n") > 0, F.least("k", "n")).otherwise(F.col("k"))
    return m.withColumn("ideal", ideal).select(
        "query_id", "k", r(F.col("hits") / denominator, "precision"), r(F.when(F.col("pool") > 0, F.col("hits") / F.col("pool")).otherwise(0.0), "recall"), r(F.col("mrr"), "mrr"),
        r(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), "ndcg"), r(F.when(F.col("n") > 0, 1 - F.col("hits") / F.col("n")).otherwise(0.0), "irrelevant"),
    )


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """E2-E4 at one k, for ``queries`` or else for those that have results or relevant documents."""
    if queries is None:
        queries = ranked.select("query_id").union(relevant.select("query_id"))
    return evaluate(queries, ranked, relevant, (k,)).select("query_id", "precision", "recall", "mrr", "ndcg")


def duplication(queries: DataFrame, results: DataFrame) -> DataFrame:
    """E5: (query_id, duplication): one less the share of distinct (section, first 120 characters) among the results
    (query_id, section, text); 0 without any."""
    sign = F.struct(F.lower(F.trim(F.coalesce("section", F.lit("")))), F.lower(F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 120)))
    found = results.groupBy("query_id").agg(F.round(1 - F.countDistinct(sign) / F.count("*"), 6).alias("duplication"))
    return queries.select("query_id").distinct().join(found, "query_id", "left").fillna(0.0, ["duplication"])


def overall(precision: Column, recall: Column, mrr: Column, ndcg: Column) -> Column:
    """.35, .30, .20 and .15, over the weights of what there is."""
    parts = [(precision, 0.35), (recall, 0.30), (mrr, 0.20), (ndcg, 0.15)]
    weight = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts)
    return F.when(weight > 0, sum(F.coalesce(c, F.lit(0.0)) * w for c, w in parts) / weight)


def corrective_quality(hits: DataFrame) -> DataFrame:
    """Quality, verdict and hints of (query_id, rank, doc_id, score, text, section, keywords)."""
    covered = F.array_distinct(F.flatten(F.collect_list(F.filter("keywords", lambda k: F.contains(F.lower(F.col("text")), k)))))
    g = hits.groupBy("query_id").agg(
        F.least(F.lit(1.0), F.avg(F.when(F.col("rank") <= 3, F.col("score")))).alias("similarity"), covered.alias("covered"), F.first("keywords").alias("keywords"),
        F.countDistinct(F.when(F.trim("section") != "", F.col("section"))).alias("sections"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
    )
    coverage = F.when(F.size("keywords") > 0, F.size("covered") / F.size("keywords")).otherwise(0.5)
    diversity = F.when(F.col("n") <= 1, 0.5).otherwise(F.least(F.lit(1.0), F.col("sections") / F.col("n")))
    complete = F.when(F.col("chars") < 100, 0.2).when(F.col("chars") < 300, 0.4).when(F.col("chars") < 800, 0.7).otherwise(0.9)
    g = g.withColumn("coverage", coverage).withColumn("diversity", diversity).withColumn("completeness", complete)
    quality = 0.35 * F.col("similarity") + 0.30 * F.col("coverage") + 0.15 * F.col("diversity") + 0.20 * F.col("completeness")
    hints = [("similarity", 0.3, "expand_top_k"), ("coverage", 0.4, "rewrite_query"), ("diversity", 0.3, "diversify_retrieval"), ("completeness", 0.3, "lower_threshold")]
    named = F.array_join(F.filter(F.array(*(F.when(F.col(c) < t, F.lit(h)) for c, t, h in hints)), lambda x: x.isNotNull()), ",")
    action = F.when(F.col("quality") >= 0.6, "accept").when(F.col("quality") >= 0.3, "refine").otherwise("reject")
    return g.withColumn("quality", F.round(quality, 6)).select("query_id", "quality", action.alias("action"), named.alias("hints"))


def result_quality(hits: DataFrame) -> DataFrame:
    """Similarity, coverage, diversity, completeness, confidence and the weakest of (query_id, query, rank, doc_id, score, text).

    Diversity is the mean Jaccard distance over pairs of results, 1 for a single result, .5 without a valid pair.
    """
    h = hits.withColumn("own", F.array_distinct(T.tokens(F.col("text")))).withColumn("asked", F.array_distinct(T.tokens(F.col("query"))))
    n = F.length("text")
    length = F.when(n < 50, n / 50.0).when(n > 200, 1.0).otherwise(0.5 + (n - 50) / 300.0)
    shared = F.size(F.array_intersect("asked", "own"))
    density = F.when(F.size("asked") > 0, F.least(F.lit(1.0), shared / F.size("asked"))).otherwise(0.5)
    g = h.groupBy("query_id").agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("score") / F.col("rank")) / F.sum(1.0 / F.col("rank")))).alias("similarity"), F.count("*").alias("n"),
        F.array_distinct(F.flatten(F.collect_list(F.array_intersect("asked", "own")))).alias("covered"), F.first("asked").alias("asked"), F.avg(length).alias("lengths"), F.avg(density).alias("density"),
    )
    a, b = h.select("query_id", F.col("rank").alias("i"), F.col("own").alias("a")), h.select("query_id", F.col("rank").alias("j"), F.col("own").alias("b"))
    pairs = a.join(b, "query_id").where("i < j and size(a) > 0 and size(b) > 0")  # k results a query, k a parameter
    distance = pairs.groupBy("query_id").agg(F.avg(1 - F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("distance"))
    j = g.join(distance, "query_id", "left")
    coverage = F.when(F.size("asked") > 0, F.size("covered") / F.size("asked")).otherwise(1.0)
    diversity = F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce("distance", F.lit(0.5)))
    complete = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("n") / 3.0) * 0.3 + F.col("lengths") * 0.4 + F.col("density") * 0.3)
    j = j.withColumn("coverage", coverage).withColumn("diversity", diversity).withColumn("completeness", complete)
    confidence = 0.35 * F.col("similarity") + 0.25 * F.col("coverage") + 0.25 * F.col("completeness") + 0.15 * F.col("diversity")
    names = ["similarity", "coverage", "diversity", "completeness"]
    weakest = F.array_min(F.array(*(F.struct(F.col(x).alias("v"), F.lit(i).alias("o"), F.lit(x).alias("name")) for i, x in enumerate(names))))["name"]
    return j.select("query_id", *(F.round(x, 6).alias(x) for x in names), F.round(confidence, 6).alias("confidence"), weakest.alias("weakness"), (F.round(confidence, 6) >= 0.7).alias("sufficient"))


def approval(count: Column, quality: Column, iteration: Column, most: int = 3) -> Column:
    """(approved, risk, reason)."""
    risk = F.when((count < 2) | (quality < 0.3), "high").when(iteration >= most, "medium").otherwise("low")
    reason = F.when(count < 2, "too few results").when(quality < 0.3, "low quality").when(iteration >= most, "many iterations").otherwise("ok")
    return F.struct((risk != "high").alias("approved"), risk.alias("risk"), reason.alias("reason"))


#: Words of an answer that refuses, and how an answer that failed begins.
REFUSALS = ["暂无相关内容", "无法回答", "建议咨询", "我不太确定"]
FAILURES = ["[ERROR]", "抱歉"]


def response_score(query: Column, response: Column, refusals: list[str] | None = None, failures: list[str] | None = None) -> Column:
    """Length (.3 from 200 characters, .15 from 50), marks of structure (.2), the share of the query's characters that the
    response has (.3); a refusal leaves .3 of it and a failure .1; at most 1, rounded to 3 places; 0 for an empty response."""
    r = F.trim(F.coalesce(response, F.lit("")))
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    asked = chars(query)
    score = F.when(F.length(r) >= 200, 0.3).when(F.length(r) >= 50, 0.15).otherwise(0.0) + F.when(T.contains_any(r, ["**", "- ", "1."]), 0.2).otherwise(0.0)
    score = score + F.size(F.array_intersect(asked, chars(r))) / F.greatest(F.size(asked), F.lit(1)) * 0.3
    begins = F.lit(False)
    for word in FAILURES if failures is None else failures:
        begins = begins | r.startswith(word)
    score = score * F.when(T.contains_any(r, REFUSALS if refusals is None else refusals), 0.3).otherwise(1.0) * F.when(begins, 0.1).otherwise(1.0)
    return F.when(r == "", 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3))


def grade_responses(turns: DataFrame, refusals: list[str] | None = None, failures: list[str] | None = None) -> DataFrame:
    """Every assistant turn that answers a user turn, with its score and its grade."""
    p = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("r"))
    u = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    s = p.join(u, ["conv_id", "turn"]).withColumn("score", response_score(F.col("q"), F.col("r"), refusals, failures))
    grade = F.when(F.col("score") >= 0.5, "high").when(F.col("score") >= 0.2, "medium").otherwise("low")
    return s.select("conv_id", "turn", "score", grade.alias("grade"))


def expand(queries: DataFrame, words: DataFrame, least: float = 0.85, in_bytes: bool = False) -> DataFrame:
    """Q13: (query_id, term): each query's tokens and the words of the vocabulary that are like one of them, each once."""
    tokens = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).distinct()
    like = similar_words(tokens, words, least, in_bytes)
    return tokens.union(tokens.join(like.select(F.col("token").alias("term"), "variant"), "term").select("query_id", F.col("variant").alias("term"))).distinct()


def fuzzy_pairs(words: DataFrame, least: float, in_bytes: bool = False) -> DataFrame:
    """Q13: (token, variant): distinct words whose similarity reaches ``least``, in both orders."""
    return similar_words(words, words, least, in_bytes).where("token <> variant")


def best_so_far(steps: DataFrame) -> DataFrame:
    """The best confidence up to each iteration."""
    w = Window.partitionBy("query_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("best", F.max("confidence").over(w))
