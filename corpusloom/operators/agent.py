"""The retrieval agent's loop, a plan for each round over all queries that still go on.

A round analyses the queries, deals them to their strategies, runs each strategy once over its own queries, judges what came
back, and rewrites those that are not good enough yet. What a round leaves is stored, so the plan of the next starts from rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation, understanding
from corpusloom.operators.retrieval import of_hits
from corpusloom.session import written as cut

#: (query_id, query) -> (query_id, doc_id, score, rank) of at most k rows a query.
Tool = Callable[[DataFrame], DataFrame]

#: Words that tell a question's type, in the order in which they are tried, and the first strategy of each type.
TYPES = [
    ("factual", ["什么", "是什么", "定义", "概念"], "vector_search"),
    ("policy", ["政策", "规定", "要求", "条件", "标准"], "keyword_search"),
    ("procedural", ["如何", "怎么", "流程", "步骤", "方法"], "hybrid_search"),
]
#: The strategies after the first round, and the one for a missing tool.
SECOND, LATER, DEFAULT = "hybrid_search", "keyword_search", "hybrid_search"
ENOUGH, ROUNDS = 0.7, 3
QUALITIES = ["similarity", "coverage", "diversity", "completeness"]


def question_type(query: Column, types: list | None = None) -> Column:
    """The first type one of whose words the query holds, else ``complex``."""
    kind = F.lit("complex")
    for name, words, _ in reversed(types or TYPES):
        kind = F.when(T.contains_any(F.lower(query), words), name).otherwise(kind)
    return kind


def level(query: Column, n_keywords: Column) -> Column:
    """simple up to 3 keywords without a question mark or a comma, medium up to 6, else complex."""
    plain = ~F.contains(query, F.lit("?")) & ~F.contains(query, F.lit("，"))
    return F.when((n_keywords <= 3) & plain, "simple").when(n_keywords <= 6, "medium").otherwise("complex")


def strategy(kind: Column, iteration: int, tools: dict[str, Tool], types: list | None = None) -> Column:
    """By type in the first round, then the mixed search, then keywords; a strategy without a tool is the default."""
    if iteration == 1:
        out = F.lit(DEFAULT)
        for name, _, first in types or TYPES:
            out = F.when(kind == name, first).otherwise(out)
    else:
        out = F.lit(SECOND if iteration == 2 else LATER)
    return F.when(out.isin(*tools), out).otherwise(DEFAULT)


def judged(current: DataFrame, hits: DataFrame) -> DataFrame:
    """E9 for every query of the round: those without any result have zeros, and similarity as their weakness."""
    quality = evaluation.result_quality(hits.join(current.select("query_id", "query"), "query_id"))
    counts = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("results"))
    j = current.join(counts, "query_id", "left").join(quality.drop("sufficient"), "query_id", "left")
    return j.fillna(0.0, [*QUALITIES, "confidence"]).fillna(0, ["results"]).fillna("similarity", ["weakness"])


def run(queries: DataFrame, tools: dict[str, Tool], texts: DataFrame, rounds: int = ROUNDS, enough: float = ENOUGH, types: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(history, best): what each round did with each query (query_id, query), and each query's results in its best round.

    history: query_id, iteration, query as asked in the round, kind, level, strategy, results, the four qualities, confidence,
    weakness, decision (enough, last or refine) and refined. best: query_id, iteration, confidence, rank, doc_id, score. Of equally good
    rounds the first is best; a query that never finds anything has no row in best. ``texts`` is (doc_id, text). Only queries
    below ``enough`` go on, so a later round's plan reads no more than they need. Null queries count as empty.
    """
    current = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    history, found = [], []
    for iteration in range(1, rounds + 1):
        words = T.tokens(F.col("query"))
        keywords = F.filter(words, lambda w: F.length(w) > 1)
        thought = current.withColumn("kind", question_type(F.col("query"), types)).withColumn("level", level(F.col("query"), F.size(keywords)))
        thought = cut(thought.withColumn("strategy", strategy(F.col("kind"), iteration, tools, types)))
        parts = []
        for name in sorted(r[0] for r in thought.select("strategy").distinct().collect()):  # no more than there are tools
            parts.append(tools[name](thought.where(F.col("strategy") == name).select("query_id", "query")).select("query_id", "doc_id", "score", "rank"))
        if not parts:
            break
        hits = cut(reduce(DataFrame.unionByName, parts))
        hits = cut(hits.join(of_hits(hits, texts.select("doc_id", "text")), "doc_id"))
        seen = judged(thought, hits).withColumn("iteration", F.lit(iteration))
        last = iteration == rounds
        seen = seen.withColumn("decision", F.when(F.col("confidence") >= enough, "enough").otherwise("last" if last else "refine"))
        synonyms = understanding.synonym_variant(T.first_keywords(F.col("query")))
        again = understanding.refine(F.col("query"), F.col("weakness"), F.when(synonyms != "", synonyms))
        seen = cut(seen.withColumn("refined", F.when(F.col("decision") == "refine", again)))
        history.append(seen)
        found.append(hits.select("query_id", F.lit(iteration).alias("iteration"), "rank", "doc_id", "score"))
        if last:
            break
        current = seen.where("decision = 'refine'").select("query_id", F.col("refined").alias("query"))
        if current.isEmpty():
            break
    columns = ["query_id", "iteration", "query", "kind", "level", "strategy", "results", *QUALITIES, "confidence", "weakness", "decision", "refined"]
    if not history:
        kind = queries.schema["query_id"].dataType.simpleString()
        none = "kind string, level string, strategy string, results int, similarity double, coverage double, diversity double, completeness double, confidence double, weakness string, decision string, refined string"
        spark = queries.sparkSession
        return spark.createDataFrame([], f"query_id {kind}, iteration int, query string, {none}"), spark.createDataFrame([], f"query_id {kind}, iteration int, confidence double, rank int, doc_id bigint, score double")
    past = reduce(DataFrame.unionByName, history).select(*columns)
    best = past.groupBy("query_id").agg(F.max(F.struct("confidence", (-F.col("iteration")).alias("i"))).alias("b")).select("query_id", (-F.col("b.i")).alias("iteration"), F.col("b.confidence").alias("confidence"))
    return past, best.join(reduce(DataFrame.unionByName, found), ["query_id", "iteration"])


def best_so_far(history: DataFrame) -> DataFrame:
    """History with the best confidence up to each round."""
    return history.withColumn("best", F.max("confidence").over(Window.partitionBy("query_id").orderBy("iteration")))
