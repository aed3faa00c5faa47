"""Query understanding: a projection over a table of queries. Rules are small tables; every step is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Intents with their terms, synonyms, hints and stop words.
INTENTS = {
    "training": ["培养目标", "培养方案", "毕业要求", "能力结构"],
    "curriculum": ["核心课程", "课程体系", "选修课", "先修课", "课程安排"],
    "course_chain": ["后续课程", "先修课程", "课程链", "学习路径", "先导课", "前置课程", "课程关系", "课程衔接", "课程顺序"],
    "practice": ["实践环节", "实践教学", "实习", "毕业设计", "论文", "答辩"],
    "credit": ["学分", "总学分", "实践学分", "学时"],
    "scholarship": ["奖学金", "奖助学金", "资助", "申请材料"],
    "student_affairs": ["转专业", "学籍", "违纪", "评优", "宿舍", "请假"],
}
SYNONYMS = {
    "培养目标": ["培养方案", "人才培养", "毕业要求", "能力结构"],
    "核心课程": ["课程体系", "主要课程", "专业核心课", "课程安排"],
    "实践环节": ["实践教学", "企业实习", "毕业设计", "综合实践"],
    "学分要求": ["总学分", "学分结构", "实践学分", "学时要求"],
    "毕业设计": ["毕业论文", "开题", "中期检查", "答辩"],
    "奖学金": ["奖助学金", "评定条件", "申请材料", "评审办法"],
    "转专业": ["专业调整", "转入条件", "申请流程"],
    "课程考核": ["考核方式", "成绩评定", "平时成绩"],
}
POLICY = ["办法", "规定", "条件", "流程", "申请", "评定", "要求", "管理", "细则", "条例"]
PROGRAM = ["培养目标", "课程体系", "毕业要求", "学分", "实践教学", "培养方案", "课程安排"]
COMPARE = ["比较", "区别", "关系", "异同", "优缺点", "对比", "以及", "还有"]
COMPARE_LONG = [*COMPARE, "和…的区别", "分析", "评价", "如何看待", "为什么"]
MULTI_HOP = ["先修课程", "后续课程", "课程链", "学习路径", "课程衔接", "课程关系", "课程顺序", "跨", "覆盖", "重叠", "断层", "一致性", "衔接", "体系"]
SIMPLE = r"^.{0,2}(什么是|是什么|定义|概念).{0,15}$|^.{2,8}(几学分|多少学分|学分数)|^.{2,8}(在第几学期|哪个学期|开课学期)|^.{2,6}(有哪些课|课程有哪些|包含哪些课)|^(你好|你是谁|介绍一下)"
TECHNICAL = r"[A-Za-z]{2,}[\-_/]?[A-Za-z0-9]*|\d+[A-Za-z]+|[A-Za-z]+\d+"
TOP_K = {1: 4, 2: 5, 3: 6, 4: 8, 5: 10}


def intent_scores(query: Column, intents: dict[str, list[str]] | None = None) -> Column:
    """Q2: (intent, score) of the intents hit, best first; ``general`` at .5 without any. A term counts 1, in another
    case .8; the sum is over the number of terms, at most 1."""
    scored = []
    for i, (name, terms) in enumerate((intents or INTENTS).items()):
        hits = sum(F.when(F.contains(query, F.lit(t)), 1.0).when(F.contains(F.lower(query), F.lit(t.lower())), 0.8).otherwise(0.0) for t in terms)
        scored.append(F.struct((-F.round(F.least(hits / len(terms), F.lit(1.0)), 3)).alias("neg"), F.lit(i).alias("o"), F.lit(name).alias("intent")))
    found = F.array_sort(F.filter(F.array(*scored), lambda x: x["neg"] < 0))
    shaped = F.transform(found, lambda x: F.struct(x["intent"].alias("intent"), (-x["neg"]).alias("score")))
    return F.when(F.size(found) > 0, shaped).otherwise(F.array(F.struct(F.lit("general").alias("intent"), F.lit(0.5).alias("score"))))


def category(query: Column, intents: Column, policy: list[str] | None = None, program: list[str] | None = None) -> Column:
    """Q3; ``intents`` is an array of names."""
    has = lambda names: F.arrays_overlap(intents, F.array(*map(F.lit, names)))
    return (
        F.when(query.rlike(TECHNICAL), "technical").when(T.contains_any(query, policy or POLICY) | has(["scholarship", "student_affairs"]), "policy")
        .when(T.contains_any(query, program or PROGRAM) | has(["training", "curriculum", "practice", "credit"]), "program").otherwise("general")
    )


def complexity(query: Column, n_intents: Column, n_keywords: Column, compare: list[str] | None = None) -> Column:
    """Q6: 1 to 5."""
    parts = [n_intents >= 2, n_keywords >= 4, F.length(query) >= 30, T.contains_any(query, compare or COMPARE)]
    return F.least(F.lit(5), 1 + sum(p.cast("int") for p in parts))


def adaptive_k(level: Column, default: int = 6) -> Column:
    """Q6."""
    table = F.create_map(*(F.lit(x) for kv in TOP_K.items() for x in kv))
    return F.coalesce(F.try_element_at(table, level), F.lit(default))


def route(query: Column, level: Column, n_intents: Column) -> Column:
    """Q7."""
    n = F.length(query)
    return (
        F.when(((level <= 1) & (n <= 12)) | query.rlike(SIMPLE), "simple").when((level >= 4) | (n_intents >= 2) | T.contains_any(query, MULTI_HOP), "complex")
        .when(T.contains_any(query, COMPARE_LONG) & (n >= 15), "complex").otherwise("standard")
    )


def adaptive_weights(query: Column, kind: Column, vector: float = 0.7, keyword: float = 0.3) -> Column:
    """Q16: (vector, keyword) weights by length, category and technical tokens, in this order, adding up to 1."""
    n = F.length(F.trim(query))
    v, k = F.lit(vector), F.lit(keyword)
    least, most = lambda c, x: F.least(c, F.lit(x)), lambda c, x: F.greatest(c, F.lit(x))
    k, v = F.when(n <= 8, most(k, 0.45)).when(n >= 20, least(k, 0.25)).otherwise(k), F.when(n <= 8, least(v, 0.55)).when(n >= 20, most(v, 0.75)).otherwise(v)
    k = F.when(kind == "policy", most(k, 0.58)).when(kind == "program", least(k, 0.45)).when(kind == "technical", most(k, 0.62)).otherwise(k)
    v = F.when(kind == "policy", least(v, 0.42)).when(kind == "program", most(v, 0.55)).when(kind == "technical", least(v, 0.38)).otherwise(v)
    technical = query.rlike(TECHNICAL)
    k = F.when(technical, least(k + 0.1, 0.6)).otherwise(k)
    v = F.when(technical, most(1.0 - k, 0.4)).otherwise(v)
    return F.struct((v / (v + k)).alias("vector"), (k / (v + k)).alias("keyword"))


def dynamic_weight(short: Column, technical: Column, questions: Column, base: float = 0.6) -> Column:
    """Q15: the vector weight of the tool: .1 less for short or technical queries, .05 more for questions, from .3 to .8."""
    w = F.lit(base) - F.when(short, 0.1).otherwise(0.0) - F.when(technical, 0.1).otherwise(0.0) + F.when(questions, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.3), F.least(F.lit(0.8), w))


def synonym_variant(keywords: Column) -> Column:
    """Q4: up to four terms that stand for the first keywords with synonyms."""

    def terms(name: str, others: list[str]) -> Column:
        return F.when(F.exists(keywords, lambda k: F.contains(F.lit(name), k) | k.isin(*others)), F.array(F.lit(name), *map(F.lit, others[:2])))

    table = [terms(name, others) for name, others in SYNONYMS.items()]
    return F.array_join(F.slice(F.array_distinct(F.flatten(F.filter(F.array(*table), lambda x: x.isNotNull()))), 1, 4), " ")


def analyse(queries: DataFrame, most: int = 3) -> DataFrame:
    """Q1-Q7, Q16: everything known of each query, with its variants in order (at most ``most``)."""
    q = queries.withColumn("normalised", T.half_width(F.col("query"))).withColumn("keywords", T.first_keywords(F.col("normalised")))
    q = q.withColumn("scores", intent_scores(F.col("normalised"))).withColumn("intents", F.transform("scores", lambda x: x["intent"]))
    q = q.withColumn("category", category(F.col("normalised"), F.col("intents"))).withColumn("complexity", complexity(F.col("normalised"), F.size("intents"), F.size("keywords")))
    technical = F.array_join(F.filter("keywords", lambda k: k.rlike(TECHNICAL)), " ")
    variants = F.array(F.col("normalised"), F.when(F.col("category") == "technical", technical), F.when(F.col("category") != "technical", synonym_variant(F.col("keywords"))))
    q = q.withColumn("variants", F.slice(F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (F.trim(v) != ""))), 1, most))
    q = q.withColumn("route", route(F.col("normalised"), F.col("complexity"), F.size("intents"))).withColumn("k", adaptive_k(F.col("complexity")))
    return q.withColumn("weights", adaptive_weights(F.col("normalised"), F.col("category")))


def suggestions(analysed: DataFrame, most: int = 3) -> DataFrame:
    """Q5: (query_id, position, suggestion): variants other than the query as typed, then focus terms."""
    focus = F.array_join(F.slice("keywords", 1, 4), " ")
    options = F.array_distinct(F.filter(F.concat("variants", F.array(focus)), lambda v: (v != F.col("query")) & (v != "")))
    return analysed.select("query_id", F.posexplode(F.slice(options, 1, most)).alias("position", "suggestion"))


def refine(query: Column, weakness: Column, synonym: Column, history: Column | None = None) -> Column:
    """Q9: the next query by what was weak: synonyms, a plainer wording, the first part, or the bare keywords."""
    plain = F.regexp_replace(query, r"^(请问|怎么|如何|什么是|please |how (do|does|to) |what (is|are) )", "")
    first = F.trim(F.element_at(F.split(query, r"[，,；;。.?？]|以及|和| and "), 1))
    simple = F.array_join(F.slice(T.first_keywords(query), 1, 3), " ")
    out = F.when(weakness == "similarity", F.concat_ws(" ", query, synonym)).when(weakness == "coverage", plain).when(weakness == "completeness", first).otherwise(simple)
    return out if history is None else F.concat_ws(" ", F.array_join(F.slice(F.reverse(history), 1, 3), " "), out)


def cross_topic(queries: DataFrame, patterns: DataFrame, least: int = 2) -> DataFrame:
    """Q10: (query_id, pattern): the first pattern of (pattern, ord, keywords) with ``least`` keywords in the query. The
    patterns are a fixed rule table."""
    hits = queries.crossJoin(F.broadcast(patterns)).withColumn("n", F.size(F.filter("keywords", lambda k: F.contains(F.col("query"), k))))
    return hits.where(F.col("n") >= least).groupBy("query_id").agg(F.min_by("pattern", "ord").alias("pattern"))


def perspectives(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Q11, Q12: (query_id, perspective, hits) by hits, all perspectives with 0 where none is hit; rules as in Q10."""
    hits = queries.crossJoin(F.broadcast(rules)).withColumn("hits", F.size(F.filter("keywords", lambda k: F.contains(F.col("query"), k))))
    any_ = hits.groupBy("query_id").agg(F.max("hits").alias("most"))
    return hits.join(any_, "query_id").where("hits > 0 or most = 0").select("query_id", "perspective", "hits")


def supplemental(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Q12: (query_id, perspective, ord, query): further queries of each perspective: for every rule (perspective, ord,
    keywords, suffix) of which a keyword is in the query, the query with the suffix. The rules are a fixed table."""
    hits = queries.crossJoin(F.broadcast(rules)).where(F.exists("keywords", lambda k: F.contains(F.col("query"), k)))
    return hits.select("query_id", "perspective", "ord", F.concat_ws(" ", "query", "suffix").alias("query"))


def with_hints(query: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Q12: the query with the hints of the rules whose words it holds, in brackets on a line of their own."""
    hints = F.concat_ws("；", *(F.when(T.contains_any(query, words), F.lit(hint)) for words, hint in rules))
    return F.when(hints == "", query).otherwise(F.concat(query, F.lit("\n（"), hints, F.lit("）")))
