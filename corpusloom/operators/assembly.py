"""Folds over ordered rows, harvesting, response assembly and corpus graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Words by which sections are kept.
PROGRAM = ["培养目标", "毕业要求", "课程体系", "学分要求", "实践教学", "培养方案", "学制", "授予学位"]
TOPICS = [r"《([^》]+)》", r"第[一二三四五六七八九十\d]+章\s*([^\s。]{2,20})", r"([\p{L}]{2,8})课程", r"([\p{L}]{2,8})设计", r"([\p{L}]{2,8})实验", r"([\p{L}]{2,8})基础"]


def merge_soft_wraps(lines: Column, most: int = 120, ends: str = "。！？；.!?;:：") -> Column:
    """First-seen lines; a line that goes on from one without a terminator is put to it while that is shorter than
    ``most``. The length of the merged line counts, so it is a fold; a fold in SQL would copy the lines at every step, so
    it runs over Arrow batches."""
    @F.pandas_udf("array<string>")
    def folded(column: pd.Series) -> pd.Series:
        def fold(kept):
            done: list[list[str]] = []
            for line in kept if kept is not None else ():
                if done and sum(map(len, done[-1])) < most and done[-1][-1][-1:] not in ends:
                    done[-1].append(line)
                else:
                    done.append([line])
            return ["".join(parts) for parts in done]

        return column.map(fold)

    return folded(F.array_distinct(F.filter(lines, lambda x: F.length(F.trim(x)) > 0)))


def slice_between(lines: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Of each document the lines from the first that fits ``start`` up to the next that fits ``stop``; all lines of
    a document without a start. ``lines`` has (doc_id, pos, line)."""
    first = lines.groupBy("doc_id").agg(F.min(F.when(start, F.col("pos"))).alias("a"))
    marked = lines.join(first, "doc_id")
    end = marked.where(stop & (F.col("pos") > F.col("a"))).groupBy("doc_id").agg(F.min("pos").alias("b"))
    inside = F.col("a").isNull() | ((F.col("pos") >= F.col("a")) & (F.col("b").isNull() | (F.col("pos") < F.col("b"))))
    return marked.join(end, "doc_id", "left").where(inside).select("doc_id", "pos", "line")


def keep_section(title: Column, body: Column, words: list[str], least: int = 120) -> Column:
    """K3: long enough, not a table, and one of the words in the title or the first 240 characters."""
    return (F.length(body) >= least) & ~T.contains_any(body, T.TABLE_HINTS) & (T.contains_any(title, words) | T.contains_any(F.substring(body, 1, 240), words))


def document_kind(name: Column) -> Column:
    """K4."""
    return F.when(name.contains("培养方案"), "program_spec").otherwise("course_outline")


def education_level(kind: Column, section: Column, text: Column) -> Column:
    """K15."""
    head = F.substring(text, 1, 100)
    return F.when(kind == "program_spec", "macro").when(T.contains_any(section, ["教学目的", "课程目标", "教学目标"]) | T.contains_any(head, ["教学目的", "教学重点", "课程目标", "教学大纲"]), "meso").otherwise("micro")


def section_path(section: Column) -> Column:
    """K15."""
    return F.array_join(F.transform(F.split(section, ">"), lambda x: F.trim(x)), " > ")


def document_summary(chunks: DataFrame, titles: int = 5, words: int = 8) -> DataFrame:
    """(doc_id, titles, keywords) of a document's first ten chunks (doc_id, ord, title, text), in order of first occurrence."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    head = chunks.withColumn("n", F.row_number().over(w)).where("n <= 10")
    g = head.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "title", T.first_keywords(F.col("text"), 3).alias("k")))).alias("l"))
    firsts = F.slice(F.array_distinct(F.filter(F.transform("l", lambda x: x["title"]), lambda t: F.coalesce(t, F.lit("")) != "")), 1, titles)
    return g.select("doc_id", F.array_join(firsts, "；").alias("titles"), F.array_join(F.slice(F.array_distinct(F.flatten(F.transform("l", lambda x: x["k"]))), 1, words), " ").alias("keywords"))


def topics(docs: DataFrame, limit: int = 20, patterns: list[str] | None = None) -> DataFrame:
    """Distinct harvested topics of at most 20 characters, the first in order."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns or TOPICS))
    return docs.select(F.explode(found).alias("topic")).where(F.length("topic").between(2, 20)).distinct().orderBy("topic").limit(limit)


def key_content(text: Column, limit: int = 200) -> Column:
    """Cut at a sentence end in the last 50 characters, else at a space, else with an ellipsis."""
    head = F.substring(text, 1, limit)
    tail = F.substring(text, limit - 49, 50)
    at = F.length(F.regexp_extract(tail, "(?s)^(.*[。！？.!?])", 1))
    space = F.length(F.regexp_extract(tail, "(?s)^(.*) ", 1))
    cut = F.when(at > 0, F.substring(text, F.lit(1), at + limit - 50)).when(space > 0, F.concat(F.substring(text, F.lit(1), space + limit - 50), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def merge_adjacent(rows: DataFrame, most: int = 520) -> DataFrame:
    """(query_id, rank, section, text): neighbours of one section put together while they fit in ``most``.

    Groups are islands of equal sections; inside one, blocks are cut by the running length.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    new = F.when(F.lag("section").over(w) == F.col("section"), 0).otherwise(1)
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy("query_id", "island").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("new", new).withColumn("island", island).withColumn("block", F.floor((F.sum(F.length("text")).over(inside) - 1) / most))
    g = r.groupBy("query_id", "island", "block").agg(F.min("rank").alias("rank"), F.first("section").alias("section"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l"))
    return g.select("query_id", "rank", "section", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), F.size("l").alias("parts"))


def evidence(hits: DataFrame, each: int = 2, most: int = 6) -> DataFrame:
    """Distinct sentences of a query's hits (query_id, rank, text), ``each`` of a hit, ``most`` of a query."""
    s = hits.select("query_id", "rank", F.posexplode(T.key_sentences(F.col("text"), each)).alias("pos", "sentence"))
    one = s.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "sentence").orderBy("rank", "pos"))).where("rn = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "pos"))).where(F.col("place") <= most).select("query_id", "place", "sentence")


#: Words by which questions are sorted, in the order in which the classes are tried.
RESPONSE_KINDS = [
    ("greeting", ["你好", "您好", "hello", "hi"]), ("help", ["帮助", "help", "能做什么", "功能"]), ("curriculum", ["培养方案", "培养计划", "课程体系", "培养目标", "毕业要求", "学位"]),
    ("credit", ["学分", "总学分", "必修", "选修", "学时"]), ("practice", ["实践", "实习", "实验", "毕业设计", "毕业论文", "课程设计", "项目"]), ("prerequisite", ["先修", "前置", "基础课", "先学"]),
    ("course_detail", ["课程", "学什么", "教学内容", "大纲", "机器学习", "深度学习", "python"]),
]
QUERY_TYPES = [("factual", ["什么", "是什么", "定义", "概念"]), ("policy", ["政策", "规定", "要求", "条件", "标准"]), ("procedural", ["如何", "怎么", "流程", "步骤", "方法"])]
QUESTION_FORMS = [("how_to", ["什么", "如何", "怎么", "怎样"]), ("yes_no", ["是否", "能不能", "可以"]), ("quantity", ["哪些", "多少", "几个"])]


def first_class(c: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """The first class of which a word is in the text."""
    out = F.lit(default)
    for name, words in reversed(classes):
        out = F.when(T.contains_any(c, words), name).otherwise(out)
    return out


def response_kind(query: Column) -> Column:
    """Which template answers."""
    return first_class(F.lower(query), RESPONSE_KINDS, "general")


def query_class(query: Column, history: Column | None = None) -> Column:
    """Q8: (type, form, complexity, requires_context) of a question; keywords are its distinct tokens of two characters or more."""
    n = F.size(F.array_distinct(F.filter(T.tokens(query), lambda t: F.length(t) > 1)))
    complexity = F.when((n <= 3) & ~query.contains("?") & ~query.contains("，"), "simple").when(n <= 6, "medium").otherwise("complex")
    context = F.lit(False) if history is None else F.coalesce(F.size(history) > 0, F.lit(False))
    return F.struct(first_class(F.lower(query), QUERY_TYPES, "complex").alias("type"), first_class(query, QUESTION_FORMS, "general").alias("form"), complexity.alias("complexity"), context.alias("requires_context"))


#: What a question can name, in the order in which it is listed.
ENTITIES = ["国家奖学金", "励志奖学金", "优秀学生奖学金", "助学金", "补考", "重修", "期末考试", "期中考试", "警告", "严重警告", "记过", "留校察看", "开除学籍"]


def entities(query: Column, names: list[str] | None = None) -> Column:
    """Q8: the names that a question holds, in their own order; an empty array for a null question."""
    own = F.array(*map(F.lit, ENTITIES if names is None else names))
    return F.filter(own, lambda x: F.coalesce(F.contains(query, x), F.lit(False)))


#: Greetings, and the length up to which a question is too short for a hypothetical answer.
GREETINGS = ["你好", "您好", "在吗", "谢谢", "hello", "hi", "帮助", "是谁"]
SHORT_QUERY, HYDE_CHARS = 6, 500


def hyde_variant(query: Column, answer: Column) -> Column:
    """Q14: the first characters of a model's hypothetical answer as a second query; null for short questions, greetings and
    blank answers. The answer comes from the caller."""
    plain = F.trim(query)
    head = F.substring(F.trim(answer), 1, HYDE_CHARS)
    return F.when((F.length(plain) > SHORT_QUERY) & ~F.lower(plain).isin(GREETINGS) & (head != ""), head)


def clean_section_lines(lines: Column, outline: bool = False, script: str = "cjk") -> Column:
    """A section's lines normalised, the first of equal ones, without noise, tables of contents, tables and, in outlines,
    code; a line goes to the one before it unless that is ended or long, or it is a heading itself."""
    drop = lambda x: T.corpus_noise(x) | T.toc_line(x) | T.table_like(x, script) | (T.code_like(x, script) if outline else F.lit(False))
    kept = F.filter(F.array_distinct(F.filter(F.transform(lines, T.corpus_line), lambda x: x != "")), lambda x: ~drop(x))
    marked = F.transform(kept, lambda x: F.struct(x.alias("line"), T.heading_level(x).isNotNull().alias("heading")))

    @F.pandas_udf("array<string>")
    def folded(column: pd.Series) -> pd.Series:
        def fold(rows):
            done: list[str] = []
            for r in rows if rows is not None else ():
                if done and not r["heading"] and done[-1][-1:] not in "。！？;；:：" and len(done[-1]) < 120:
                    done[-1] = f"{done[-1].rstrip()} {r['line'].lstrip()}".strip()
                else:
                    done.append(r["line"])
            return done

        return column.map(fold)

    return folded(marked)


def course_graph(courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: nodes and typed edges of (id, name, prerequisites, leads_to, concepts, objectives), each edge once."""
    def of(column: str, kind: str, forward: bool) -> DataFrame:
        end = courses.select(F.col("id"), F.explode(column).alias("e"))
        return end.select(F.col("id" if forward else "e").alias("src"), F.col("e" if forward else "id").alias("dst"), F.lit(kind).alias("type"))

    edges = of("prerequisites", "prerequisite", False).unionByName(of("leads_to", "leads_to", True)).unionByName(of("concepts", "contains", True)).unionByName(of("objectives", "supports", True)).distinct()
    named = courses.select("id", F.lit("course").alias("type"), "name")
    for column, kind in (("concepts", "concept"), ("objectives", "requirement")):
        named = named.unionByName(courses.select(F.explode(column).alias("id")).distinct().select("id", F.lit(kind).alias("type"), F.col("id").alias("name")))
    return named, edges


def concept_levels(chunks: DataFrame, courses: DataFrame) -> DataFrame:
    """(concept, level): the level of the first chunk of a known course that names the concept and has one."""
    known = chunks.join(courses.select("course"), "course", "left_semi").select("ord", "level", F.explode("concepts").alias("concept"))
    return known.groupBy(T.concept_id(F.col("concept")).alias("concept")).agg(F.min_by(F.nullif("level", F.lit("")), F.when(F.coalesce("level", F.lit("")) != "", F.col("ord"))).alias("level"))


def readiness(expected: DataFrame, found: DataFrame) -> DataFrame:
    """What is expected and missing."""
    return expected.join(found, "name", "left_anti")


def first_similarity(original: Column, similarity: Column) -> Column:
    """The similarity before any reranking; the first write wins."""
    return F.coalesce(original, similarity)


def log_record(*columns: str) -> Column:
    """A structured log line."""
    return F.to_json(F.struct(*columns))


def trace(steps: DataFrame) -> DataFrame:
    """(run_id, steps, seconds, each): the steps of a run in order, with their total and mean duration."""
    g = steps.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("l"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("each"))
    return g.select("run_id", F.array_join(F.transform("l", lambda x: x["name"]), ">").alias("steps"), F.round("seconds", 6).alias("seconds"), F.round("each", 6).alias("each"))


def half_range(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and half the range."""
    return rows.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round((F.max(value) - F.min(value)) / 2, 6).alias("spread"))


#: How an answer of each kind begins and ends.
TEMPLATES = {
    "curriculum": ("围绕培养方案，当前检索结果可以归纳为以下几部分：", "如果你需要，我可以继续拆解成培养目标、毕业要求或课程结构。"),
    "practice": ("围绕实践教学环节，当前可以确认以下要点：", "实践安排通常会随学期或学院通知调整，最终以当期发布内容为准。"),
    "credit": ("围绕学分要求，当前可以确认以下内容：", "如果你想进一步区分必修、选修或实践学分，我可以继续按模块展开。"),
    "course_detail": ("围绕课程内容，当前检索结果可以归纳为以下信息：", "如果要继续追问某门课程的考核方式、先修要求或实践安排，可以直接补充课程名。"),
    "prerequisite": ("围绕先修关系，当前检索结果可以整理为：", "如果你提供具体课程名，我可以继续按学习顺序整理。"),
    "general": ("根据当前检索结果，可以先确认以下信息：", "如果你希望答案更聚焦，可以继续限定主题或给出具体课程、章节名称。"),
}
GREETING = "你好，我是{0}。\n\n你可以直接询问培养方案、课程体系、学分要求、奖助学金或毕业设计相关问题。"
HELP = "{0}当前支持基于知识库回答以下内容：\n\n- 培养方案与毕业要求\n- 课程体系与先修关系\n- 学分结构与实践教学安排\n- 学生事务相关政策"
FALLBACK = ("当前知识库中没有检索到能够直接支撑“", "”的片段。\n\n建议换一种更具体的问法，例如直接说明课程名称、培养目标、学分要求或毕业环节。")


def themed_responses(queries: DataFrame, points: DataFrame, agent: str, kind: Column | None = None) -> DataFrame:
    """(query_id, kind, response): the template of each query's kind around its points, one a line in order; the
    greeting and the help as they are; without points the fallback. ``points`` has (query_id, place, sentence)."""
    lists = points.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence"))), lambda x: F.concat(F.lit("- "), x["sentence"])), "\n").alias("lines"))
    j = queries.join(lists, "query_id", "left").withColumn("kind", response_kind(F.col("query")) if kind is None else kind)
    table = F.create_map(*(x for k, (a, b) in TEMPLATES.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))))
    own = table[F.col("kind")]
    themed = F.concat_ws("\n\n", own[0], "lines", own[1])
    empty = F.concat(F.lit(FALLBACK[0]), "query", F.lit(FALLBACK[1]))
    text = F.when(F.col("kind") == "greeting", GREETING.format(agent)).when(F.col("kind") == "help", HELP.format(agent)).when(F.col("lines").isNull(), empty).otherwise(themed)
    return j.select("query_id", "kind", text.alias("response"))


def correlations(sections_: DataFrame, notes: dict[str, list[str]]) -> DataFrame:
    """X11: (query_id, narrative): what the sections of a cross-topic search have to do with each other: the first three with
    their keywords and reason, two excerpts of each of the first two, and what the pattern's own note adds.

    ``sections_`` has (query_id, pattern, place, section, keywords, reason, excerpts); a query without a section has one row with a null one.
    """
    line = F.concat(F.lit("   - 《"), "section", F.lit("》：涉及 "), F.array_join("keywords", ", "), F.lit(" 等关键词（"), "reason", F.lit("）"))
    lines = F.transform(F.sort_array(F.collect_list(F.when((F.col("place") <= 3) & F.col("section").isNotNull(), F.struct("place", line.alias("x"))))), lambda r: r["x"])
    points = F.flatten(F.transform(F.sort_array(F.collect_list(F.when((F.col("place") <= 2) & F.col("section").isNotNull(), F.struct("place", F.transform(F.slice("excerpts", 1, 2), lambda e: F.concat(F.lit("   - "), e)).alias("x"))))), lambda r: r["x"]))
    g = sections_.groupBy("query_id", "pattern").agg(lines.alias("lines"), points.alias("points"))
    none = F.size("lines") == 0
    note = F.lit(None).cast("string")
    for pattern, (title, *rest) in notes.items():
        note = F.when(F.col("pattern") == pattern, "\n".join([f"\n\n3. {title}：", *(f"   - {x}" for x in rest)])).otherwise(note)
    found = F.concat_ws("\n", F.lit("\n1. 章节关联："), F.array_join("lines", "\n"), F.lit("\n2. 规章要点："), F.when(F.size("points") > 0, F.array_join("points", "\n")))
    empty = F.lit("\n1. 未发现直接关联的章节\n\n2. 将基于各关键词独立分析相关规定")
    end = F.when(none, "\n\n4. 结论：\n   - 各项规定相对独立，需分别了解").otherwise("\n\n4. 结论：\n   - 多项规章存在明确关联，需综合考虑\n   - 建议同时参考所有相关规定")
    return g.select("query_id", F.concat_ws("\n", F.lit("相关规章关联分析："), F.when(none, empty).otherwise(found), note, end).alias("narrative"))


def enriched_context(contexts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, context): each context with its further blocks (query_id, ord, block) after it, in order, a blank line
    between; contexts without blocks as they are."""
    more = blocks.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("more"))
    return contexts.join(more, "query_id", "left").select("query_id", F.concat_ws("\n\n", "context", "more").alias("context"))
