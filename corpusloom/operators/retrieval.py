"""Sparse and dense retrieval, fusion, reranking and diversity over many queries and many documents at once.

Scores come from an inverted index: query terms meet the documents' postings in an equi-join on the term, so only
documents that share a term are touched. Every order has the id as tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import similar
from corpusloom.session import written

K1, B = 1.5, 0.75
RRF = 60
RERANK_HEAD = 10


def postings(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select("doc_id", F.explode(T.tokens(F.col("text") if text is None else text)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1: document frequencies (term, df), lengths (doc_id, len), and one row (n, avgdl)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    return df, lengths, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): terms with their multiplicity."""
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """R2: (query_id, doc_id, score). Documents without any term of a query have no row."""
    index = postings(docs)
    df, lengths, total = corpus_stats(index)
    wanted = query_terms(queries)
    # only the postings of asked terms take part in what follows
    hits = index.join(wanted, "term").join(df.join(wanted.select("term").distinct(), "term", "left_semi"), "term").join(lengths, "doc_id").crossJoin(total)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def tfidf(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """R1 on words: cosine of raw tf times ln((1 + N) / (1 + df)) + 1, both sides normalised."""
    index = postings(docs)
    df, _, total = corpus_stats(index)
    idf = df.crossJoin(total).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = index.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    asked = query_terms(queries).join(idf, "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    qnorm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = weighted.join(asked.select("query_id", "term", "qw"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(norm, "doc_id").join(qnorm, "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """The k best of each query, with ``rank`` from 1."""
    w = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalised(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scores over the query's largest, 0 where that isn't positive."""
    most = scored.groupBy("query_id").agg(F.max(score).alias("most"))
    return scored.join(most, "query_id").withColumn(score, F.when(F.col("most") > 0, F.col(score) / F.col("most")).otherwise(0.0)).drop("most")


#: Words of a query that ask for a kind of chunk, the column that tells it, its value and the bonus.
TYPE_BONUS = [(["培养目标", "毕业要求", "培养方案"], "chunk_type", "program_spec", 0.15), (["教学大纲", "课程目标", "课程设置"], "education_level", "meso", 0.10)]


def metadata_score(keywords: Column, haystack: Column, text: Column, document: Column, course: Column | None = None, asked_courses: Column | None = None, kinds: dict[str, Column] | None = None, rules: list | None = None) -> Column:
    """Share of keywords that the metadata hold; .2 if one of the first three stands in the first 160 characters; .2 if
    one of the first two names the document; .3 for a course that is asked for; the first rule whose words the keywords
    hold adds its bonus to chunks of its kind. At most 1, and 0 without keywords."""
    any_in = lambda words, where: F.exists(words, lambda k: F.contains(where, k)).cast("int")
    share = F.size(F.filter(keywords, lambda k: F.contains(haystack, k))) / F.greatest(F.size(keywords), F.lit(1))
    total = share + 0.2 * any_in(F.slice(keywords, 1, 3), F.substring(text, 1, 160)) + 0.2 * any_in(F.slice(keywords, 1, 2), document)
    if course is not None and asked_courses is not None:
        total = total + F.when(F.coalesce(F.array_contains(asked_courses, course), F.lit(False)), 0.3).otherwise(0.0)
    said, bonus = F.array_join(keywords, " "), F.lit(0.0)
    for words, column, value, more in reversed(TYPE_BONUS if rules is None else rules):
        if kinds and column in kinds:
            bonus = F.when(T.contains_any(said, words), F.when(kinds[column] == value, more).otherwise(0.0)).otherwise(bonus)
    return F.when(F.size(keywords) > 0, F.least(F.lit(1.0), total + bonus)).otherwise(0.0)


def hybrid(tf: DataFrame, bm: DataFrame, meta: DataFrame, keep: Column, k: int, weights: tuple[float, float, float] = (0.40, 0.30, 0.30)) -> DataFrame:
    """Weighted sum of the three channels; the best 4k, then the filter, then the best k. The window between keeps
    the filter from being pushed below."""
    parts = [normalised(tf).withColumnRenamed("score", "s0"), normalised(bm).withColumnRenamed("score", "s1"), meta.withColumnRenamed("score", "s2")]
    joined = reduce(lambda a, x: a.join(x, ["query_id", "doc_id"], "full"), parts)
    total = sum(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * w for i, w in enumerate(weights))
    head = top_k(joined.select("query_id", "doc_id", total.alias("score")), 4 * k)
    return top_k(head.drop("rank").where(keep), k)


def dense_knn(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest by cosine, exactly, among the vectors that ``where`` leaves.

    Queries (query_id, vector) and vectors (vec_id, embedding) meet in blocks of bounded size, every pair of blocks as a group of
    its own, which passes on the k best of each query there. A zero vector is like none. All vectors have one length.
    """
    v = similar.vectors(vectors if where is None else vectors.where(where), "vec_id", "embedding")
    q = similar.vectors(queries, "query_id", "vector")
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((v, similar.RIGHT_BLOCK), (q, similar.LEFT_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = v.withColumn("cell", F.lit(0)).withColumn("block", similar.dealt(v, blocks)).withColumn("part", every(parts))
    asked = q.withColumn("cell", F.lit(0)).withColumn("part", similar.dealt(q, parts)).withColumn("block", every(blocks))
    found = similar.blockwise(asked, there, k=k).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("doc_id"), F.round("score", 6).alias("score"))
    return top_k(found, k)


def of_hits(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose doc_id is among the hits, which are a bounded number for each query and were stored, so that the join
    knows how few they are and no text is shuffled."""
    return written(texts.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")


def spread(rows: DataFrame) -> DataFrame:
    """A few rows with much work each, over all tasks; joined small tables would leave them in one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "doc_id")


def channel(ranked: DataFrame, name: str, variant: int = 0) -> DataFrame:
    """Candidates (query_id, channel, variant, doc_id, similarity, rrf) of a ranked result."""
    return ranked.select("query_id", F.lit(name).alias("channel"), F.lit(variant).alias("variant"), "doc_id", F.col("score").alias("similarity"), (1.0 / (RRF + F.col("rank"))).alias("rrf"))


def fuse(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """R10, R11 (variants): weighted reciprocal-rank fusion; a row for each query and document."""
    weight = reduce(lambda c, kv: F.when(F.col("channel") == kv[0], kv[1]).otherwise(c), weights.items(), F.lit(1.0))
    best = [F.coalesce(F.max(F.when(F.col("channel") == c, F.col("similarity"))), F.lit(0.0)).alias(f"best_{c}") for c in weights]
    merged = candidates.groupBy("query_id", "doc_id").agg(
        F.greatest(F.max("similarity"), F.lit(0.0)).alias("similarity"), F.sum(F.col("rrf") * weight).alias("rrf"), F.countDistinct("variant").alias("variants"),
        F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"), *best,
    )
    bonus = F.least(F.lit(0.06), 0.02 * (F.col("variants") - 1))
    return merged.withColumn("fused", F.col("rrf") + sum(F.col(f"best_{c}") * w for c, w in weights.items()) + bonus)


def section_match(keywords: Column, *parts: Column) -> Column:
    """Whether a keyword stands in one of a chunk's section, path and title."""
    blob = F.lower(F.concat_ws(" ", *parts))
    return F.coalesce(F.exists(keywords, lambda k: F.contains(blob, F.lower(k))), F.lit(False))


def quality_flags(text: Column, section: Column, path: Column, keywords: Column) -> Column:
    """(section_match, sentence_complete, has_section_path, section_blob)."""
    return F.struct(
        section_match(keywords, section, path).alias("section_match"), F.coalesce(F.right(F.rtrim(text), F.lit(1)).isin(T.TERMINATORS), F.lit(False)).alias("sentence_complete"),
        (F.coalesce(path, F.lit("")) != "").alias("has_section_path"), F.lower(F.concat_ws(" ", section, path)).alias("section_blob"),
    )


def with_bonuses(fused: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """.08 more for a text that holds the query, .05 for a section that holds one of its keywords. ``texts`` has
    (doc_id, text, section), ``queries`` (query_id, query, keywords)."""
    fused = written(fused, "fused")
    j = fused.join(of_hits(fused, texts.select("doc_id", "text", "section")), "doc_id").join(queries.select("query_id", "query", "keywords"), "query_id")
    more = F.when(F.contains("text", F.col("query")), 0.08).otherwise(0.0) + F.when(section_match(F.col("keywords"), F.col("section")), 0.05).otherwise(0.0)
    return j.withColumn("fused", F.col("fused") + more).drop("text", "section", "query", "keywords")


def fan_out(k: int) -> int:
    """Candidates of each channel and variant for ``k`` results."""
    return min(50, max(16, 3 * k, 8))


def candidate_id(doc_id: Column, text: Column) -> Column:
    """The id, or the text's digest where there is none."""
    return F.coalesce(F.nullif(doc_id.cast("string"), F.lit("")), F.md5(text))


def rule_features(query: Column, text: Column) -> dict[str, Column]:
    """The features of the rule reranker."""
    own, asked = F.array_distinct(T.tokens(text)), F.array_distinct(T.tokens(query))
    pairs = F.when(F.length(query) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(query) - 1, F.lit(1))), lambda i: F.substring(query, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    n = F.length(text)
    return {
        "overlap": F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, own)) / F.size(asked)).otherwise(0.0),
        "exact": F.contains(text, query).cast("double"),
        "phrase": F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: F.contains(text, p))) / F.size(pairs)).otherwise(0.0),
        "length": 1.0 - F.least(F.abs(n - 300) / 300.0, F.lit(0.5)),
        "section": F.when(text.rlike(r"第[一二三四五六七八九十]+[编章节]|第\d+[编章节]"), 0.2).otherwise(0.0),
        "complete": F.when(F.right(F.rtrim(text), F.lit(1)).isin("。", "！", "？"), 0.1).otherwise(0.0),
        "unique": F.when(n > 0, T.distinct_chars(text) / n).otherwise(0.0),
    }


#: The weights of the rule reranker.
RULE_WEIGHTS = {"overlap": 0.25, "exact": 0.15, "phrase": 0.10, "length": 0.05, "section": 0.03, "complete": 0.01, "unique": 0.01}


def rule_score(similarity: Column, query: Column, text: Column) -> Column:
    """R13."""
    return similarity * 0.4 + sum(f * RULE_WEIGHTS[name] for name, f in rule_features(query, text).items())


def rerank_head(fused: DataFrame, texts: DataFrame, queries: DataFrame, head: int = RERANK_HEAD) -> DataFrame:
    """The first ``head`` by fused score in the order of the rules, then the rest with its fused score.

    Only the head has texts joined. ``fused`` holds a fan-out of candidates a query, so its order is over bounded rows.
    """
    placed = written(fused.withColumn("pre_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "doc_id"))), "placed")
    first = placed.where(F.col("pre_rank") <= head).select("query_id", "doc_id", "similarity")
    said = first.join(of_hits(first, texts.select("doc_id", "text")), "doc_id").join(queries.select("query_id", "query"), "query_id")
    rules = spread(said).select("query_id", "doc_id", F.round(rule_score(F.col("similarity"), F.col("query"), F.col("text")), 6).alias("rule"))
    j = placed.join(rules, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("rule", F.round("fused", 6))).drop("rule")
    w = Window.partitionBy("query_id").orderBy((F.col("pre_rank") > head).cast("int"), F.desc("score"), "doc_id")
    return j.withColumn("rank", F.row_number().over(w))


def diversify(ranked: DataFrame, texts: DataFrame, k: int, section: str = "section", cap: int = 2) -> DataFrame:
    """Of equal (section, first 180 characters) the best, at most ``cap`` of a section, then k. Blank sections have
    no cap. A duplicate goes before the section's count, and equal signatures have one section, so two windows do."""
    j = ranked.join(texts.select("doc_id", F.col(section).alias("section"), F.md5(F.substring("text", 1, 180)).alias("sig")), "doc_id")
    name = F.lower(F.trim(F.coalesce("section", F.lit(""))))
    one = j.withColumn("s", name).withColumn("r1", F.row_number().over(Window.partitionBy("query_id", "s", "sig").orderBy("rank"))).where("r1 = 1")
    two = one.withColumn("r2", F.row_number().over(Window.partitionBy("query_id", "s").orderBy("rank"))).where((F.col("r2") <= cap) | (F.col("s") == ""))
    return two.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k).select("query_id", "place", "doc_id", "section", "score")


def hyde_merge(primary: DataFrame, hyde: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of two rankings; a second one adds .6 / (61 + r), alone it gives .4 / (61 + r)."""
    a = primary.select("query_id", "doc_id", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = hyde.select("query_id", "doc_id", F.col("rank").alias("rb"))
    own = F.col("sa") + 1.0 / (RRF + F.col("ra"))
    score = F.when(F.col("ra").isNull(), 0.4 / (RRF + F.col("rb"))).when(F.col("rb").isNull(), own).otherwise(own + 0.6 / (RRF + F.col("rb")))
    return a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", score.alias("score"))


def min_max(scored: DataFrame) -> DataFrame:
    ends = scored.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return scored.join(ends, "query_id").withColumn("score", F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)).drop("low", "high")


def weighted_merge(vector: DataFrame, keyword: DataFrame, vector_weight: float) -> DataFrame:
    """Min-max of each channel, weighted and added by document."""
    a, b = min_max(vector).withColumnRenamed("score", "a"), min_max(keyword).withColumnRenamed("score", "b")
    score = F.coalesce("a", F.lit(0.0)) * vector_weight + F.coalesce("b", F.lit(0.0)) * (1 - vector_weight)
    return a.select("query_id", "doc_id", "a").join(b.select("query_id", "doc_id", "b"), ["query_id", "doc_id"], "full").select("query_id", "doc_id", score.alias("score"))


def compare_sections(hits: DataFrame) -> DataFrame:
    """(query_id, section, keyword, doc_id, score) by section: distinct keywords, documents, mean and best score."""
    g = hits.groupBy("query_id", "section").agg(F.countDistinct("keyword").alias("keywords"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("best"))
    reason = F.when(F.col("keywords") >= 2, "several keywords").when(F.col("mean") > 0.7, "high mean").when(F.col("best") > 0.85, "high best")
    return g.withColumn("reason", reason).where(F.col("reason").isNotNull())


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, id, score): children become their parent with the best score; others pass."""
    hits = written(hits, "hits")
    own = parents.join(hits.select(F.col("id").alias("child_id")).distinct(), "child_id", "left_semi")
    j = hits.join(own, F.col("id") == F.col("child_id"), "left")
    return j.groupBy("query_id", F.coalesce("parent_id", "id").alias("id")).agg(F.max("score").alias("score"))


def supplement(found: DataFrame, more: DataFrame, limit: int = 6) -> DataFrame:
    """Of further hits those whose document isn't found yet, each once, the first ``limit``."""
    new = more.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_k(new.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), limit)


def fallback(levels: list[DataFrame], least: int) -> DataFrame:
    """For each query the results of the first level that has at least ``least``; else of the last that has any."""
    all_ = reduce(DataFrame.unionByName, [lvl.select("query_id", "doc_id", "score").withColumn("level", F.lit(i)) for i, lvl in enumerate(levels)])
    n = all_.groupBy("query_id", "level").count()
    chosen = n.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("count") >= least, F.col("level"))), F.max("level")).alias("level"))
    return all_.join(chosen, ["query_id", "level"])


def within_budget(ranked: DataFrame, texts: DataFrame, budget: int = 6000, blocks: int = 4) -> DataFrame:
    """The context of each query: blocks in order of rank while their running length fits."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = ranked.join(texts.select("doc_id", "text"), "doc_id").withColumn("upto", F.sum(F.length("text")).over(w)).withColumn("nth", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = j.where((F.col("upto") <= budget) & (F.col("nth") <= blocks))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.count("*").alias("n_blocks"))


def cross_encode(pairs: DataFrame, scorer, batch: int = 32) -> DataFrame:
    """(query_id, doc_id, query, text) scored by ``scorer(list of pairs) -> list of floats``, built once a worker by
    calling it without arguments if it is a factory."""

    def run(batches):
        score = scorer() if getattr(scorer, "factory", False) else scorer
        for pdf in batches:
            both = list(zip(pdf["query"], pdf["text"], strict=True))
            pdf["score"] = [s for i in range(0, len(both), batch) for s in score(both[i : i + batch])]
            yield pdf[["query_id", "doc_id", "score"]]

    return pairs.select("query_id", "doc_id", "query", "text").mapInPandas(run, "query_id int, doc_id bigint, score double")


def cap_sections(ranked: DataFrame, k: int, cap: int = 2) -> DataFrame:
    """The first ``k`` with at most ``cap`` of a section; blank sections have no cap. ``ranked`` has (query_id, rank, section)."""
    name = F.lower(F.trim(F.coalesce("section", F.lit(""))))
    nth = ranked.withColumn("s", name).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "s").orderBy("rank"))).where((F.col("r") <= cap) | (F.col("s") == ""))
    return nth.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k).drop("r", "s")


def prepare_sources(hits: DataFrame, parents: DataFrame, texts: DataFrame, queries: DataFrame, k: int = 4, cap: int = 2) -> DataFrame:
    """What an answer is made from: children as their parents, cleaned, the first ten reranked by the rules, each id
    once, ``cap`` of a section, ``k`` in all. ``hits`` has (query_id, id, score), ``texts`` (doc_id, text, section)."""
    merged = written(expand_to_parents(hits, parents).select("query_id", F.col("id").alias("doc_id"), F.col("score").alias("similarity"), F.col("score").alias("fused")), "merged")
    # cleaned once and stored: the rules look at a text many times
    clean = written(of_hits(merged, texts).withColumn("text", T.collapse(F.col("text"))), "clean").where("text <> ''")
    ranked = rerank_head(merged.join(clean.select("doc_id"), "doc_id", "left_semi"), clean, queries)
    return cap_sections(ranked.join(clean.select("doc_id", "section"), "doc_id"), k, cap).select("query_id", "place", "doc_id", "section", "score")


def retrieve_and_rerank(scored: DataFrame, texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """3k candidates of every query at once, scored by the rules, the best ``k``."""
    best = written(top_k(scored, 3 * k), "best")
    head = best.join(of_hits(best, texts.select("doc_id", "text")), "doc_id").join(queries.select("query_id", "query"), "query_id")
    return top_k(spread(head.drop("rank")).withColumn("score", F.round(rule_score(F.col("score"), F.col("query"), F.col("text")), 6)), k).select("query_id", "rank", "doc_id", "score")


def token_overlap(index, queries: DataFrame) -> DataFrame:
    """Share of a query's distinct tokens that a document has, by the index."""
    terms = index.asked(queries, F.array_distinct(T.tokens(F.col("query"))))
    size = terms.groupBy("query_id").agg(F.count("*").alias("asked"))
    found = index.table("words").select("bucket", "term", "doc_id").join(terms, ["bucket", "term"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    return found.join(size, "query_id").select("query_id", "doc_id", (F.col("n") / F.col("asked")).alias("score"))


def with_emergency(chosen: DataFrame, queries: DataFrame, level: int) -> DataFrame:
    """Queries that no level answers get one row without a document, at ``level``."""
    none = queries.select("query_id").join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    return chosen.unionByName(none.select("query_id", F.lit(level).alias("level"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score")))


#: Retrieval tools by name: each takes (index, queries, k) and returns (query_id, doc_id, score, rank).
TOOLS = {
    "vector_search": lambda index, queries, k: index.best_tfidf(queries, k),
    "keyword_search": lambda index, queries, k: index.best_bm25(queries, k),
    "overlap_search": lambda index, queries, k: top_k(token_overlap(index, queries), k),
    "hybrid_search": lambda index, queries, k: top_k(weighted_merge(index.best_tfidf(queries, 2 * k), index.best_bm25(queries, 2 * k), 0.6), k),
}


def join_sections(sources: DataFrame, least: float = 0.15, most_parts: int = 10, most_chars: int = 5000, k: int = 3) -> DataFrame:
    """(query_id, place, doc_id, section, score, text): sources in order of similarity, put together while they are of
    one section, at most ``most_parts`` and ``most_chars``, up to a sentence's end; of equal fingerprints the first; k of a query.

    ``sources`` has (query_id, doc_id, score, text, section, finger), the hits of a query, whose number the caller bounds.
    The fold is sequential and runs over each query's own rows. Sources below ``least`` or without text are left out; a part of at most 50
    characters that ends a sentence is dropped, as are 80 that don't.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, buffer, head = [], [], None

        def flush(more_than: int) -> None:
            nonlocal buffer, head
            text = "".join(buffer)
            if len(text) > more_than:
                rows.append((*head, text))
            buffer, head = [], None

        pdf = pdf[(pdf["score"] >= least) & (pdf["text"].fillna("") != "")].sort_values(["score", "doc_id"], ascending=[False, True])
        for r in pdf.itertuples(index=False):
            own = (r.query_id, r.doc_id, r.section or "", r.score)
            if len(buffer) >= most_parts or sum(map(len, buffer)) + len(r.text) > most_chars:
                flush(80)
            if own[2] and head and own[2] != head[2]:
                if len("".join(buffer)) > 80:
                    flush(80)
                head = own
            buffer.append(r.text)
            head = head or own
            if r.text.rstrip(" ").endswith(("。", "！", "？", ".", "!", "?", "\n")):
                flush(50)
        flush(80)
        seen, out = set(), []
        for query, doc, section, score, text in rows:
            finger = "".join(c for c in text if c.isalpha())[:80]
            if finger and finger not in seen:
                seen.add(finger)
                out.append((query, len(out) + 1, doc, section, score, text))
        return pd.DataFrame(out[:k], columns=["query_id", "place", "doc_id", "section", "score", "text"])

    kind = sources.schema
    schema = f"query_id {kind['query_id'].dataType.simpleString()}, place int, doc_id {kind['doc_id'].dataType.simpleString()}, section string, score double, text string"
    return sources.groupBy("query_id").applyInPandas(run, schema)
