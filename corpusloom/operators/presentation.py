"""What is shown of results: display blocks and excerpts (T10, T11), traces of a loop (A15, X12), whole pipelines as one call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assembly
from corpusloom.operators import retrieval as R
from corpusloom.session import written

#: Marks that end a shown sentence, what is cut from its end, and numbered aims that are cut out of it.
ENDS, TAIL, AIMS = ("。", "！", "？"), "，、；：,. ", ["毕业要求", "培养目标"]


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def finalised(c: Column, script: str = "cjk", hints: list[str] | None = None) -> Column:
    """A sentence as it is shown: its line normalised, what a table's words begin cut off, numbered aims cut out, ended by a full
    stop. Empty for one under 10 characters or 6 letters of the script, for noise and for rows of a table."""
    line = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.translate(x, "　", " "), r"\s+", " ")), r"^[ |\t]+|[ |\t]+$", "")
    out = line(c)
    for word in T.TABLE_HINTS if hints is None else hints:
        out = F.trim(F.substring_index(out, word, 1))
    for word in AIMS:
        out = F.regexp_replace(out, rf"{word}\d+", "")

    def ended(x: Column) -> Column:
        many = reduce(lambda a, w: a | (T.occurrences(x, w) >= 3), AIMS, F.lit(False))
        bad = (F.length(x) < 10) | many | T.noise_line(x, script) | (T.matrix_row(x, script) if hints is None else F.lit(False)) | (T.count(x, T.SCRIPT[script]) < 6)
        said = T.without_prefix(F.regexp_replace(x, rf"[{TAIL}]+$", ""))
        return F.when(bad, "").otherwise(let(said, lambda y: F.when((y == "") | F.right(y, F.lit(1)).isin(*ENDS), y).otherwise(F.concat(y, F.lit("。")))))

    return let(line(out), ended)


def display_blocks(fragments: Column, most_chars: int, blocks: int, block_chars: int, each: int, script: str = "cjk", hints: list[str] | None = None) -> Column:
    """Fragments in at most ``blocks`` blocks of ``each`` fragments and ``block_chars`` characters, a blank line between them, cut at a
    boundary beyond ``most_chars``. A single fragment may be longer than a block."""
    parts = F.filter(F.transform(fragments, lambda x: finalised(x, script, hints)), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (a["now"] != "") & ((F.length(a["now"]) + F.length(x) > block_chars) | (a["n"] >= each))
        moved = F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), x.alias("now"), F.lit(1).alias("n"))
        grown = F.struct(a["done"].alias("done"), F.concat(a["now"], x).alias("now"), (a["n"] + 1).alias("n"))
        return F.when(F.size(a["done"]) >= blocks, a).otherwise(F.when(full, moved).otherwise(grown))

    whole = lambda end: F.array_join(F.when((end["now"] != "") & (F.size(end["done"]) < blocks), F.concat(end["done"], F.array(end["now"]))).otherwise(end["done"]), "\n\n")
    stop = lambda short, text: F.when(short == "", F.substring(text, 1, most_chars)).otherwise(F.when(F.right(short, F.lit(1)).isin(*ENDS), short).otherwise(F.concat(short, F.lit("。"))))
    cut = lambda text: F.when(F.length(text) <= most_chars, text).otherwise(let(T.truncate_at_boundary(text, most_chars), lambda short: stop(short, text)))
    return let(let(F.aggregate(parts, start, step), whole), cut)


def key_lines(c: Column, n: int, keys: Column | None = None) -> Column:
    """The key sentences; without any, the lines that aren't blank. ``keys`` are at least ``n`` key sentences that are known already."""
    return let(T.key_sentences(c, n) if keys is None else F.slice(keys, 1, n), lambda own: F.when(F.size(own) > 0, own).otherwise(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")))


def display(c: Column, most_chars: int = 320, script: str = "cjk", hints: list[str] | None = None, keys: Column | None = None) -> Column:
    """A cleaned text as two blocks of up to 88 characters."""
    return display_blocks(key_lines(c, 4, keys), most_chars, 2, 88, 2, script, hints)


def query_display(c: Column, keywords: Column, most_chars: int = 320, script: str = "cjk", hints: list[str] | None = None, keys: Column | None = None) -> Column:
    """The first four of eight key sentences that hold a keyword of two characters or more; without any, as ``display``."""
    words = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: F.length(k) >= 2)
    hit = F.slice(F.filter(T.key_sentences(c, 8) if keys is None else F.slice(keys, 1, 8), lambda s: F.exists(words, lambda k: F.contains(s, k))), 1, 4)
    return let(hit, lambda own: F.when(F.size(own) > 0, display_blocks(own, most_chars, 2, 96, 2, script, hints)).otherwise(display(c, most_chars, script, hints, keys)))


def source_excerpt(c: Column, most_chars: int = 220, sentences: int = 3, script: str = "cjk", hints: list[str] | None = None, keys: Column | None = None) -> Column:
    """The excerpt of a source's card: blocks of up to 72 characters."""
    return display_blocks(key_lines(c, sentences, keys), most_chars, 2, 72, 2, script, hints)


def answer_markdown(sentences: Column, script: str = "cjk", hints: list[str] | None = None) -> Column:
    """Sentences as a list of bullets."""
    return F.array_join(F.transform(F.filter(F.transform(sentences, lambda s: finalised(s, script, hints)), lambda s: s != ""), lambda s: F.concat(F.lit("- "), s)), "\n")


def decision_trees(history: DataFrame, enough: float = 0.7) -> DataFrame:
    """(query_id, series, tree) of an agent's history: the confidence of each round, and the rounds as a tree of what was thought,
    decided, done and seen. ``history`` has (query_id, iteration, kind, strategy, results, confidence, refined)."""
    g = history.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("iteration", "kind", "strategy", "results", "confidence", "refined"))).alias("l"))
    percent = lambda c: F.format_string("%.1f%%", c * 100)

    def node(x: Column, i: Column) -> Column:
        last = i == F.size("l") - 1
        head, side = F.when(last, "└─").otherwise("├─"), F.when(last, "  ").otherwise("│ ")
        line = lambda *parts: F.concat(side, F.lit("  "), *(F.lit(p) if isinstance(p, str) else p for p in parts))
        rows = F.array(
            F.concat(head, F.lit(" 迭代"), x["iteration"].cast("string"), F.lit(" ["), F.when(x["confidence"] >= enough, "✓").otherwise("→"), F.lit("]")),
            line("├─ Think: ", x["kind"]), line("├─ Decide: ", x["strategy"]), line("├─ Act: ", x["results"].cast("string"), "个结果"), line("└─ Observe: 置信度", percent(x["confidence"])),
            F.when((F.coalesce(x["refined"], F.lit("")) != "") & ~last, line("   └─ 改进查询")))
        return F.array_join(rows, "\n")

    bars = F.transform("l", lambda x: F.concat(F.repeat(F.lit("█"), F.floor(x["confidence"] * 20).cast("int")), F.lit(" "), F.format_string("%.2f%%", x["confidence"] * 100)))
    tree = F.concat_ws("\n", F.lit("决策树:"), F.lit("┌─ 开始"), F.array_join(F.transform("l", node), "\n"), F.lit("└─ 结束"))
    return g.select("query_id", F.array_join(bars, "\n").alias("series"), tree.alias("tree"))


def split_durations(steps: DataFrame, totals: DataFrame, least: int = 4) -> DataFrame:
    """(run_id, ord, name, milliseconds): a run's time in equal parts over its steps (run_id, ord, name); a run of fewer than ``least``
    steps is one default step with all of it. ``totals`` has (run_id, seconds); runs without a total have no row."""
    n = steps.groupBy("run_id").agg(F.count("*").alias("n"))
    runs = totals.join(n, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = runs.where(F.col("n") >= least).join(steps, "run_id").select("run_id", "ord", "name", (F.col("seconds") * 1000 / F.col("n")).alias("milliseconds"))
    return whole.unionByName(runs.where(F.col("n") < least).select("run_id", F.lit(1).alias("ord"), F.lit("默认推理").alias("name"), (F.col("seconds") * 1000).alias("milliseconds")))


def cross_pipeline(queries: DataFrame, search, texts: DataFrame, k: int = 5, keep: int = 10, heads: int = 3) -> tuple[DataFrame, DataFrame]:
    """Keyword searches of each query, their sections compared, and the documents united.

    ``search`` takes (query_id, query) and gives (query_id, doc_id, score, rank). Returns documents (query_id, place, doc_id, keyword,
    score), each once, in the order of keywords and ranks, the first ``keep``; and a summary (query_id, searches, found, sections) with
    the first ``heads`` sections by keywords, documents and mean score.
    """
    words = queries.select("query_id", F.posexplode(T.first_keywords(F.col("query"))).alias("at", "keyword"))
    asked = words.select(F.to_json(F.struct("query_id", "at")).alias("search"), "query_id", "at", "keyword")
    hits = written(search(asked.select(F.col("search").alias("query_id"), F.col("keyword").alias("query"))).where(F.col("rank") <= k).withColumnRenamed("query_id", "search"), "hits")
    j = written(hits.join(asked, "search").join(R.of_hits(hits, texts.select("doc_id", "section")), "doc_id"), "found")
    first = j.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("at", "rank"))).where("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "rank"))  # k rows a keyword
    docs = first.withColumn("place", place).where(F.col("place") <= keep).select("query_id", "place", "doc_id", "keyword", "score")
    compared = R.compare_sections(j.select("query_id", "section", "keyword", "doc_id", "score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("keywords"), F.desc("docs"), F.desc("mean"), "section"))
    lines = compared.withColumn("o", order).where(F.col("o") <= heads).withColumn("line", F.format_string("%s（关键词 %d，文档 %d，%s）", "section", "keywords", "docs", "reason"))
    sections = lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("sections"))
    counts = words.groupBy("query_id").agg(F.count("*").alias("searches")).join(j.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left")
    return docs, counts.join(sections, "query_id", "left").select("query_id", "searches", F.coalesce("found", F.lit(0)).alias("found"), "sections")


def answers(queries: DataFrame, search, texts: DataFrame, agent: str, k: int = 10, written_by: DataFrame | None = None, kind: Column | None = None) -> DataFrame:
    """The first pipeline as one call: (query_id, response, sources, context_used, used_model).

    Candidates of ``search`` are reranked by the rules, neighbours of a section joined, a response filled from their sentences; a row of
    ``written_by`` (query_id, response) that isn't blank takes its place, as a language model's answer would. ``texts`` has (doc_id, text, section).
    Queries that find nothing get the fallback and no source.
    """
    found = written(search(queries.select("query_id", "query")).select("query_id", "doc_id", "score"), "found")
    clean = written(R.of_hits(found, texts).withColumn("text", T.collapse(F.col("text"))), "clean")  # once: the rules look at a text many times
    head = written(R.retrieve_and_rerank(found, clean, queries, k), "head")
    merged = R.join_sections(head.join(clean.select("doc_id", "text", "section"), "doc_id").select("query_id", "doc_id", "score", "text", "section"))
    points = assembly.evidence(merged.select("query_id", F.col("place").alias("rank"), "text"))
    own = assembly.themed_responses(queries.select("query_id", "query"), points, agent, kind)
    used = merged.groupBy("query_id").agg(F.count("*").alias("sources"))
    j = own.join(used, "query_id", "left")
    model = F.lit(None).cast("string")
    if written_by is not None:
        j, model = j.join(written_by.select("query_id", F.col("response").alias("model")), "query_id", "left"), F.nullif(F.trim("model"), F.lit(""))
    return j.select("query_id", F.coalesce(model, "response").alias("response"), F.coalesce("sources", F.lit(0)).alias("sources"), (F.coalesce("sources", F.lit(0)) > 0).alias("context_used"), model.isNotNull().alias("used_model"))
