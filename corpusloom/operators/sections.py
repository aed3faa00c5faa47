"""Page furniture, sections, chunks and their quality: document-local work, one shuffle by document at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text as T


def marked_lines(pages: DataFrame, doc: str = "source", order: str = "doc_id") -> DataFrame:
    """C4: (doc, page, pos, n, line, header, footer) of documents whose pages are the rows in ``order``.

    A line among the first (last) two of a page is a header (footer) if it stands there at least twice, or on every page
    where there are fewer than three. Lines are found by an aggregate joined back; a header is not counted as a footer.
    """
    lines = pages.select(F.col(doc).alias("doc"), F.col(order).alias("page"), F.split("text", "\n").alias("l")).withColumn("n", F.size("l")).select("doc", "page", "n", F.posexplode("l").alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    number = pages.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("pages"))
    least = F.when(F.col("pages") >= 3, 2).otherwise(F.col("pages"))

    def repeated(where: Column, name: str) -> DataFrame:
        found = lines.where(where & (F.length("line") >= 4)).groupBy("doc", "line").agg(F.count("*").alias("c"))
        return found.join(number, "doc").where(F.col("c") >= least).select("doc", "line", F.lit(True).alias(name))

    top, bottom = F.col("pos") < 2, F.col("pos") >= F.col("n") - 2
    marked = lines.join(repeated(top, "head"), ["doc", "line"], "left").join(repeated(bottom, "foot"), ["doc", "line"], "left")
    header = top & F.coalesce("head", F.lit(False))
    return marked.select("doc", "page", "pos", "n", "line", header.alias("header"), (~header & bottom & F.coalesce("foot", F.lit(False))).alias("footer"))


def furniture(pages: DataFrame, doc: str = "source", order: str = "doc_id") -> DataFrame:
    """C4: lines, headers and footers of each document."""
    marked = marked_lines(pages, doc, order)
    return marked.groupBy(F.col("doc").alias(doc)).agg(F.count("*").alias("n_lines"), F.count_if("header").alias("n_header"), F.count_if("footer").alias("n_footer"))


def clean_pages(pages: DataFrame, doc: str = "source", order: str = "doc_id") -> DataFrame:
    """(doc, page, text, n_furniture, n_toc, n_noise): every page without blank lines, headers and footers, lines of a
    table of contents and noise; a line counts for the first of these that it is. Pages that keep no line have no row."""
    reason = F.when(F.col("line") == "", "blank").when(F.col("header") | F.col("footer"), "furniture").when(T.toc_line(F.col("line")), "toc").when(T.page_noise(F.col("line")), "noise").otherwise("")
    r = marked_lines(pages, doc, order).withColumn("reason", reason)
    kept = F.sort_array(F.collect_list(F.when(F.col("reason") == "", F.struct("pos", "line"))))
    g = r.groupBy("doc", "page").agg(kept.alias("kept"), *(F.count_if(F.col("reason") == x).alias(f"n_{x}") for x in ("furniture", "toc", "noise")))
    return g.where(F.size("kept") > 0).select("doc", "page", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("text"), "n_furniture", "n_toc", "n_noise")


def chunk_lines(lines: DataFrame, script: str = "cjk", hints: list[str] | None = None) -> DataFrame:
    """K5: (doc_id, pos, page, line): lines trimmed and collapsed; a number of up to three digits that a letter of the script
    follows is the page; blank lines, bare numbers, dot leaders, tables and rows of marks go. ``lines`` has (doc_id, pos,
    page, line)."""
    letter = T.SCRIPT[script]
    raw = F.trim(F.translate("line", "　", " "))
    number = F.regexp_extract(raw, rf"^(\d{{1,3}}){letter}", 1)
    text = T.collapse(F.regexp_replace(raw, rf"^\d{{1,3}}(?={letter})", ""))
    marks = T.occurrences(F.col("line"), "√"), T.occurrences(F.col("line"), "✓")
    noise = (
        (F.col("line") == "") | F.col("line").rlike(r"^\d{1,3}$") | (T.occurrences(F.col("line"), "…") >= 3) | (T.occurrences(F.col("line"), ".") >= 10) | T.contains_any(F.col("line"), T.TABLE_HINTS if hints is None else hints)
        | (marks[0] >= 2) | (marks[1] >= 2) | (F.col("line").contains("|") & (T.count(F.col("line"), letter) < 8))
    )
    # exploded, as a plain column would be put in place of each "line" of the filter and found anew there
    out = lines.select("doc_id", "pos", F.when(number != "", number.cast("int")).otherwise(F.col("page")).alias("page"), F.explode(F.array(text)).alias("line"))
    return out.where(~noise)


def section_paths(headings: DataFrame) -> DataFrame:
    """K1: (doc_id, pos, path): of each heading (doc_id, pos, level, title, root) the titles it stands under, joined by `` > ``.

    A heading of level n keeps the root and the first n - 1 titles of the path before it. Each path needs the one before,
    so it is a fold over a document's headings, over Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def folded(column: pd.Series) -> pd.Series:
        def fold(rows):
            stack, out = [], []
            for r in rows:
                stack = ([r["root"]] if not stack else stack[:1]) + stack[1 : r["level"]] + [r["title"]]
                out.append(" > ".join(stack))
            return out

        return column.map(fold)

    g = headings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "level", "title", "root"))).alias("l"))
    return g.select("doc_id", "l", folded("l").alias("paths")).select("doc_id", F.explode(F.arrays_zip(F.transform("l", lambda x: x["pos"]).alias("pos"), F.col("paths").alias("path"))).alias("x")).select("doc_id", "x.pos", "x.path")


def merge_small(chunks: DataFrame, least: int = 180) -> DataFrame:
    """K8: (doc_id, chunk_no, section, text): a chunk is put to the one before while that is of the same section and shorter
    than ``least``. ``chunks`` has (doc_id, ord, section, text). A fold over a document's chunks, over Arrow batches."""

    @F.pandas_udf("array<struct<section:string,text:string>>")
    def folded(column: pd.Series) -> pd.Series:
        def fold(rows):
            out: list[dict] = []
            for r in rows:
                if out and out[-1]["section"] == r["section"] and len(out[-1]["text"]) < least:
                    out[-1]["text"] = f"{out[-1]['text']} {r['text']}".strip()
                else:
                    out.append({"section": r["section"], "text": r["text"]})
            return out

        return column.map(fold)

    g = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section", "text"))).alias("l"))
    return g.select("doc_id", F.posexplode(folded("l")).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.section", "c.text")


def sections(lines: DataFrame, heading: Column, least: int = 0) -> DataFrame:
    """K1, K2, K6: (doc_id, section_no, title, n_lines, n_chars, body) by gaps and islands.

    ``lines`` has (doc_id, pos, line). A heading opens a section; lines before the first heading are section 0. Sections
    without lines of their own, or of fewer than ``least`` / 2 characters, are dropped.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("is_heading", heading).withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(w))
    body = F.when(~F.col("is_heading"), F.struct("pos", "line"))
    out = marked.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("is_heading"), F.col("line"))).alias("title"), F.sort_array(F.collect_list(body)).alias("body"))
    out = out.where(F.size("body") > 0).withColumn("body", F.transform("body", lambda x: x["line"]))
    out = out.select("doc_id", "section_no", "title", F.size("body").alias("n_lines"), F.aggregate("body", F.lit(0), lambda a, x: a + F.length(x)).alias("n_chars"), "body")
    return out.where(F.col("n_chars") >= least / 2)


def fixed_windows(docs: DataFrame, size: int = 680, overlap: int = 120) -> DataFrame:
    """K7, the companion that SQL can say: windows of ``size`` characters that overlap."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(step)).cast("int"), F.lit(1))
    parts = docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last - 1)).alias("chunk_no"))
    return parts.select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def pack_sentences(sentences: list[str], size: int, least: int, overlap: int) -> list[str]:
    """K7: sentences packed to ``size`` characters, at least ``least``. The next chunk starts as many sentences back as make up
    ``overlap`` characters, but after the first sentence of this one."""
    from corpusloom.operators.paging import pack

    return pack(sentences, size, least, overlap)


def chunk_documents(docs: DataFrame, size: int = 680, least: int = 180, overlap: int = 120) -> DataFrame:
    """K7-K9: (doc_id, chunk_no, chunk) of whole sentences. The fold over sentences is sequential, so it runs per Arrow
    batch in Python; documents stay where they are."""
    split = docs.select("doc_id", T.sentences(F.col("text"), 1).alias("sentences"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, c) for d, s in zip(pdf["doc_id"], pdf["sentences"], strict=True) for i, c in enumerate(pack_sentences(list(s) if s is not None else [], size, least, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk"])

    return split.mapInPandas(run, "doc_id bigint, chunk_no int, chunk string")


def split_children(text: str, size: int, overlap: int, least: int, marks: str = "。！？；\n.!?; ") -> list[str]:
    """Children of about ``size`` characters that end at the best mark in their second half; a short tail is merged."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            end = next((cut + 1 for m in marks if (cut := text.rfind(m, at + size // 2, end)) > 0), end)
        if len(text) - end < least:
            end = len(text)
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


#: Parents that a task cuts at once.
PARENTS = 64


def children(chunks: DataFrame, size: int = 250, overlap: int = 50, least: int = 80) -> DataFrame:
    """(parent_id, ord, text) from (parent_id, text)."""

    kind = chunks.schema["parent_id"].dataType
    own = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARENTS):
                part = batch.slice(at, PARENTS)
                pieces = [split_children(t or "", size, overlap, least) for t in part.column("text").to_pylist()]
                each = np.array([len(p) for p in pieces], dtype=np.int64)
                parents = part.column("parent_id").take(pa.array(np.repeat(np.arange(len(each)), each)))
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                yield pa.RecordBatch.from_arrays([parents.cast(own), pa.array(nth, pa.int32()), pa.array([c for p in pieces for c in p], pa.string())], names=["parent_id", "ord", "text"])
            pa.default_memory_pool().release_unused()

    return chunks.select("parent_id", "text").mapInArrow(run, f"parent_id {kind.simpleString()}, ord int, text string")


def contextual_prefix(title: Column, summary: Column, path: Column, page_from: Column, page_to: Column) -> Column:
    """What is known of a chunk's place, joined; parts that are null are left out."""
    pages = F.when(page_from == page_to, F.concat(F.lit("页 "), page_from.cast("string"))).otherwise(F.concat(F.lit("页 "), page_from.cast("string"), F.lit("-"), page_to.cast("string")))
    return F.concat_ws("；", title, summary, path, pages)


def assess(chunks: DataFrame, script: str = "cjk") -> DataFrame:
    """Score, status and flags of (doc_id, ord, text, section_path). Equal texts of a document after the first are duplicates."""
    c = F.trim(F.coalesce("text", F.lit("")))
    nth = F.row_number().over(Window.partitionBy("doc_id", F.md5(c)).orderBy("ord"))
    rules = [
        ("empty_chunk", c == "", 1.0), ("too_short", F.length(c) < 18, 0.45), ("heading_only", c.rlike(T.HEADING_ONLY), 0.55), ("ocr_noise", c.rlike(T.OCR_NOISE), 0.25),
        ("incomplete_sentence", ~F.coalesce(F.right(c, F.lit(1)).isin(T.TERMINATORS), F.lit(False)), 0.10), ("missing_section_path", F.coalesce("section_path", F.lit("")) == "", 0.15),
        ("duplicate_content", (F.col("nth") > 1) & (c != ""), 0.9), ("low_script_ratio", (c != "") & (T.count(c, T.SCRIPT[script]) / F.greatest(F.length(c), F.lit(1)) < 0.10), 0.20),
    ]
    flags = F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit, _ in rules)), lambda x: x.isNotNull())
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - sum(F.when(hit, F.lit(loss)).otherwise(0.0) for _, hit, loss in rules)))
    out = chunks.withColumn("nth", nth).withColumn("flags", flags).withColumn("raw", score)
    fatal = F.arrays_overlap("flags", F.array(*(F.lit(x) for x in ("empty_chunk", "heading_only", "duplicate_content"))))
    status = F.when(fatal | (F.col("raw") < 0.35), "reject").when(F.size("flags") > 0, "warn").otherwise("pass")
    return out.select("doc_id", "ord", F.round("raw", 3).alias("score"), status.alias("status"), F.array_join("flags", ",").alias("flags"))


def bloom_level(c: Column, levels: dict[str, list[str]], default: str) -> Column:
    """The level with the most keywords in the text; of equal ones the earlier; the default without any."""
    scored = [F.struct(sum(F.contains(c, F.lit(k)).cast("int") for k in words).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("level")) for i, (name, words) in enumerate(levels.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["level"]).otherwise(default)


#: Verbs that tell the cognitive level.
BLOOM = {
    "记忆": ["了解", "知道", "识别", "列举", "描述", "定义"], "理解": ["理解", "解释", "说明", "概括", "区分", "比较"], "应用": ["应用", "使用", "实现", "运用", "操作", "实践", "编程", "代码"],
    "分析": ["分析", "推理", "诊断", "区别", "检查", "对比", "评估"], "评价": ["评价", "判断", "论证", "优化", "改进"], "创造": ["设计", "构建", "创新", "规划", "综合", "开发"],
}


def search_text(title: Column, section: Column, text: Column) -> Column:
    """The header twice, then the text, so that its terms weigh double."""
    header = F.concat_ws(" ", title, section)
    return F.concat_ws(" ", header, header, text)
