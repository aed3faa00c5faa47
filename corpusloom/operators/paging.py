"""K9: from the pages of documents to chunks in context, with one call.

Lines are cleaned, headings recognised and sentences cut by column functions. What is left is sequential (blocks under headings,
sentences packed with an overlap, small chunks put to the one before) and runs in a table function over one document's lines, joined
laterally, so that other columns of a document need no second join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corpusloom.functions import text as T
from corpusloom.operators import assembly, sections
from corpusloom.session import written

#: Fixed value: the section of what stands before the first heading.
OPENING = "文档概览"
#: Characters of a heading at most.
HEADING = 50
CHUNK = "chunk_no int, title string, section string, path string, level int, page_from int, page_to int, text string"


def pack(parts: list[str], size: int, least: int, overlap: int) -> list[str]:
    """K7: sentences in chunks of at most ``size`` characters and at least ``least``; a rest below ``least`` goes to the last. The next
    chunk starts as many sentences back as are needed for ``overlap`` characters, but after the first of this one."""
    out, at = [], 0
    while at < len(parts):
        start, held = at, 0
        while at < len(parts) and (at == start or held + len(parts[at]) <= size or held < least):
            held += len(parts[at])
            at += 1
        if 0 < sum(map(len, parts[at:])) < least:
            at = len(parts)
        text = "".join(parts[start:at]).strip()
        if not text:
            break
        out.append(text)
        if at >= len(parts):
            break
        back, shared = at, 0
        while back > start and shared < overlap:
            back -= 1
            shared += len(parts[back])
        at = max(back, start + 1)
    return out


class Chunks:
    """Chunks of one document's lines (page, level, line, parts) in order."""

    def eval(self, lines: list, size: int, least: int, overlap: int) -> Iterator[tuple]:
        out: list[list] = []
        for title, level, path, first, last, parts in blocks(lines or [], least):
            for text in pack(parts, size, least, overlap):
                if out and out[-1][1] == path[-1] and len(out[-1][6]) < least:
                    out[-1][6] = f"{out[-1][6]} {text}".strip()
                    out[-1][5] = last
                else:
                    out.append([title, path[-1], " > ".join(path), level, first, last, text])
        for nth, row in enumerate(out):
            yield (nth, *row)


def blocks(lines: list, least: int) -> Iterator[tuple]:
    """K6: (title, level, path, first page, last page, sentences) of what stands under each heading; fewer than half of ``least`` characters go."""
    title, level, stack = OPENING, 0, []
    first = last = lines[0]["page"] if lines else 1
    held: list = []

    def whole() -> Iterator[tuple]:
        if held and len("\n".join(x["line"] for x in held).strip()) >= least // 2:
            yield title, level, list(stack) or [title], first, last, [p for x in held for p in x["parts"]]

    for row in lines:
        if row["level"] is not None:
            yield from whole()
            title, level = row["line"], row["level"]
            stack = [*stack[: max(level - 1, 0)], title]
            first, last, held = row["page"], row["page"], []
            continue
        if not held:
            first = row["page"]
        last = row["page"]
        held.append(row)
    yield from whole()


def chunk_pages(lines: DataFrame, titles: DataFrame | None = None, size: int = 680, least: int = 180, overlap: int = 120, script: str = "cjk", heading: Column | None = None, hints: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_no, title, section, path, level, page_from, page_to, text, prefix) of lines (doc_id, pos, page, line).

    ``heading`` is the level of a line that is one, null for others; without it the usual patterns. ``titles`` (doc_id, title) names the
    documents in the prefix, which joins the document's title and summary, the section's path and the pages. Documents without
    a usable line have no row. A document's lines are in one task, others' need not be.
    """
    spark = lines.sparkSession
    clean = sections.chunk_lines(lines, script, hints)
    level = (T.heading_level(F.col("line")) if heading is None else heading)
    marked = clean.withColumn("level", F.when(F.length("line") <= HEADING, level)).withColumn("parts", T.sentences(F.col("line"), 12))
    docs = marked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "page", "level", "line", "parts"))).alias("rows"))
    docs = docs.select("doc_id", F.transform("rows", lambda x: F.struct(x["page"].cast("int").alias("page"), x["level"].cast("int").alias("level"), x["line"].alias("line"), x["parts"].alias("parts"))).alias("rows"))
    spark.udtf.register("page_chunks", udtf(Chunks, returnType=CHUNK))
    chunks = spark.sql(f"select d.doc_id, c.* from {{docs}} d, lateral page_chunks(d.rows, {int(size)}, {int(least)}, {int(overlap)}) c", docs=docs)
    chunks = written(chunks, "chunks")  # read for the summaries and for what is returned; cut once
    summary = assembly.document_summary(chunks.select("doc_id", F.col("chunk_no").alias("ord"), "title", "text"))
    named = chunks.join(summary, "doc_id", "left")
    title = F.lit(None).cast("string")
    if titles is not None:
        named, title = named.join(titles.select("doc_id", F.col("title").alias("name")), "doc_id", "left"), F.col("name")
    said = F.nullif(F.concat_ws("；", F.nullif(F.col("titles"), F.lit("")), F.nullif(F.col("keywords"), F.lit(""))), F.lit(""))
    prefix = sections.contextual_prefix(title, said, F.col("path"), F.col("page_from"), F.col("page_to"))
    return named.select("doc_id", "chunk_no", "title", "section", "path", "level", "page_from", "page_to", "text", prefix.alias("prefix"))
