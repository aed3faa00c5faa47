"""Sources and sinks. Files are reached through Spark's readers and writers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import sections


def discover(spark: SparkSession, path: str, pattern: str = "*.{pdf,docx,doc}", exclude: str | None = None) -> DataFrame:
    """(path, name, length, content) of the files under ``path``, by name; content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files if exclude is None else files.where(~F.col("name").rlike(exclude))


def page_lines(files: DataFrame, parse) -> DataFrame:
    """(path, page, line_no, line) of files, by ``parse(bytes) -> list of lists of lines``; a parser that needs a
    library is given by the caller. Empty pages give no row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i + 1, n, line) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for i, page in enumerate(parse(bytes(raw))) for n, line in enumerate(page)]
            yield pd.DataFrame(rows, columns=["path", "page", "line_no", "line"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, line_no int, line string")


def clean_page_lines(lines: DataFrame) -> DataFrame:
    """(path, page, line_no, line) without blank lines, noise and lines of a table of contents; pages without a line go."""
    line = T.corpus_line(F.col("line"))
    return lines.withColumn("line", line).where((F.col("line") != "") & ~T.corpus_noise(F.col("line")) & ~T.toc_line(F.col("line")))


def table_row(cells: Column) -> Column:
    """S3: a table's row as a line: its distinct cells that aren't blank, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")), " | ")


def synthetic_pages(lines: DataFrame, key: str, order: str, size: int = 45) -> DataFrame:
    """S3: lines of files that have no pages, with ``page``: the first ``size`` lines of a file are page 1, and so on."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("page", (F.floor((nth - 1) / size) + 1).cast("int"))


def combined(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files under a banner with their name."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", F.concat(F.lit("===== "), name, F.lit(" =====\n"), "value").alias("text"))


def knowledge_base(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """The chunks of JSON files {metadata, chunks}, a byte-order mark ignored, short ones dropped."""
    chunks = spark.read.option("multiLine", "true").json(path).select(F.explode("chunks").alias("c")).select("c.*")
    return normalised(chunks, least)


def or_default(c: Column, default: str) -> Column:
    """The text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def normalised(chunks: DataFrame, least: int = 40) -> DataFrame:
    """Chunks of at least ``least`` characters, with their section and length filled in."""
    rest = [c for c in chunks.columns if c not in ("text", "section", "char_count")]
    return chunks.where(F.length("text") >= least).select(*rest, or_default(F.col("section"), "unknown").alias("section"), F.length("text").alias("char_count"))


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each table as a folder of files."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def top_keywords(chunks: DataFrame, n: int = 100) -> DataFrame:
    """(term, n): the corpus's most frequent tokens of two characters or more."""
    terms = chunks.select(F.explode(T.tokens(F.col("text"))).alias("term")).where(F.length("term") >= 2)
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def write_knowledge_base(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, and beside them their number and the top keywords as metadata."""
    chunks.write.mode("overwrite").json(f"{path}/chunks")
    words = top_keywords(chunks).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "term"))), lambda x: x["term"]).alias("keywords"))
    chunks.agg(F.count("*").alias("total_chunks"), F.round(F.avg(F.length("text")), 1).alias("mean_length")).crossJoin(words).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def rebuild(docs: DataFrame, path: str, size: int = 680, least: int = 180, overlap: int = 120) -> DataFrame:
    """The knowledge base under ``path`` made anew from whole texts (doc_id, text); returns its report: documents,
    chunks, and chunks that are short, medium and long."""
    chunks = sections.chunk_documents(docs, size, least, overlap).select(F.concat_ws("-", "doc_id", "chunk_no").alias("id"), "doc_id", F.col("chunk").alias("text"), F.length("chunk").alias("char_count"))
    write_knowledge_base(chunks, path)
    stored = docs.sparkSession.read.schema(chunks.schema).json(f"{path}/chunks")
    n = F.col("char_count")
    return stored.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count_if(n < 120).alias("short"), F.count_if((n >= 120) & (n <= 300)).alias("medium"), F.count_if(n > 300).alias("long"))


def markdown(report: DataFrame, title: str, most: int = 1000) -> str:
    """An aggregate of at most ``most`` rows as a Markdown table. A larger one is refused, not cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def load_vectors(rows: DataFrame, sink, size: int = 200) -> None:
    """Hand rows to ``sink(list of dicts)`` in batches of ``size``, from the executors. Empty lists become null."""

    def send(part):
        batch = []
        for row in part:
            batch.append({k: (None if v == [] else v) for k, v in row.asDict().items()})
            if len(batch) == size:
                sink(batch)
                batch = []
        if batch:
            sink(batch)

    rows.foreachPartition(send)
