"""What the operators of this subpackage share: tables, scratch tables, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir

#: ASCII white space: a word is a maximal run of anything else.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read only through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, after which the worker gives freed memory back: it stays for other tasks, beside other workers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def lean(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, after a limit on the rows that go to a Python worker at once: texts are long, and a worker's memory is small."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return docs


#: Scratch tables of this process that are still there.
SCRATCH: list[str] = []
#: When shuffles were last released.
released = 0.0


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage with files that every executor can read, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SCRATCH.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table by its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in SCRATCH:
        SCRATCH.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let go of the shuffle files of finished jobs."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)
    release(tables[0].sparkSession)


def release(spark: SparkSession, seconds: float = 5.0) -> None:
    """Let the executors delete the shuffle files that no plan refers to any more; at most once in so many seconds."""
    global released
    if time.monotonic() - released >= seconds:
        gc.collect()
        spark._jvm.System.gc()
        released = time.monotonic()


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables that were written after the first ``since`` of SCRATCH. What was read from them must be written elsewhere by then."""
    for path in SCRATCH[since:]:
        remove(spark, path)


def words_of(text: str | None) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none if it is null."""
    if not text:
        return []
    for white in "\t\n\x0b\x0c\r":
        if white in text:
            text = text.replace(white, " ")
    return [word for word in text.split(" ") if word]


def batches_out(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """An Arrow batch of Python lists or arrays, in the order of the schema."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f in schema for c in [columns[f.name]]], schema=schema
    )


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one piece holds about ``most_bytes`` of a string column, or one row that is longer."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        if batch.column(column).nbytes <= most_bytes:
            yield batch
            continue
        sizes = [len(x) if x is not None else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()]
        held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def in_pieces(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, at, text, piece): rows with the range of ids they belong to, and the number of pieces to deal.

    ``at`` is the id, or the least integer for null. The borders are quantiles of the ids, so pieces hold about as many
    rows each, and a row finds its piece by binary search. Rows with equal ids are in one piece; higher pieces have higher
    ids.
    """
    from pyspark.ml.feature import Bucketizer

    base = lean(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("at"), F.col(text_col).alias("text")).withColumn("place", F.col("at").cast("double"))
    pieces = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted(set(base.select("place").stat.approxQuantile("place", [i / pieces for i in range(1, pieces)], 0.25 / pieces))) or [0.0]
    dealt = Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol="place", outputCol="bucket").transform(base)
    return dealt.select("id", "at", "text", F.col("bucket").cast("int").alias("piece")), pieces
