"""Structured Streaming operators, each with a batch twin: the same function takes a streaming or a static table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.maintenance import changes, update_index


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """ST1: (event_type, start, n, total) by window; a stream forgets windows that are ``late`` past."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy("event_type", window.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessionised(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """ST2: (user_id, start, n): runs of a user's events without a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(docs: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """ST4: the first of equal texts within the watermark."""
    hashed = docs.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"]) if docs.isStreaming else hashed.dropDuplicates(["content_hash"])


def last_values(events: DataFrame, n: int = 10, ttl_seconds: float | None = None) -> DataFrame:
    """ST3: (user_id, n, total) over the last ``n`` values of each user by time, as state that every micro-batch updates.

    Events of a micro-batch count in the order of time, in whichever Arrow batches they come; one that is older than what
    the state holds takes its place in it. With a ttl values that old, measured from the user's newest, no longer count.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:  # never more than n are held beside a batch
            kept = sorted([*kept, *zip(pdf["ts"].map(lambda t: t.timestamp()), pdf["value"], strict=True)])[-n:]
        if ttl_seconds is not None and kept:
            kept = [x for x in kept if x[0] > kept[-1][0] - ttl_seconds]
        state.update(([t for t, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(kept)], "total": [round(sum(v for _, v in kept), 6)]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, n int, total double", "times array<double>, kept array<double>", "update", "NoTimeout")


def incremental(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """ST5: run ``apply`` on every micro-batch, once each."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_index(stream: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame], checkpoint: str):
    """ST5: an index of chunks under ``path`` that follows a stream of documents (doc_id, text): every micro-batch finds what
    is new or changed (I1) and replaces those documents' chunks (I2).

    Each batch writes a new version, named by its number, from the version before, so a batch that is run again after a
    failure writes the same. A document that comes twice in a batch counts once, with its greatest text.
    """
    spark = stream.sparkSession

    def versions() -> list[int]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "chunks/_SUCCESS")))

    def apply(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy("doc_id").agg(F.max("text").alias("text"))
        before = [v for v in versions() if v < number]
        if not before:
            docs, chunks = fresh, chunk(fresh)
        else:
            old = spark.read.parquet(f"{path}/v{before[-1]}/docs")
            found = changes(old.join(fresh.select("doc_id"), "doc_id", "left_semi"), fresh)
            docs = old.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)
            chunks = update_index(spark.read.parquet(f"{path}/v{before[-1]}/chunks"), found, chunk(fresh))
        docs.write.mode("overwrite").parquet(f"{path}/v{number}/docs")
        chunks.write.mode("overwrite").parquet(f"{path}/v{number}/chunks")

    return incremental(stream.select("doc_id", "text"), apply, checkpoint)
