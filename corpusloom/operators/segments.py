"""ST5, I2: an inverted index that follows its documents, as segments with tombstones.

A change writes one small segment: postings of what was added or changed, a row for each of its documents, and a tombstone
for every older place of a document that was changed or deleted. Nothing else is rewritten, so what is written follows the
change and not the index. Segments of about one size are merged when there are several, and one of which half is dead is cleaned; so
a posting is rewritten as often as the index grows by a factor. A version is a list of segments, written last: readers see the
version before it or after it, and a batch that runs again writes the same version again.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import bucket, counted, write_buckets
from corpusloom.operators.retrieval import B, K1

#: Segments of one tier that are merged, and the growth from one tier to the next.
MERGE, TIER = 4, 4
DOCS, DEAD = "doc_id bigint, len bigint, hash bigint", "doc_id bigint, segment string, len bigint"
STATE = "segment string, docs bigint, length bigint, dead bigint"
#: Documents, and bytes of them, that go to a Python worker at once.
BATCH, BATCH_BYTES = 1000, 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, what runs hands Python workers at most BATCH rows and about BATCH_BYTES at once, so their memory doesn't follow the texts."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in most}
    try:
        for k, v in most.items():
            now = before[k].removesuffix("b")
            if not now.isdigit() or not 0 < int(now) <= v:
                spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass
class SegmentedIndex:
    """The index under ``path``; ``buckets`` partitions of terms."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def _fs(self, name: str = ""):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs("versions")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._fs(f"versions/{n}/_SUCCESS")[1]))

    def state(self, version: int | None = None) -> list[dict]:
        """Segments of a version (the last): name, documents, their tokens and how many are dead; a few rows."""
        found = self.versions()
        version = (found[-1] if found else None) if version is None else version
        return [] if version is None else sorted((r.asDict() for r in self.spark.read.schema(STATE).parquet(f"{self.path}/versions/v{version}").collect()), key=lambda r: r["segment"])

    def _of(self, segments: list[dict], name: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/segments/{s['segment']}/{name}" for s in segments]
        return self.spark.read.schema(schema).parquet(*paths)

    def documents(self, segments: list[dict]) -> DataFrame:
        """(doc_id, len, hash, segment) of live documents."""
        here = [self._of([s], "docs", DOCS).withColumn("segment", F.lit(s["segment"])) for s in segments]
        if not here:
            return self.spark.createDataFrame([], DOCS + ", segment string")
        rows = here[0]
        for more in here[1:]:
            rows = rows.unionByName(more)
        return rows.join(self.tombstones(segments).select("doc_id", "segment"), ["doc_id", "segment"], "left_anti")

    def tombstones(self, segments: list[dict]) -> DataFrame:
        """(doc_id, segment, len) of places that are dead, of the segments given."""
        return self._of(segments, "dead", DEAD).where(F.col("segment").isin([s["segment"] for s in segments]))

    def postings(self, segments: list[dict]) -> DataFrame:
        """(bucket, term, doc_id, len, tf) of live documents."""
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s['segment']}/words").select("bucket", "term", "doc_id", "len", "tf", F.lit(s["segment"]).alias("segment")) for s in segments if s["docs"]]
        if not parts:
            return self.spark.createDataFrame([], "bucket int, term string, doc_id bigint, len bigint, tf bigint")
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        if any(s["dead"] for s in segments):
            rows = rows.join(self.tombstones(segments).select("doc_id", "segment"), ["doc_id", "segment"], "left_anti")
        return rows.drop("segment")

    def _segment(self, name: str, postings: DataFrame, docs: DataFrame, dead: DataFrame) -> dict:
        """Write a segment; what it holds."""
        base = f"{self.path}/segments/{name}"
        write_buckets(postings.select("doc_id", "len", "term", "tf").withColumn("bucket", bucket(F.col("term"), self.buckets)), f"{base}/words", self.buckets, F.col("doc_id"))
        docs.select("doc_id", "len", "hash").write.mode("overwrite").parquet(f"{base}/docs")
        dead.select("doc_id", "segment", "len").write.mode("overwrite").parquet(f"{base}/dead")
        total = self.spark.read.schema(DOCS).parquet(f"{base}/docs").agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("length")).first()
        return {"segment": name, "docs": total["docs"], "length": total["length"], "dead": 0}

    def _commit(self, version: int, segments: list[dict]) -> None:
        rows = [(s["segment"], s["docs"], s["length"], s["dead"]) for s in segments]
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v{version}")

    def apply(self, changes: DataFrame, number: int | None = None, compact: bool = True) -> dict:
        """Put changes (doc_id, text[, deleted]) into a new version; how many documents were added, modified, deleted and left alone.

        A document that comes twice counts once, with its greatest text; it is deleted if any of its rows says so. One whose text is what the
        index has is left alone; a null text counts as empty. Null ids are left out. ``number`` names a batch of a stream: the same
        number gives the same version, and one that isn't after the last version's has been applied already.
        """
        found = self.versions()
        version = (found[-1] + 1 if found else 0) if number is None else number
        before = [v for v in found if v < version]
        segments = self.state(before[-1]) if before else []
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        fresh = changes.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), gone.alias("gone")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("gone").alias("gone"))
        fresh = fresh.withColumn("hash", F.xxhash64("text"))
        name = f"s{version}"
        # what the batch does, stored: it is read several times, and says the same each time
        known = self.documents(segments).withColumnsRenamed({"hash": "was", "len": "old_len"})
        plan = f"{self.path}/batches/{name}"
        kind = F.when(F.col("gone"), F.when(F.col("segment").isNotNull(), "deleted").otherwise("unknown")).when(F.col("segment").isNull(), "added").when(F.col("was") == F.col("hash"), "unchanged").otherwise("modified")
        fresh.join(known, "doc_id", "left").withColumn("kind", kind).write.mode("overwrite").parquet(plan)
        done = self.spark.read.parquet(plan)
        counts = {r["kind"]: r["count"] for r in done.groupBy("kind").count().collect()}
        come = done.where("kind in ('added', 'modified')")
        tokens = come.select("doc_id", T.tokens(F.col("text")).alias("t"))
        words = counted(tokens)
        docs = come.select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("len"), "hash")
        dead = done.where("kind in ('modified', 'deleted')").select("doc_id", "segment", F.col("old_len").alias("len"))
        if any(counts.get(k) for k in ("added", "modified", "deleted")):
            with small_batches(self.spark):
                new = self._segment(name, words, docs, dead)
            killed = {r["segment"]: r for r in self._of([new], "dead", DEAD).groupBy("segment").agg(F.count("*").alias("n")).collect()}
            segments = [s | {"dead": s["dead"] + (killed[s["segment"]]["n"] if s["segment"] in killed else 0)} for s in segments] + [new]
            if compact:
                segments = self._compacted(segments, name)
        self._commit(version, segments)
        fs, where = self._fs(f"batches/{name}")
        fs.delete(where, True)
        return {k: counts.get(k, 0) for k in ("added", "modified", "deleted", "unchanged")}

    def _compacted(self, segments: list[dict], name: str) -> list[dict]:
        """Segments after merges: a tier that is full becomes one segment, and one of which half is dead goes into the next merge."""
        tier = lambda s: int(math.log(max(1, s["docs"] - s["dead"]), TIER))
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(tier(s), []).append(s)
        merge = [s for group in tiers.values() if len(group) >= MERGE for s in group]
        merge += [s for s in segments if s not in merge and 2 * s["dead"] >= max(1, s["docs"])]
        if not merge or len(merge) == 1 and not merge[0]["dead"]:
            return segments
        rest = [s for s in segments if s not in merge]
        names = [s["segment"] for s in merge]
        dead = self._of(segments, "dead", DEAD)
        here = dead.where(F.col("segment").isin(names)).select("doc_id", "segment")
        live = lambda part, schema: [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s['segment']}/{part}").withColumn("segment", F.lit(s["segment"])) for s in merge if s["docs"]]
        docs = self.spark.createDataFrame([], DOCS + ", segment string")
        for d in live("docs", DOCS):
            docs = docs.unionByName(d)
        words = self.spark.createDataFrame([], "doc_id bigint, len bigint, term string, tf bigint, segment string")
        for w in live("words", "doc_id bigint, len bigint, term string, tf bigint"):
            words = words.unionByName(w.drop("bucket"))
        # tombstones that the merged segments hold for others live on in the new one
        held = self._of(merge, "dead", DEAD).where(~F.col("segment").isin(names) & F.col("segment").isin([s["segment"] for s in rest]))
        clean = lambda rows: rows.join(here, ["doc_id", "segment"], "left_anti")
        new = self._segment(f"{name}m", clean(words), clean(docs), held)
        return [*rest, new]

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but for the last ``keep`` and the segments that no version left has; how many segments went."""
        found = self.versions()
        used = {s["segment"] for v in found[-keep:] for s in self.state(v)}
        for v in found[:-keep]:
            fs, where = self._fs(f"versions/v{v}")
            fs.delete(where, True)
        fs, where = self._fs("segments")
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName() not in used] if fs.exists(where) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def bm25(self, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """R2 over live documents: (query_id, doc_id, score), the same as an index built anew.

        Frequencies of terms are counted from the postings of the asked terms, which are read anyway; numbers and lengths of documents
        come from the segments' rows in the version, less the dead.
        """
        segments = self.state()
        dead = self.tombstones(segments).agg(F.count_if(F.col("len") > 0).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        # documents without a token don't count, as in an index of postings
        n = sum(self._of([s], "docs", DOCS).where("len > 0").count() for s in segments) - dead["n"]
        avgdl = (sum(s["length"] for s in segments) - dead["len"]) / max(1, n)
        wanted = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", bucket(F.col("term"), self.buckets))
        hits = self.postings(segments).join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avgdl)))
        return hits.join(wanted.drop("bucket"), "term").join(df, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def follow(stream: DataFrame, index: SegmentedIndex, checkpoint: str):
    """ST5: a query that puts every micro-batch of changes (doc_id, text[, deleted]) into the index, once each."""
    return stream.writeStream.foreachBatch(lambda batch, number: index.apply(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
