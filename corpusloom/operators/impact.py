"""The best k of each query without reading most postings of common terms.

Postings of a term lie in blocks of one impact level: the level says how much a posting can add to a score, a block's row has the greatest
such part of its postings, and blocks of a level are dealt by a hash of the document. A search

1. reads the highest levels of its terms, as many as hold a few times k postings, and adds up what it has seen; the k-th best sum is
   a score that the answer has at least;
2. reads further levels until what no level read can still add is less than that, so a document seen nowhere can't be in the answer;
3. keeps the documents that could still reach the k-th best sum, and reads of the levels left out only the shards of these documents.

So the answer equals the full sum's, and rows of common terms' low levels are passed over. Levels and shards are filters on sorted
columns, told to the scan as literals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.index import SparseIndex
from corpusloom.operators.retrieval import B, K1, top_k
from corpusloom.session import written

#: Levels of impact, postings in a block about, and postings read at first as a multiple of k.
LEVELS, BLOCK, FIRST = 16, 256, 4
#: Terms of a batch of queries whose levels are told to the scan as literals.
LITERALS = 400
#: Terms of a batch whose levels are read; one of more is multiplied with the documents, as nearly every document could be in some answer.
MOST_TERMS = 1000


def part(tf: Column, length: Column, avgdl: float, k1: float = K1, b: float = B) -> Column:
    """R2: what a posting adds to a score, over the term's weight: below k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(avgdl)))


def build(index: SparseIndex, shard_docs: int = 4096) -> None:
    """Write the blocks of an index beside it, and the number and greatest part of each term's levels."""
    totals = index.totals()
    shards = 1 << max(0, (totals["n"] // shard_docs)).bit_length()
    p = part(F.col("tf"), F.col("len"), totals["avgdl"])
    rows = index.table("words").select("bucket", "term", "doc_id", p.alias("part")).withColumn("level", F.least(F.lit(LEVELS - 1), F.floor(F.col("part") / (K1 + 1) * LEVELS).cast("int")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    # one row a block: a term's postings of one level and shard, which are about as many for any size of the corpus
    blocks = rows.groupBy("bucket", "term", "level", "shard").agg(F.count("*").cast("int").alias("n"), F.max("part").alias("most"), F.collect_list(F.struct("doc_id", "part")).alias("postings"))
    parts = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    salted = blocks.repartition(parts, "bucket", F.pmod(F.xxhash64("term", "shard"), F.lit(max(1, parts // totals["buckets"]))))
    salted.sortWithinPartitions("bucket", "term", "level", "shard").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/blocks")
    levels = index.table("blocks").groupBy("bucket", "term", "level").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    levels.repartition(parts, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/levels")
    index.spark.createDataFrame([(shards,)], "shards int").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/shards")


@dataclass
class Read:
    """What a search has read: rows of blocks in each round, and rows of blocks of its terms in all."""

    first: int = 0
    more: int = 0
    rest: int = 0
    all: int = 0


def built(index: SparseIndex) -> bool:
    done = index.spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/shards/_SUCCESS")
    return done.getFileSystem(index.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def bm25_top(index: SparseIndex, queries: DataFrame, k: int, counts: Read | None = None) -> DataFrame:
    """R2: (query_id, doc_id, score, rank): the k best of each query, as of the whole sum. The blocks are built if they aren't there."""
    if index.asked(queries, T.tokens(F.col("query"))).select("term").distinct().limit(MOST_TERMS + 1).count() > MOST_TERMS:
        return index.best_bm25(queries, k).select("query_id", "doc_id", "score", "rank")
    if not built(index):
        build(index)
    totals = index.totals()
    shards = index.table("shards").first()["shards"]
    n = F.lit(totals["n"])
    asked = index.asked(queries, T.tokens(F.col("query"))).join(index.table("terms").select("bucket", "term", "df"), ["bucket", "term"])
    asked = written(asked.withColumn("w", F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).select("query_id", "bucket", "term", "w"), "asked")
    terms = asked.select("bucket", "term").distinct()
    levels = written(index.table("levels").join(terms, ["bucket", "term"], "left_semi").select("bucket", "term", "level", "n", "most"), "levels")

    # 1. the highest levels with FIRST * k postings of each term
    down = Window.partitionBy("bucket", "term").orderBy(F.desc("level"))  # at most LEVELS rows
    before = levels.withColumn("before", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = before.where(F.col("before") < FIRST * k).groupBy("bucket", "term").agg(F.min("level").alias("cut"))
    seen = written(_read(index, cut, F.col("level") >= F.col("cut")), "seen")
    sums, least = _sums(asked, seen, k)

    # 2. down to where what is left out of all terms of a query is below its k-th best sum
    weights = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    m = Window.partitionBy("query_id").orderBy("w", "term")
    w = weights.join(cut, ["bucket", "term"])
    options = w.join(levels.select("bucket", "term", "level", "most"), ["bucket", "term"])
    # each term may leave out levels whose parts, times its weight, are below its even share
    share = F.col("least") * 0.999 / F.col("terms")
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    wanted = options.join(sizes, "query_id").where(F.col("most") * F.col("w") >= share).groupBy("bucket", "term").agg(F.min("level").alias("low"))
    cut2 = written(cut.join(wanted, ["bucket", "term"], "left").select("bucket", "term", "cut", F.least("cut", F.coalesce("low", "cut")).alias("low")), "cuts")
    more = written(_read(index, cut2, (F.col("level") < F.col("cut")) & (F.col("level") >= F.col("low")), low="low", high="cut"), "more")
    both = seen.unionByName(more)
    sums, least = _sums(asked, both, k)

    # 3. documents that the levels left out could still lift to the k-th best sum
    out = levels.join(cut2.select("bucket", "term", "low"), ["bucket", "term"]).where(F.col("level") < F.col("low")).groupBy("bucket", "term").agg(F.max("most").alias("left"))
    left = asked.join(out, ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("w") * F.col("left")).alias("can"))
    can_all = left.groupBy("query_id").agg(F.sum("can").alias("can"))
    had = both.join(asked, ["bucket", "term"]).select("query_id", "doc_id", "term").join(left.select("query_id", "term", "can"), ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("can").alias("had"))
    may = sums.join(can_all, "query_id", "left").join(had, ["query_id", "doc_id"], "left").join(least, "query_id", "left")
    upper = F.col("sum") + F.coalesce("can", F.lit(0.0)) - F.coalesce("had", F.lit(0.0))
    may = written(may.where(upper >= F.coalesce(F.col("least") - 1e-9, F.lit(0.0))).select("query_id", "doc_id", "sum", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")), "may")
    need = may.join(left.select("query_id", "bucket", "term"), "query_id").select("bucket", "term", "shard").distinct()
    need = written(need.join(cut2.select("bucket", "term", "low"), ["bucket", "term"]), "need")
    rest = written(_read(index, need, F.col("level") < F.col("low"), high="low", shards=True), "rest")
    added = rest.join(asked, ["bucket", "term"]).select("query_id", "doc_id", (F.col("part") * F.col("w")).alias("x"))
    scores = may.select("query_id", "doc_id", F.col("sum").alias("x")).unionByName(added.join(may.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")).groupBy("query_id", "doc_id").agg(F.sum("x").alias("score"))
    if counts is not None:
        count = lambda df: df.select("bucket", "term", "level", "shard").distinct().count()
        counts.first, counts.more, counts.rest = count(seen), count(more), count(rest)
        counts.all = index.table("blocks").join(terms, ["bucket", "term"], "left_semi").count()
    return top_k(scores, k)


def _sums(asked: DataFrame, postings: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, sum) of what was read, and (query_id, least), the k-th best sum of queries that have k documents."""
    sums = written(postings.join(asked, ["bucket", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("part") * F.col("w")).alias("sum")), "sums")
    best = top_k(sums, k, "sum").where(F.col("rank") == k).select("query_id", F.col("sum").alias("least"))
    return sums, written(best, "least")


def _read(index: SparseIndex, cuts: DataFrame, keep: Column, low: str = "cut", high: str | None = None, shards: bool = False) -> DataFrame:
    """Postings (bucket, term, level, shard, doc_id, part) of the blocks that ``keep`` leaves of the terms in ``cuts``.

    The terms, levels and shards of a bounded number of terms are told to the scan as well, so it passes over other pages.
    """
    blocks = index.table("blocks")
    by = ["bucket", "term", *(["shard"] if shards else [])]
    some = cuts.limit(LITERALS + 1).collect()
    if some and len(some) <= LITERALS:
        bounds: dict[tuple[int, str], list[int]] = {}
        for r in some:
            bounds.setdefault((r["bucket"], r["term"]), []).append(r["shard"] if shards else 0)
        ends = {(r["bucket"], r["term"]): r for r in some}
        tests = []
        for (b, t), own in sorted(bounds.items()):
            r = ends[b, t]
            test = (F.col("bucket") == b) & (F.col("term") == t)
            if high is None or low != "cut" and low in r.asDict():
                test = test & (F.col("level") >= r[low])
            if high is not None:
                test = test & (F.col("level") < r[high])
            if shards:
                test = test & F.col("shard").isin(sorted(set(own)))
            tests.append(test)
        blocks = blocks.where(reduce(lambda x, y: x | y, tests))
    elif not some:
        blocks = blocks.where("false")
    kept = blocks.join(cuts, by).where(keep)
    return kept.select("bucket", "term", "level", "shard", F.explode("postings").alias("p")).select("bucket", "term", "level", "shard", "p.doc_id", "p.part")
