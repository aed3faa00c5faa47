"""Exact similarity joins that compare few pairs: edit distance by shared subsequences and segments, cosine by pivots.

Neither looks at all pairs: two words within k edits share what is left of both without some k characters, and one of k + 1
segments nearly in place; two vectors within a distance r lie about equally far from any third. What shares a key is then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import shuffled, written

#: Rounding of bounds on lengths and distances.
TINY = 1e-9
#: Edits up to which words meet by what is left without as many characters; with more, these are too many.
FEW_EDITS = 2
#: Vectors that serve as pivots, at most.
PIVOTS = 64
#: Rows of either side in a product of matrices, at most, and cosines that are held at once.
LEFT_BLOCK, RIGHT_BLOCK, SLICE = 16_384, 8192, 1 << 21


def edits(longer: Column, least: float) -> Column:
    """The most edits that leave two words, of which the longer has ``longer`` characters, with 1 - d / longer >= ``least``."""
    return F.floor(longer * (1 - least) + TINY).cast("int")


def _segments(n: Column, k: Column) -> Column:
    """(i, start from 0, size) of k + 1 segments of n characters, the later ones longer by one where they don't come out even."""
    size, longer = F.expr("n div (k + 1)"), F.expr("n % (k + 1)")
    first = lambda i: i * size + F.greatest(F.lit(0), i - (F.col("k") + 1 - longer))
    return F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(i.alias("i"), first(i).alias("start"), (first(i + 1) - first(i)).alias("size")))


def _without(term: Column, n: Column) -> Column:
    """What is left of a word without any ``n`` <= FEW_EDITS of its characters, each once."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    left, out = F.array(term), F.when(n == 0, F.array(term))
    for k in range(1, FEW_EDITS + 1):
        left = F.array_distinct(F.flatten(F.transform(left, one)))
        out = out.when(n == k, left)
    return out


def similar_words(left: DataFrame, right: DataFrame, least: float, in_bytes: bool = False) -> DataFrame:
    """Q13: (token, variant): words of ``left`` (term) and of ``right`` (term) with 1 - edits / longer length >= ``least`` > 0.

    Words within few edits k of each other have in common what is left of the longer one without some k characters, so they meet under
    that, however many words begin or end alike. For more edits the shorter word is cut into one segment more than edits are allowed; one
    of them is in the longer word untouched, at most as many places off as there are edits. So words meet under (lengths, segment
    number, segment). These are many times the words that they come from, so neither side is broadcast. Only what meets is
    compared. Null and empty words are like none; repeated words count once. Lengths are in characters, edits too; ``in_bytes`` counts edits of UTF-8 bytes, which are never fewer, as some SQL engines do.
    """
    if not 0 < least <= 1:
        raise ValueError("least is a share above 0")
    # dealt over all tasks by number: a few MB of words would be one task, and make many times as much
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = lambda df: df.select("term").where("term <> ''").distinct().repartition(tasks, "term").withColumn("len", F.length("term"))
    a, b = clean(left), clean(right)

    def lengths(df: DataFrame) -> DataFrame:
        """Words as the shorter one, for each length m that the longer may have, with the edits allowed."""
        m = df.withColumn("n", F.col("len")).withColumn("m", F.explode(F.sequence(F.col("len"), F.floor(F.col("len") / least + TINY).cast("int")))).withColumn("k", edits(F.col("m"), least))
        return m.withColumn("left", F.col("m") - F.col("k"))

    def short(df: DataFrame) -> DataFrame:
        """Segments of words as the shorter one, for each length that the longer may have."""
        m = lengths(df).where(F.col("k") > FEW_EDITS).withColumn("k", F.least("k", F.col("n")))
        s = m.withColumn("s", F.explode(_segments(F.col("n"), F.col("k"))))
        return s.select(F.col("term").alias("short"), "n", "m", F.col("s.i").alias("i"), F.substr("term", F.col("s.start") + 1, F.col("s.size")).alias("part"))

    def long(df: DataFrame) -> DataFrame:
        """Substrings of words as the longer one where a segment of a shorter one can be."""
        m = df.withColumn("m", F.col("len")).where(edits(F.col("m"), least) > FEW_EDITS).withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("len") * least - TINY).cast("int")), F.col("len")))).withColumn("k", F.least(edits(F.col("m"), least), F.col("n")))
        s = m.withColumn("s", F.explode(_segments(F.col("n"), F.col("k"))))
        low, high = F.greatest(F.lit(0), F.col("s.start") - F.col("k")), F.least(F.col("m") - F.col("s.size"), F.col("s.start") + F.col("k"))
        s = s.where(high >= low).withColumn("at", F.explode(F.sequence(low, high)))
        return s.select(F.col("term").alias("long"), "n", "m", F.col("s.i").alias("i"), F.substr("term", F.col("at") + 1, F.col("s.size")).alias("part")).distinct()

    def rests(df: DataFrame, name: str, deleted: Column) -> DataFrame:
        """Hashes of what is left of words; a collision only adds a pair to compare."""
        return df.where(F.col("k") <= FEW_EDITS).select(F.col("term").alias(name), F.explode(F.transform(_without(F.col("term"), deleted), lambda x: F.xxhash64(F.col("m"), x))).alias("rest"))

    spelled = (lambda w: F.decode(F.encode(w, "UTF-8"), "ISO-8859-1")) if in_bytes else F.col
    length = F.greatest(F.length("short"), F.length("long"))
    close = 1 - F.levenshtein(spelled("short"), spelled("long")) / length >= least

    def met(shorter: DataFrame, longer: DataFrame, pair: Column) -> DataFrame:
        by_segment = short(shorter).join(shuffled(long(longer)), ["n", "m", "i", "part"]).select("short", "long").where(pair).distinct().where(close)
        few = rests(lengths(shorter).where(F.col("left") <= F.col("n")), "short", F.col("n") - F.col("left"))
        by_rest = few.join(shuffled(rests(longer.withColumn("m", F.col("len")).withColumn("k", edits(F.col("m"), least)), "long", F.col("k"))), "rest").select("short", "long").where(pair).where(close)
        return by_segment.unionByName(by_rest.distinct())

    both = met(a, b, F.length("short") <= F.length("long")).select(F.col("short").alias("token"), F.col("long").alias("variant"))
    other = met(b, a.where("len > 1"), F.length("short") < F.length("long")).select(F.col("long").alias("token"), F.col("short").alias("variant"))
    return both.unionByName(other)


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an array column without nulls, all of one length."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, vector) of the rows with a vector, written once; floats stay floats until they are multiplied."""
    kind = df.schema[vector].dataType.simpleString()
    own = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    return written(df.select(F.col(id_).alias("id"), own.alias("vector")).where("vector is not null and size(vector) > 0"), "vectors")


def dealt(df: DataFrame, blocks: Column | int) -> Column:
    """A block number for each row of a written table, however many rows are equal."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def blockwise(left: DataFrame, right: DataFrame, least: float | None = None, k: int | None = None) -> DataFrame:
    """(left_id, right_id, score): cosines of the rows (id, vector, cell, block, part) of both sides that have these three alike; those from
    ``least`` on, or the ``k`` best of each row of ``left`` there, by score rounded to 6 places and id. Each group is one product of
    matrices, in slices of bounded size; groups are as large as the caller's blocks."""
    ids = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    schema = f"left_id {ids[0]}, right_id {ids[1]}, score double"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            b = b.sort_by([("id", "ascending")])
            q, v = _unit(_matrix(a.column("vector"))), _unit(_matrix(b.column("vector")))
            step = max(1, SLICE // len(v))
            for at in range(0, len(q), step):
                score = q[at : at + step] @ v.T
                if k is None:
                    row, col = np.nonzero(score >= least - 1e-6)
                else:
                    near = np.floor(score * 1e6 + 0.5)
                    n = min(k, len(v))
                    last = np.partition(near, len(v) - n, axis=1)[:, len(v) - n, None]
                    tied, over = near == last, near > last
                    row, col = np.nonzero(over | tied & (tied.cumsum(1, dtype=np.int32) <= n - over.sum(1, keepdims=True)))
                    if least is not None:
                        kept = score[row, col] >= least - 1e-6
                        row, col = row[kept], col[kept]
                out.append(pa.table([a.column("id").take(pa.array(row + at)), b.column("id").take(pa.array(col)), pa.array(score[row, col])], names=["left_id", "right_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([a.column("id").slice(0, 0), b.column("id").slice(0, 0), pa.array([], pa.float64())], names=["left_id", "right_id", "score"])

    by = ["cell", "block", "part"]
    return left.select("id", "vector", *by).groupBy(*by).cogroup(right.select("id", "vector", *by).groupBy(*by)).applyInArrow(run, schema)


def cosine_join(left: DataFrame, right: DataFrame, least: float, pivots: int = PIVOTS, nearest: bool = False) -> DataFrame:
    """(left_id, right_id, similarity): rows of (id, vector) on both sides with a cosine of ``least`` > 0 or more, rounded to 6 places;
    with ``nearest`` of each row of ``left`` only the most similar, of equally similar ones the least id.

    On the unit sphere a cosine is a distance. Each vector of ``right`` belongs to the nearest of some pivots drawn from ``right``; one of
    ``left`` looks into the cells that can hold something within the distance. A cell is cut into blocks of bounded size, and a block
    of each side is multiplied as matrices. Zero, null and empty vectors are like none. All vectors have one length.
    """
    if not 0 < least <= 1:
        raise ValueError("least is a cosine above 0")
    radius = math.sqrt(max(0.0, 2 - 2 * (least - 1e-6))) + TINY
    given, asked = vectors(right, "id", "vector"), vectors(left, "id", "vector")
    drawn = [r[0] for r in given.groupBy(F.xxhash64("vector").alias("hash")).agg(F.first("vector").alias("vector")).orderBy("hash").limit(pivots).select("vector").collect()]  # at most ``pivots`` rows
    chosen = _unit(np.array(drawn or np.zeros((0, 1)), dtype=np.float64))
    chosen = chosen[np.abs(chosen).sum(1) > 0]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    if not len(chosen):
        return left.sparkSession.createDataFrame([], f"left_id {kind(left, 'id')}, right_id {kind(right, 'id')}, similarity double")

    def distances(unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * unit @ chosen.T))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(_matrix(batch.column("vector")))
            cell = distances(v).argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell)], names=["id", "vector", "cell"]).filter(pa.array(np.abs(v).sum(1) > 0))

    placed = given.mapInArrow(cells, f"id {kind(given, 'id')}, vector {kind(given, 'vector')}, cell int")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most ``pivots`` rows
    blocks = np.array([-(-sizes.get(i, 0) // RIGHT_BLOCK) for i in range(len(chosen))], dtype=np.int32)
    parts = max(1, -(-asked.count() // LEFT_BLOCK))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit(_matrix(batch.column("vector")))
            d = distances(v)
            near = (d <= d.min(1, keepdims=True) + 2 * radius + TINY) & (np.abs(v).sum(1) > 0)[:, None]
            row, cell = np.nonzero(near)
            n = blocks[cell]
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = np.repeat(row, n)
            for at in range(0, len(rows), 10_000):  # a vector goes to many cells
                cut = slice(at, at + 10_000)
                take = pa.array(rows[cut])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("vector").take(take), batch.column("part").take(take), pa.array(np.repeat(cell, n)[cut].astype(np.int32)), pa.array(block[cut].astype(np.int32))], names=["id", "vector", "part", "cell", "block"])

    there = placed.withColumn("block", dealt(placed, F.element_at(F.array(*(F.lit(int(max(1, n))) for n in blocks)), F.col("cell") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    going = asked.withColumn("part", dealt(asked, parts)).mapInArrow(visits, f"id {kind(asked, 'id')}, vector {kind(asked, 'vector')}, part int, cell int, block int")
    met = blockwise(going, there, least, 1 if nearest else None)
    close = met.select("left_id", "right_id", F.round("score", 6).alias("similarity")).where(F.col("similarity") >= least)
    if not nearest:
        return close
    best = close.groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("n"), F.col("right_id").alias("k"))).alias("b"))
    return best.select("left_id", F.col("b.k").alias("right_id"), (-F.col("b.n")).alias("similarity"))
