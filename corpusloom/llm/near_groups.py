"""Groups of near copies by the Jaccard similarity of word shingles, with SimHash fingerprints and min-wise samples for candidates.

Candidates come from two kinds of prints. Those of whole texts are SimHash fingerprints, which meet in the grid join of
``simhash_dedup``; it reaches texts that differ in very little. Texts with a similarity of 0.8 have fingerprints about ten
bits apart, further than any grid over 64 bits separates from chance. For them every text has SAMPLES prints, each of TAKE
min-wise values of its shingles; a print is equal for two texts of similarity s with probability s ** TAKE, so all of them
miss a pair at 0.8 once in about two million.

Every candidate is verified on the whole shingle sets. Texts are compared a bucket (the texts with one print) at a time:
for ROUNDS rounds at most, with one centre of the bucket, a different one each round, which joins a large group of copies
without its pairs. Only texts that are in different groups by then meet; at last all that are left in different groups.
So every candidate pair is compared unless links have joined its texts already, and groups are the chains of all links.
Sizes and PARITY words of parity bits rule out most candidates without loss: as many bits as differ, so many shingles at
least are in one of the two texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, lean, slices, stored, tidy
from corpusloom.llm.components import components
from corpusloom.llm.fingerprints import shingle_hashes, simhash
from corpusloom.llm.recompress_core import GOLD, mix
from corpusloom.llm.simhash_dedup import close_pairs

#: Prints of a text beside its fingerprint, and min-wise values in a print.
SAMPLES, TAKE = 20, 3
#: Rounds in which a bucket's texts meet one centre, and 64-bit words of parity bits for each text.
ROUNDS, PARITY = 4, 16
#: So many ids at most are broadcast.
FEW = 1_000_000
#: The orders of the min-wise values: each is a bijection of 64 bits, x -> (x ^ flip) * odd.
FLIP = mix(np.arange(1, SAMPLES * TAKE + 1, dtype=np.uint64) * GOLD)
ODD = mix(FLIP + GOLD) | np.uint64(1)
#: Floating-point products of a similarity and a count are right to far less.
NEARLY = 1e-9


def sample_prints(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of shingle hashes its SAMPLES prints; zeros for an empty set."""
    out = np.zeros((len(sets), SAMPLES), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for k in range(SAMPLES):
        found = np.zeros(len(full), np.uint64)
        for j in range(k * TAKE, (k + 1) * TAKE):
            found = mix(found + np.minimum.reduceat((values ^ FLIP[j]) * ODD[j], starts))
        out[full, k] = found
    return out


def parity_bits(sets: list[np.ndarray]) -> np.ndarray:
    """For each set 64 * PARITY bits, as PARITY integers: the parity of the shingles that fall on each."""
    width = 64 * PARITY
    at = [np.empty(0, np.int64)] + [(mix(s) & np.uint64(width - 1)).astype(np.int64) + i * width for i, s in enumerate(sets)]
    odd = (np.bincount(np.concatenate(at), minlength=len(sets) * width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(sets), PARITY)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, fps = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, width)
                fps.append(simhash(hashes))
                sets.append(np.unique(hashes))
            # a sum of mixed hashes stands for the set
            same = np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64)
            own = [mix(same).view(np.int64), np.array(fps, np.int64), np.array([len(s) for s in sets], np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, own), _lists(sample_prints(sets)), _lists(parity_bits(sets))], names=["id", "same", "fp", "n", "samples", "bits"])

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["id", "shingles"])

    return run


def fingerprint_buckets(sets: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(k, print, id) of whole-text fingerprints: a bucket for each that several texts have, and one for each two that
    differ in at most ``radius`` bits, with all texts of both. ``sets`` has (id, fp)."""
    sizes = sets.groupBy("fp").agg(F.count("*").alias("size"))
    several = sizes.where("size > 1").select("fp")
    equal = sets.join(several.hint("merge"), "fp").select(F.lit(-1).alias("k"), F.col("fp").alias("print"), "id")
    near = close_pairs(sizes.select("fp"), radius).select("a", "b", F.xxhash64("a", "b").alias("print"))
    ends = near.select("print", F.explode(F.array("a", "b")).alias("fp"))
    return equal, ends.join(sets.hint("merge"), "fp").select(F.lit(-2).alias("k"), "print", "id")


def possible(x: str, y: str, similarity: float) -> Column:
    """Whether sizes and parity bits leave it open that two texts, columns n and bits of the structs ``x`` and ``y``, are similar."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(PARITY))
    # of nx + ny shingles, 2 * common are in both: a similarity s leaves (1 - s) / (1 + s) of them at most
    return (F.least(nx, ny) + NEARLY >= similarity * F.greatest(nx, ny)) & (apart <= (1 - similarity) / (1 + similarity) * (nx + ny) + NEARLY)


def dropped(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root): the ids whose text is in a group with a smaller id, and the smallest id of the group.

    Groups are chains of verified pairs. Texts with equal shingle sets are one; texts without words have the empty set.
    Rows with a null id are left out. The result is written to the shared folder; all tables on the way to it are deleted.
    """
    base = lean(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    signs = stored(base.mapInArrow(tidy(_signatures(width)), f"id {kind}, same bigint, fp bigint, n bigint, samples array<bigint>, bits array<bigint>"), "signatures")
    heads = signs.groupBy("same").agg(F.min("id").alias("head"))
    sets = stored(signs.groupBy("same").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("samples").alias("samples"), F.first("bits").alias("bits")).drop("same"), "sets")

    # only prints that several texts have matter from here on
    equal, near = fingerprint_buckets(sets.select("id", "fp"), radius)
    spread = sets.select(F.posexplode("samples").alias("k", "print"), "id")
    several = spread.groupBy("k", "print").agg(F.count("*").alias("size")).where("size > 1").select("k", "print")
    members = stored(spread.join(several.hint("merge"), ["k", "print"]).unionByName(equal).unionByName(near).withColumn("root", F.col("id")), "members")
    used = stored(members.select("id").distinct(), "used")
    few = used.count() <= FEW
    wanted = base.join(F.broadcast(used) if few else used.hint("merge"), "id", "left_semi")
    shapes = stored(sets.select("id", "n", "bits").join(F.broadcast(used) if few else used.hint("merge"), "id", "left_semi"), "shapes")
    texts = stored(wanted.mapInArrow(tidy(_shingles(width)), f"id {kind}, shingles array<bigint>").dropDuplicates(["id"]), "shingles")
    discard(sets, used)

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that are similar; ``pairs`` has no repeats."""
        of = F.struct("n", "bits")
        x, y = shapes.select(F.col("id").alias("x"), of.alias("a")), shapes.select(F.col("id").alias("y"), of.alias("b"))
        open_ = stored(pairs.join(x, "x").join(y, "y").where(possible("a", "b", similarity)).select("x", "y"), "open")
        left = texts.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
        right = texts.join(open_.select(F.col("y").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("y"), F.col("shingles").alias("sy"))
        common, both = F.size(F.array_intersect("sx", "sy")), F.size("sx") + F.size("sy")
        found = stored(open_.join(left, "x").join(right, "y").where(common + NEARLY >= similarity * (both - common)).select("x", "y"), "alike")
        discard(open_)
        return found

    roots: DataFrame | None = None  # (node, root) of the texts that are not their own group
    for round_ in range(ROUNDS + 1):
        last = round_ == ROUNDS
        order = F.xxhash64("id", F.lit(round_))
        buckets = members.groupBy("k", "print").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("id", "root"), F.struct(order, "id")).alias("centre")).where("low < high")
        if last:  # all that is left in different groups
            active = members.join(buckets.select("k", "print").hint("merge"), ["k", "print"]).join(shapes, "id").select("k", "print", F.struct("id", "root", "n", "bits").alias("m"))
            same_bucket = (F.col("a.k") == F.col("b.k")) & (F.col("a.print") == F.col("b.print"))
            met = active.alias("a").join(active.alias("b").hint("merge"), same_bucket & (F.col("a.m.root") < F.col("b.m.root")) & possible("a.m", "b.m", similarity))
            pairs = met.select(F.greatest("a.m.id", "b.m.id").alias("x"), F.least("a.m.id", "b.m.id").alias("y"))
        else:
            met = members.join(buckets.hint("merge"), ["k", "print"]).where(F.col("root") != F.col("centre.root"))
            pairs = met.select(F.greatest("id", "centre.id").alias("x"), F.least("id", "centre.id").alias("y"))
        pairs = stored(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            discard(pairs)
            break
        found = alike(pairs)
        if not found.isEmpty():
            # groups that a link joins become one
            edges = found
            for end in ("x", "y") if roots is not None else ():
                edges = edges.join(roots.withColumnsRenamed({"node": end, "root": "to"}), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            merged = components(edges, "x", "y")
            moved = merged.select(F.col("node").alias("root"), F.col("root").alias("to"))
            now = members.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
            before, members = members, stored(now.select("k", "print", "id", "root"), "members")
            discard(before)
            if roots is None:
                roots = stored(merged, "roots")
            else:
                grown = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
                before, roots = roots, stored(grown.unionByName(merged.join(grown.select("node"), "node", "left_anti")), "roots")
                discard(before)
            discard(merged)
        discard(pairs, found)
    classes = heads.select("same", F.col("head").alias("root"))
    if roots is not None:
        classes = heads.join(roots.withColumnRenamed("node", "head"), "head", "left").select("same", F.coalesce("root", "head").alias("root"))
    classes = stored(classes, "classes")  # so that the join can be split where very many rows say the same
    out = stored(signs.select("id", "same").join(classes.hint("merge"), "same").where("id <> root").select("id", "root").distinct(), "dropped")
    discard(signs, members, shapes, texts, classes, *([roots] if roots is not None else []))
    return out


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is in a group with a smaller id.

    Of rows that repeat an id one stays, the one with the smallest text. Rows with a null id stay. All columns stay.
    """
    gone = dropped(docs, width, similarity, radius, id_col, text_col)
    few = gone.count() <= FEW
    gone = gone.select(F.col("id").alias(id_col))
    kept = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    again = stored(repeated, "repeated")
    if again.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    one = kept.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min(F.struct(text_col, *others)).alias("r")).select(id_col, "r.*").select(*docs.columns)
    return kept.join(again, id_col, "left_anti").select(*docs.columns).unionByName(one)
