"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; a segment's count of ones (0 to 2) is one coordinate. The
Manhattan distance of two such points is never more than the number of differing bits, so it is a lower bound. Points
within distance r agree on at least m of r + m groups of coordinates, because each group that differs costs at least one.
m is AGREE, or more where so many points would crowd the cells (``agree_for``): the pairs found are the same for every m.
Every choice of m groups is a grid whose cells are the joint values of their coordinates: two points within
r share a cell of the first grid whose groups are all equal, and are joined there and only there. In a cell the bound
comes first, then the exact count of differing bits. Equal fingerprints are one point, so copies cost nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.llm.components import components
from corpusloom.llm.fingerprints import with_fingerprints

SEGMENTS, AGREE = 32, 3
#: Points that may share a cell by chance, on average, and the most groups that agree.
CROWD, MOST_AGREE = 8, 6
LOW_BITS = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """The 32 counts of ones, two bits each, as one 64-bit integer."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The distance of two embeddings. Counts are 0, 1 or 2: of two that differ in the high bit alone the difference is 2."""
    differ = a.bitwiseXOR(b)
    low, high = differ.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(differ, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.bit_count(low) + F.lit(2) * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def group_masks(radius: int, agree: int = AGREE) -> list[int]:
    """The bits of each of the radius + agree groups of segments, as even as can be."""
    groups = radius + agree
    edges = [SEGMENTS * g // groups for g in range(groups + 1)]
    return [signed(sum(3 << 2 * s for s in range(a, b))) for a, b in zip(edges, edges[1:], strict=False)]


def agree_for(points: int, radius: int) -> int:
    """The groups that agree in a grid for so many points: a segment of two random bits tells 1.5 bits, and a grid of m of
    radius + m groups as large a share of all segments."""
    for m in range(AGREE, MOST_AGREE):
        if points <= CROWD * 2 ** (1.5 * SEGMENTS * m / (radius + m)):
            return m
    return MOST_AGREE


def close_pairs(points: DataFrame, radius: int, agree: int | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of distinct values of ``points.fp`` that differ in at most ``radius`` bits, each once."""
    agree = agree or agree_for(points.count(), radius)
    masks = group_masks(radius, agree)
    grids = list(combinations(range(len(masks)), agree))
    spread = F.array(
        *(F.struct(F.lit(n).alias("grid"), F.lit(g[-1]).alias("last"), F.lit(signed(sum(masks[i] for i in g) % (1 << 64))).alias("mask")) for n, g in enumerate(grids))
    )
    cells = points.select("fp", F.explode(spread).alias("g")).select(
        "fp", F.col("g.last").alias("last"), F.xxhash64("g.grid", embedding(F.col("fp")).bitwiseAND(F.col("g.mask"))).alias("cell"), F.col("g.mask").alias("mask")
    )
    x, y = cells.alias("x"), cells.alias("y")
    ex, ey = embedding(F.col("x.fp")), embedding(F.col("y.fp"))
    differ = ex.bitwiseXOR(ey)
    equal_so_far = sum(((differ.bitwiseAND(F.lit(m)) == 0) & (F.col("x.last") >= i)).cast("int") for i, m in enumerate(masks))
    near = (
        (F.col("x.cell") == F.col("y.cell")) & (F.col("x.mask") == F.col("y.mask")) & (F.col("x.fp") < F.col("y.fp"))
        & (manhattan(ex, ey) <= radius)
        & (differ.bitwiseAND(F.col("x.mask")) == 0) & (equal_so_far == agree)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    )
    return x.join(y.hint("merge"), near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n_copies, component_id) for every row of ``docs``.

    fp is the fingerprint of the whole text as a signed 64-bit integer; n_copies is the number of rows with the same;
    component_id is the smallest id that links of at most ``radius`` differing bits reach, the row's own included. A
    null, empty or blank text has fingerprint zero and is linked like any other. Rows that repeat an id are kept; a null
    id is kept and never is a component's smallest unless there is no other (then null). Other columns are left out.
    Texts are read once and not shuffled; what is shuffled are fingerprints, one row for each distinct one and grid.
    """
    fps = stored(with_fingerprints(docs, width, id_col, text_col), "fingerprints")
    points = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "points")
    linked = components(close_pairs(points, radius))
    rooted = points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "n_copies", "component_id")
    return fps.join(classes, "fp").select(F.col("doc_id").alias(id_col), "fp", "n_copies", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
