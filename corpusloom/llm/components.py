"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's larger neighbours (or it and its smaller ones) joined to the smallest node of its neighbourhood.

    The minimum is an aggregate joined back, not a window, so a node with very many neighbours is split like any other.
    """
    if larger:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Edges may repeat, run either way, and link a node to itself (such a link is ignored); null ends are ignored. Each
    round is written to the shared folder, so its lineage is one table, and the table before it is deleted. So is the
    result; who has read it may ``discard`` it.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    before = held = None
    while True:
        edges = stored(_star(_star(edges, True), False), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held is not None:
            discard(held)
        if now == before or now[0] == 0:
            break
        before, held = now, edges
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    discard(edges)
    return out
