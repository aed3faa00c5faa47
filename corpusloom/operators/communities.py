"""Louvain communities over tables: local moves in rounds, contraction of communities to nodes, connected results.

Nodes are dealt into blocks of a bounded number of links by a hash, others in each second round. In a block they move one by one;
blocks move at once, so three rules keep nodes of different blocks from trading places: in a round only each second block moves; a node
alone in its community joins a lone node of another block only if that has the smaller name; and a second pass counts only if modularity has grown. A round is a join of links with labels and an
aggregation, neither of which needs a community in one task; a node's own links are in one.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.session import counted, forget, shuffled
from corpusloom.session import written as cut

#: Gains below this share of a node's weight are rounding.
LEAST_GAIN = 1e-9
#: Links of a block, about.
BLOCK = 1 << 16
#: A level is over when no more than this share of its nodes moves in a round.
STILL = 0.01
#: Links of a node from which they are summed as arrays.
MANY = 256


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of undirected edges (src, dst[, weight]), each in both directions, parallel ones added up; a loop once, with twice its weight. Null ends and weights that aren't positive are left out."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w")).where("src is not null and dst is not null and w > 0")
    loops = e.where("src = dst").withColumn("w", 2 * F.col("w"))
    there = e.where("src <> dst")
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of the partition (id, community): the share of weight inside communities less what chance would give. 0 without edges."""
    both = weighted(edges)
    label = lambda end: communities.select(F.col("id").alias(end), F.col("community").alias(f"{end}_community"))
    named = both.join(label("src"), "src").join(label("dst"), "dst")
    by = named.groupBy(F.col("src_community").alias("community")).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("src_community") == F.col("dst_community"), F.col("w")).otherwise(0.0)).alias("inside"))
    all_ = F.sum("total")
    # sum over communities of inside / 2m - resolution (total / 2m)^2
    return by.agg(F.coalesce(F.sum("inside") / all_ - resolution * F.sum(F.col("total") * F.col("total")) / (all_ * all_), F.lit(0.0)).alias("modularity"))


def _quality(links: DataFrame, labels: DataFrame, two_m: float, resolution: float) -> float:
    """The modularity of labels (id, community, k) over symmetric links."""
    names = labels.select("id", "community")
    inside = links.join(shuffled(names.withColumnsRenamed({"id": "src", "community": "a"})), "src").join(shuffled(names.withColumnsRenamed({"id": "dst", "community": "b"})), "dst").where("a = b").agg(F.sum("w")).first()[0] or 0.0
    squares = labels.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / two_m - resolution * squares / (two_m * two_m)


def _settled(nodes: pa.Table, links: pa.Table, share: float, draw: int) -> pa.Table:
    """The nodes (id, community, k, moved) of a block after moves one by one, until none of them gains by another; nodes of other blocks stay where they are.

    ``nodes`` has (id, community, k, total, size), ``links`` (src, dst, w, target, target_total, target_size) with the communities of their far ends; ``share`` is resolution / 2m.
    """
    nodes, links = nodes.sort_by("id").combine_chunks(), links.sort_by([("src", "ascending"), ("dst", "ascending")]).combine_chunks()
    column = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
    n, own = nodes.num_rows, column(nodes, "id")
    both = lambda a, b: pa.concat_arrays([column(nodes, a), column(links, b)])
    # own nodes get the first numbers, communities get theirs in the order of their names
    near = both("id", "dst").dictionary_encode().indices.to_numpy()[n:]
    names = both("community", "target").dictionary_encode()
    order = pc.sort_indices(names.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at, named = rank[names.indices.to_numpy()], names.dictionary.take(order)
    label = np.empty(max(n, near.max(initial=-1) + 1), dtype=np.int64)
    label[near], label[:n] = at[n:], at[:n]
    total, size, others = np.zeros(len(named)), np.zeros(len(named), dtype=np.int64), np.zeros(len(named), dtype=bool)
    total[at], size[at] = both("total", "target_total").to_numpy(), both("size", "target_size").to_numpy()
    others[label[n:]] = True
    total, size, others = total.tolist(), size.tolist(), others.tolist()
    ends = np.searchsorted(pc.index_in(column(links, "src"), value_set=own).to_numpy(zero_copy_only=False), np.arange(n + 1)).tolist()
    w, k = column(links, "w").to_numpy(), column(nodes, "k").to_pylist()
    todo, waits = deque(np.random.default_rng(draw).permutation(n).tolist()), [True] * n
    while todo:
        x = todo.popleft()
        waits[x] = False
        here, there, to = int(label[x]), slice(ends[x], ends[x + 1]), {}
        if ends[x + 1] - ends[x] > MANY:
            met, which = np.unique(label[near[there]], return_inverse=True)
            to = dict(zip(met.tolist(), np.bincount(which, w[there]).tolist(), strict=True))
        else:
            for c, much in zip(label[near[there]].tolist(), w[there].tolist(), strict=True):
                to[c] = to.get(c, 0.0) + much
        total[here] -= k[x]
        best, most = here, to.get(here, 0.0) - share * k[x] * total[here]
        for c, much in to.items():
            worth = much - share * k[x] * total[c]
            # a lone node of another block may do the same the other way round
            if worth > most + LEAST_GAIN * k[x] and not (c > here and size[here] == size[c] == 1 and others[c]):
                best, most = c, worth
        total[best] += k[x]
        if best != here:
            label[x], size[here], size[best] = best, size[here] - 1, size[best] + 1
            for y in near[there].tolist():
                if y < n and not waits[y] and label[y] != best:
                    waits[y] = True
                    todo.append(y)
    return pa.table([own, named.take(pa.array(label[:n])), column(nodes, "k"), pa.array(label[:n] != at[:n])], names=["id", "community", "k", "moved"])


def _moved(links: DataFrame, labels: DataFrame, two_m: float, resolution: float, turn: int, blocks: int) -> DataFrame:
    """Labels (id, community, k, moved) after a round in which each second of ``blocks`` blocks of nodes settles, or the only one; blocks are drawn anew for each two turns."""
    block = lambda end: F.pmod(F.xxhash64(end, F.lit(turn // 2)), F.lit(blocks)).alias("block")
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    placed = labels.join(shuffled(totals), "community").select("id", "community", "k", "total", "size")
    ends = placed.select(F.col("id").alias("dst"), F.col("community").alias("target"), F.col("total").alias("target_total"), F.col("size").alias("target_size"))
    near = links.where("src <> dst").where(F.lit(blocks == 1) | (block("src") % 2 == turn % 2)).join(shuffled(ends), "dst").select("src", "dst", "w", "target", "target_total", "target_size", block("src"))
    kind = labels.schema["id"].dataType.simpleString()
    settle = lambda a, b: _settled(a, b, resolution / two_m, turn)
    return placed.select("*", block("id")).groupBy("block").cogroup(near.groupBy("block")).applyInArrow(settle, f"id {kind}, community {kind}, k double, moved boolean")


def _climb(links: DataFrame, start: DataFrame, two_m: float, resolution: float, rounds: int, levels: int, turn: int) -> DataFrame:
    """(id, community) of the nodes of ``links``, from the partition ``start``, through all levels."""
    found, labels = None, start.join(shuffled(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))), "id").select("id", "community", "k")
    for _ in range(levels):
        labels, nodes = counted(labels, F.count("*"))
        blocks, still, any_, last = max(1, -(-links.count() // BLOCK)), 0, False, labels
        for _ in range(rounds):
            moved, moves = counted(_moved(links, labels, two_m, resolution, turn, blocks), F.count_if("moved"))
            forget(last)
            turn, labels, last, any_ = turn + 1, moved.drop("moved"), moved, any_ or moves > 0
            still = still + 1 if moves <= STILL * nodes else 0
            if blocks == 1 or still == 2:
                break
        to = labels.select(F.col("id").alias("community"), F.col("community").alias("up"))
        first, older = found is None, found
        found = cut(labels.select("id", "community") if first else found.join(shuffled(to), "community").select("id", F.col("up").alias("community")))
        forget(older)
        if not any_ and not first:
            break
        a, b = (to.select(F.col("community").alias(end), F.col("up").alias(f"{end}_up")) for end in ("src", "dst"))
        links = cut(links.join(shuffled(a), "src").join(shuffled(b), "dst").groupBy(F.col("src_up").alias("src"), F.col("dst_up").alias("dst")).agg(F.sum("w").alias("w")))
        forget(last)
        labels = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("community"), "k")
    return found


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 10, passes: int = 2) -> DataFrame:
    """(id, community): a partition of the nodes of undirected edges (src, dst[, weight]), named by its smallest node.

    Each level moves nodes in rounds until next to none moves (or ``rounds`` are over), then makes each community a node of the
    next, until none moves. A further pass starts from what the one before has found, with single nodes, and counts if
    modularity grows. Communities that a move has torn apart are split into their connected parts, which never lowers modularity.
    Nodes have any one type that can be ordered; nodes without edges are not in the result, and an empty graph has none. The
    same graph gives the same partition.
    """
    links = cut(weighted(edges))
    two_m = links.agg(F.sum("w")).first()[0]
    nodes = links.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    if not two_m:
        return nodes
    degrees = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    found, best = nodes, None
    for p in range(passes):
        new = _climb(links, found, two_m, resolution, rounds, levels, p * levels * rounds)
        quality = _quality(links, new.join(shuffled(degrees), "id"), two_m, resolution)
        if best is not None and quality <= best + LEAST_GAIN:
            break
        found, best = new, quality
    names = found.withColumnsRenamed({"id": "src", "community": "a"}), found.withColumnsRenamed({"id": "dst", "community": "b"})
    inside = links.where("src <> dst").join(shuffled(names[0]), "src").join(shuffled(names[1]), "dst").where("a = b").select("src", "dst")
    parts = components(inside)
    return found.join(shuffled(parts.withColumnRenamed("community", "part")), "id", "left").select("id", F.coalesce("part", "id").alias("community"))
