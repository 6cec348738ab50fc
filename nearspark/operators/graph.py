"""Similarity graph, connected components, pseudo-labels.

Components use the alternating large-star / small-star contraction of
Kiveris et al. (2014): every round is two aggregate + join steps over the
edge list, the edge set shrinks to stars around each component's smallest
id, and it converges in O(log^2 n) rounds. Each round's edges are
checkpointed (reliable, in the shared checkpoint folder), so lineage stays
short and a lost executor costs one round at most. The driver only reads
numbers per round (edges, did anything change).

A node's neighbours meet its smallest one in a join on the node. Nodes with more
than ``1 / HUBS`` of all edge ends take no part in that join: there are at most
``HUBS`` of them, so their minima are broadcast and their edges stay where they
are. No join key then holds more than that share of the rows, star or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearspark.operators import pairs as P
from nearspark.session import materialize

HUBS = 1024  # at most so many nodes can have more than 1 / HUBS of the rows
LEAST_HUB = 16  # rows a node needs, at least, to be worth it


def similarity_graph(pairs: DataFrame, nodes: DataFrame, id_col: str, threshold: float = 0.8,
                     strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(nodes(id), edges(src, dst, weight))``: an edge iff similarity > t (>= t if not strict)."""
    cond = F.col("value") > threshold if strict else F.col("value") >= threshold
    edges = pairs.filter(cond).select(F.col("id1").alias("src"), F.col("id2").alias("dst"),
                                      F.col("value").alias("weight"))
    return nodes.select(F.col(id_col).alias("id")).distinct(), edges


def with_least(e: DataFrame, n_rows: int) -> DataFrame:
    """``(src, dst, _m)``: each of the ``n_rows`` rows with the smallest ``dst`` of its ``src``."""
    least = e.groupBy("src").agg(F.min("dst").alias("_m"), F.count(F.lit(1)).alias("_n"))
    if n_rows <= HUBS * LEAST_HUB:
        return e.join(least.drop("_n"), "src")
    hubs = F.broadcast(least.filter(F.col("_n") > n_rows / HUBS).select("src", F.col("_m").alias("_h")))
    marked = e.join(hubs, "src", "left")
    of_hubs = marked.filter(F.col("_h").isNotNull()).select("src", "dst", F.col("_h").alias("_m"))
    return of_hubs.unionByName(marked.filter(F.col("_h").isNull()).drop("_h").join(least.drop("_n"), "src"))


def _large_star(e: DataFrame, n_edges: int) -> DataFrame:
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (with_least(both, 2 * n_edges).filter(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.least("src", "_m").alias("dst")).distinct())


def _small_star(e: DataFrame, n_edges: int) -> DataFrame:
    # e holds (larger, smaller); for each u take its smaller neighbours
    joined = with_least(e, n_edges)
    moved = joined.select(F.when(F.col("dst") == F.col("_m"), F.col("src"))
                          .otherwise(F.col("dst")).alias("src"), F.col("_m").alias("dst"))
    return moved.distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``; component = smallest id in it; singletons included.

    Rounds go on until nothing changes; every round ends in a checkpoint.
    """
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")) \
        .filter(F.col("src") != F.col("dst")).distinct()
    e = materialize(e)
    while True:
        n_edges = e.count()
        nxt = materialize(_small_star(_large_star(e, n_edges), n_edges))
        changed = nxt.join(e, ["src", "dst"], "left_anti").limit(1).count() + \
            e.join(nxt, ["src", "dst"], "left_anti").limit(1).count()
        e = nxt
        if changed == 0:
            break
    star = e.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return (nodes.select("id").join(star, "id", "left")
            .select("id", F.coalesce("component", "id").alias("component")))


def pseudo_labels(components: DataFrame, tile_size: int = P.DEFAULT_TILE) -> DataFrame:
    """Closure: every pair ``(id1, id2)`` inside a component (skew-safe tiling)."""
    return P.group_self_pairs(components, ["component"], "id", tile_size=tile_size)


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
