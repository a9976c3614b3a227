"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a map-side combined minimum per vertex and a join back, so a hub with many links never
meets in one task; what moves is two ids a link. Steps are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmer.llm.shared import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    to_low = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return to_low.union(low.filter("u != m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    `edges` has two columns of ids, in any order and direction; self links and repeats are ignored,
    rows with a null end too. Stops when a round changes no link, which takes about the logarithm
    of the longest chain.
    """
    a, b = edges.columns[:2]
    links = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    )
    state = None
    for _ in range(max_rounds):
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.col("v") % 1000003).cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
