"""Connected components by alternating large-star and small-star.

Large-star links each node's larger neighbours to its least neighbour; small-star
links each node and its smaller neighbours to the least of them. Repeated in
turn, edges become stars around the least node of each component, in a number of
rounds that grows with the logarithm of the longest path.

Scale: each step is a grouped minimum, combined before the shuffle, joined back
to the edges. A node with very many edges is a skewed join key, which adaptive
execution splits. Every round is written to the shared folder. The driver sees
two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, from edges (u, v) of any ordered type.

    Returns node, component (its least node), for nodes with an edge to another.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    edges = materialise(edges.select("u", "v").where((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull()), "edges")
    state = None
    for _ in range(rounds):
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
