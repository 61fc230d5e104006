"""Communities of directed, weighted flow by the map equation.

A walker follows transfers with chances by their amounts. The code length of its
steps, told with one book a community and one for changes between them, is least
where communities hold the walker for long. Accounts move to the community of a
partner where that shortens the code; in a round half of them may move, each on its
own, so that a round is a few joins. A round that doesn't shorten the code as a
whole is taken back, and fewer accounts may move in the next. When none helps any
more, communities become accounts of a smaller graph, and the same begins again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.graph import cut, pagerank

LEAST_GAIN = 1e-9


def plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def flows(weighted: DataFrame, *, damping: float = 0.85) -> DataFrame:
    """u, v, f: the walker's share of steps over each link (u <> v), summing up to 1. weighted: u, v, weight."""
    weighted = cut(weighted.where((F.col("u") != F.col("v")) & (F.col("weight") > 0)).groupBy("u", "v").agg(F.sum("weight").alias("weight")))
    ranks = pagerank(weighted, damping=damping, rounds=60, tolerance=1e-6)
    out = weighted.groupBy(F.col("u").alias("o")).agg(F.sum("weight").alias("total"))
    steps = weighted.join(out, F.col("u") == F.col("o")).join(ranks, F.col("u") == F.col("account"))
    steps = cut(steps.select("u", "v", (F.col("pagerank") * F.col("weight") / F.col("total")).alias("f")))
    total = steps.agg(F.sum("f").alias("all"))
    return steps.join(F.broadcast(total)).select("u", "v", (F.col("f") / F.col("all")).alias("f"))  # total is one row


def _nodes(links: DataFrame, own: DataFrame) -> DataFrame:
    """node, p, out, into: of the nodes in own (node, p), with what goes out of them and into them over links."""
    ends = links.select(F.col("u").alias("node"), F.col("f").alias("out"), F.lit(0.0).alias("into")).union(links.select("v", F.lit(0.0), "f"))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return cut(own.join(sums, "node", "left").select("node", "p", F.coalesce("out", F.lit(0.0)).alias("out"), F.coalesce("into", F.lit(0.0)).alias("into")))


def _modules(nodes: DataFrame, links: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """module, p, exit, enter; and the links between modules (mu, mv, f)."""
    at = lambda node, name: placed.select(F.col("node").alias(node), F.col("module").alias(name))
    across = links.join(at("u", "mu"), "u").join(at("v", "mv"), "v").where(F.col("mu") != F.col("mv")).groupBy("mu", "mv").agg(F.sum("f").alias("f"))
    ends = across.select(F.col("mu").alias("module"), F.lit(0.0).alias("p"), F.col("f").alias("exit"), F.lit(0.0).alias("enter")).union(across.select("mv", F.lit(0.0), F.lit(0.0), "f"))
    ends = ends.union(nodes.join(placed, "node").select("module", "p", F.lit(0.0), F.lit(0.0)))
    return cut(ends.groupBy("module").agg(F.sum("p").alias("p"), F.sum("exit").alias("exit"), F.sum("enter").alias("enter"))), across


def code_length(modules: DataFrame, leaves: float) -> tuple[float, float]:
    """Bits a step, and the walker's changes of module; leaves: the sum of p log p over accounts."""
    row = modules.agg(F.sum("enter").alias("q"), F.sum(plogp(F.col("enter"))).alias("enter"), F.sum(plogp(F.col("exit"))).alias("exit"), F.sum(plogp(F.col("exit") + F.col("p"))).alias("both")).first()
    q = row["q"] or 0.0
    return (q * math.log2(q) if q > 0 else 0.0) - (row["enter"] or 0.0) - (row["exit"] or 0.0) + (row["both"] or 0.0) - leaves, q


def _moves(nodes: DataFrame, links: DataFrame, placed: DataFrame, modules: DataFrame, q: float, turn: int, parts: int) -> DataFrame:
    """node, module: the best other module for each node whose turn it is, where that shortens the code."""
    to = links.join(placed.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "module", F.col("f").alias("to"), F.lit(0.0).alias("from"))
    back = links.join(placed.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), "module", F.lit(0.0).alias("to"), F.col("f").alias("from"))
    near = to.union(back).groupBy("node", "module").agg(F.sum("to").alias("to"), F.sum("from").alias("from"))
    mine = nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == turn % parts).join(placed.withColumnRenamed("module", "own"), "node")
    met = mine.join(near, "node").where(F.col("module") != F.col("own"))
    held = near.select("node", F.col("module").alias("own"), F.col("to").alias("to_own"), F.col("from").alias("from_own"))
    met = met.join(held, ["node", "own"], "left").na.fill(0.0, ["to_own", "from_own"])
    stats = lambda name, mark: modules.select(F.col("module").alias(name), *[F.col(c).alias(f"{c}_{mark}") for c in ("p", "exit", "enter")])
    met = met.join(stats("own", "a"), "own").join(stats("module", "b"), "module")
    c = F.col
    least = lambda x: F.greatest(x, F.lit(0.0))
    exit_a, enter_a = least(c("exit_a") - (c("out") - c("to_own")) + c("from_own")), least(c("enter_a") - (c("into") - c("from_own")) + c("to_own"))
    exit_b, enter_b = least(c("exit_b") + (c("out") - c("to")) - c("from")), least(c("enter_b") + (c("into") - c("from")) - c("to"))
    p_a, p_b = least(c("p_a") - c("p")), c("p_b") + c("p")
    now = -plogp(c("enter_a")) - plogp(c("enter_b")) - plogp(c("exit_a")) - plogp(c("exit_b")) + plogp(c("exit_a") + c("p_a")) + plogp(c("exit_b") + c("p_b")) + plogp(F.lit(q))
    then = -plogp(enter_a) - plogp(enter_b) - plogp(exit_a) - plogp(exit_b) + plogp(exit_a + p_a) + plogp(exit_b + p_b) + plogp(least(F.lit(q) - c("enter_a") - c("enter_b") + enter_a + enter_b))
    best = met.withColumn("gain", now - then).where(F.col("gain") > 1e-10).groupBy("node").agg(F.max(F.struct("gain", (-c("module")).alias("less"))).alias("best"))
    return cut(best.select("node", (-F.col("best.less")).alias("module")))


def flow_communities(weighted: DataFrame, *, damping: float = 0.85, turns: int = 16, least_share: int = 8) -> tuple[DataFrame, list[float]]:
    """account, community (its least account); and the code length at the start and after each round that shortened it.

    weighted: u, v, weight (several rows of a pair add up; loops and weights of zero
    don't count). Accounts without a link to others have no row. Equal inputs give
    equal communities. At most 1 / least_share of the accounts is tried in the last
    rounds of a level, and at most `turns` rounds are made on each.
    """
    links = cut(flows(weighted, damping=damping))
    own = links.select(F.col("v").alias("node"), F.col("f").alias("p")).union(links.select("u", F.lit(0.0))).groupBy("node").agg(F.sum("p").alias("p"))
    nodes = _nodes(links, own)
    leaves = nodes.agg(F.sum(plogp(F.col("p")))).first()[0] or 0.0
    tree = nodes.select(F.col("node").alias("account"), F.col("node").alias("community"))
    lengths: list[float] = []
    while True:
        placed = cut(nodes.select("node", F.col("node").alias("module")))
        modules, across = _modules(nodes, links, placed)
        length, q = code_length(modules, leaves)
        lengths = lengths or [length]
        moved, parts, idle = False, 2, 0
        for turn in range(turns):
            moves = _moves(nodes, links, placed, modules, q, turn, parts)
            if moves.isEmpty():
                idle += 1
                if idle >= parts:
                    break
                continue
            after = cut(placed.join(moves.withColumnRenamed("module", "to"), "node", "left").select("node", F.coalesce("to", "module").alias("module")))
            new_modules, new_across = _modules(nodes, links, after)
            new_length, new_q = code_length(new_modules, leaves)
            if new_length < length - LEAST_GAIN:
                placed, modules, across, length, q, moved, idle = after, new_modules, new_across, new_length, new_q, True, 0
                lengths.append(length)
            else:
                parts, idle = parts * 2, 0
                if parts > least_share:
                    break
        if not moved:
            break
        tree = cut(tree.join(placed, F.col("community") == F.col("node")).select("account", F.col("module").alias("community")))
        links = cut(across.select(F.col("mu").alias("u"), F.col("mv").alias("v"), "f"))
        nodes = _nodes(links, modules.select(F.col("module").alias("node"), "p"))
    names = tree.groupBy("community").agg(F.min("account").alias("least"))
    return tree.join(names, "community").select("account", F.col("least").alias("community")), lengths
