"""Profiles of communities with their longest cycles and members, and the paths that make them suspicious."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.operators.cycles import BOUND, longest_cycles
from riskweave.operators.graph import community_profiles, cut, induced, path_values


def _first(found: DataFrame, cap: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("community").orderBy("path"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def short_cycles(edges: DataFrame, *, cap: int = 50, longest: int = BOUND) -> DataFrame:
    """community, path: simple cycles of 2 to `longest` accounts by length, then order, the first `cap` of each community.

    edges: community, u, v. A path begins and ends with its least account. One length
    is done after the other, and communities leave as soon as they have enough.
    """
    steps = cut(edges.where(F.col("u") != F.col("v")).select("community", "u", "v").distinct())
    back = steps.select("community", F.col("u").alias("_end"), F.col("v").alias("_start"))
    walks = steps.where(F.col("v") > F.col("u")).select("community", F.array("u", "v").alias("path"))
    found, counts = None, None
    for length in range(2, longest + 1):
        met = walks.select("community", "path", F.element_at("path", 1).alias("_start"), F.element_at("path", -1).alias("_end")).join(back, ["community", "_start", "_end"])
        closed = cut(_first(met.select("community", F.concat("path", F.array("_start")).alias("path")), cap).withColumn("length", F.lit(length)))
        found = closed if found is None else found.union(closed)
        if length == longest:
            break
        counts = found.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= cap)
        longer = walks.join(counts, "community", "left_anti").withColumn("u", F.element_at("path", -1)).join(steps, ["community", "u"])
        walks = cut(longer.where((F.col("v") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("v"))).select("community", F.concat("path", F.array("v")).alias("path")))
        if walks.isEmpty():
            break
    rank = F.row_number().over(W.partitionBy("community").orderBy("length", "path"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= cap).select("community", "path", "length")


def chain_paths(edges: DataFrame, *, cap: int = 50, longest: int = BOUND) -> DataFrame:
    """community, path, length: simple paths of 2 to `longest` edges from accounts without edges in to those without edges out, by length, then order, the first `cap` of each community.

    Where a community has none of either, its three accounts with most edges out and in
    take their place.
    """
    steps = cut(edges.where(F.col("u") != F.col("v")).select("community", "u", "v").distinct())
    ends = steps.select("community", F.explode(F.array(F.struct(F.col("u").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    degree = cut(ends.groupBy("community", F.col("e.account").alias("account")).agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")))
    rank = lambda c: F.row_number().over(W.partitionBy("community").orderBy(F.desc(c), "account"))
    plain = degree.groupBy("community").agg((F.max((F.col("i") == 0).cast("int")) * F.max((F.col("o") == 0).cast("int"))).alias("plain"))
    marked = degree.join(plain, "community").select("*", rank("o").alias("by_o"), rank("i").alias("by_i"))
    sources = marked.where(F.when(F.col("plain") == 1, F.col("i") == 0).otherwise(F.col("by_o") <= 3)).select("community", F.col("account").alias("u"))
    sinks = cut(marked.where(F.when(F.col("plain") == 1, F.col("o") == 0).otherwise(F.col("by_i") <= 3)).select("community", F.col("account").alias("_end")))
    walks = cut(steps.join(sources, ["community", "u"]).select("community", F.array("u", "v").alias("path")))
    found = None
    for length in range(2, longest + 1):
        longer = walks.withColumn("u", F.element_at("path", -1)).join(steps, ["community", "u"])
        if found is not None:
            longer = longer.join(found.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= cap), "community", "left_anti")
        walks = cut(longer.where(~F.array_contains("path", F.col("v"))).select("community", F.concat("path", F.array("v")).alias("path")))
        if walks.isEmpty():
            break
        met = walks.withColumn("_end", F.element_at("path", -1)).join(sinks, ["community", "_end"])
        met = cut(_first(met.select("community", "path"), cap).withColumn("length", F.lit(length)))
        found = met if found is None else found.union(met)
    if found is None:
        return walks.select("community", "path", F.lit(0).alias("length")).where("false")
    rank = F.row_number().over(W.partitionBy("community").orderBy("length", "path"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= cap).select("community", "path", "length")


def profiles_and_paths(txn: DataFrame, members: DataFrame, *, cap: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Community profiles with max_cycle_length; members (community, account) of those; and suspicious paths.

    A path has community, path (accounts), path_length, pattern_type (round_trip in
    circular communities, layering_chain in chains), total_value and path_edges, the
    largest transfer of each step.
    """
    profiles = cut(community_profiles(txn, members))
    edges = cut(induced(txn, members).select("community", F.col("sender").alias("u"), F.col("receiver").alias("v")).distinct())
    of = lambda flag: edges.join(profiles.where(flag).select("community"), "community", "left_semi")
    lengths = longest_cycles(of(F.col("has_cycle")))
    profiles = profiles.join(lengths, "community", "left").withColumn("max_cycle_length", F.coalesce("max_cycle_length", F.lit(0)))
    rounds = short_cycles(of(F.col("dominant_pattern") == "circular"), cap=cap).withColumn("pattern_type", F.lit("round_trip"))
    chains = chain_paths(of(F.col("dominant_pattern") == "layering_chain"), cap=cap).withColumn("pattern_type", F.lit("layering_chain"))
    paths = cut(rounds.union(chains))
    valued = path_values(paths.select("path").distinct(), txn)
    paths = paths.join(valued, "path").select("community", "path", F.col("length").alias("path_length"), "pattern_type", "total_value", "path_edges")
    return profiles, members.join(profiles.select("community"), "community", "left_semi"), paths
