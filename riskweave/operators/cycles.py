"""Longest simple cycles of communities, up to eight accounts, without listing paths.

A cycle is cut at its least account and at the one half way round. Both halves grow
by joins, one edge a step, up to four edges. Of the half-paths between two accounts
only a representative family is kept: so many sets of inner accounts that, whichever
accounts the rest of the cycle uses, one set is kept that avoids them if any does. A
family of sets of size p is representative against q other accounts with at most
1 + q + ... + q^p sets, so there are at most 40 a pair of accounts, however many
paths lead from one to the other. Halves meet where an inner account of neither is
in the other.

As a rule that isn't needed: a cycle of the greatest length is met by a few paths out
of an account and a few into it. Communities where that finds one are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskweave.operators.graph import cut

BOUND = 8
SALTS = 16
#: A search follows so many edges of an account, keeps so many paths for the root of a community's accounts, and compares so many between two accounts.
WAYS, PATHS, BETWEEN = 8, 8, 64


def representatives(sets: list[frozenset], others: int) -> list[frozenset]:
    """Of sets of one size, those that matter: for any `others` elements that some set avoids, one of these does."""
    if not sets:
        return []
    first = sets[0]
    if not others or not first:
        return [first]
    kept = {first}
    for x in first:
        kept.update(representatives([s for s in sets if x not in s], others - 1))
    return sorted(kept, key=sorted)


def _reduced(others: int):
    @pandas_udf("array<array<long>>")
    def family(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for listed in columns:
            yield listed.map(lambda sets: [sorted(s) for s in representatives(sorted({frozenset(s) for s in sets}, key=sorted), others)])

    return family


def _families(found: DataFrame, others: int) -> DataFrame:
    """found (community, start, end, inner) with a representative family of inner for each pair; first by a part of them, so that no list is as long as a hub has partners."""
    for by in (["community", "start", "end", "_salt"], ["community", "start", "end"]):
        salted = found.withColumn("_salt", F.pmod(F.xxhash64("inner"), F.lit(SALTS))) if "_salt" in by else found
        listed = salted.groupBy(*by).agg(F.collect_set("inner").alias("sets"))
        # A single set is its own family.
        family = F.when(F.size("sets") == 1, F.col("sets")).otherwise(_reduced(others)("sets"))
        found = listed.select("community", "start", "end", F.explode(family).alias("inner"))
    return found


def _grown(halves: DataFrame, steps: DataFrame, step: int, bound: int, least: bool) -> DataFrame:
    """Half-paths one edge longer. steps: community, a, b. With least, accounts on the way are over the start."""
    longer = halves.join(steps, (halves["community"] == steps["community"]) & (halves["end"] == steps["a"])).drop(steps["community"])
    new = F.col("b")
    longer = longer.where((new > F.col("start")) if least else (new != F.col("start"))).where(~F.array_contains("inner", new))
    longer = longer.select("community", "start", new.alias("end"), F.array_sort(F.array_append("inner", F.col("end"))).alias("inner"))
    return cut(_families(longer, bound - 1 - step))


def _lengths(edges: DataFrame, starts: DataFrame, bound: int, least: bool) -> DataFrame:
    """community, length of the longest cycle of up to bound accounts through one of starts (as its least account, with least)."""
    none = F.array().cast("array<long>")
    ahead = edges.select("community", F.col("u").alias("a"), F.col("v").alias("b"))
    back = edges.select("community", F.col("v").alias("a"), F.col("u").alias("b"))
    first = lambda steps: cut(steps.join(starts.select("community", F.col("account").alias("a")), ["community", "a"]).where(F.col("b") > F.col("a") if least else F.lit(True)).select("community", F.col("a").alias("start"), F.col("b").alias("end"), none.alias("inner")))
    there, home = {1: first(ahead)}, {1: first(back)}
    found = []
    for length in range(2, bound + 1):
        p, q = (length + 1) // 2, length // 2
        for halves, steps, size in ((there, ahead, p), (home, back, q)):
            if size not in halves:
                halves[size] = _grown(halves[size - 1], steps, size, bound, least)
        x, y = there[p], home[q].withColumnRenamed("inner", "other")
        met = x.join(y, ["community", "start", "end"]).where(~F.arrays_overlap("inner", "other"))
        found.append(met.select("community").distinct().withColumn("length", F.lit(length)))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return cut(out.groupBy("community").agg(F.max("length").alias("length")))


def _few(rows: DataFrame, by: list[str], order: str, cap: int) -> DataFrame:
    """At most cap rows for each of by, by hash of order."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(order), order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def _sought(edges: DataFrame, degree: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    """community: those in which a search finds a cycle of bound accounts through one of starts; others may have one all the same.

    Its rows grow with the accounts at most, and in a large community with their root.
    """
    n = degree.groupBy("community").agg(F.count("*").alias("n"))
    room = cut(n.select("community", F.least(F.col("n"), F.ceil(PATHS * F.sqrt("n"))).alias("room")))
    halves = []
    for a, b, size in (("u", "v", (bound + 1) // 2), ("v", "u", bound // 2)):
        steps = cut(_few(edges.select("community", F.col(a).alias("a"), F.col(b).alias("b")), ["community", "a"], "b", WAYS))
        walks = starts.select("community", F.array("account").alias("path"))
        for _ in range(size):
            longer = walks.withColumn("a", F.element_at("path", -1)).join(steps, ["community", "a"]).where(~F.array_contains("path", F.col("b")))
            rank = F.row_number().over(W.partitionBy("community").orderBy(F.xxhash64("path"), "path"))
            longer = longer.select("community", F.concat("path", F.array("b")).alias("path")).withColumn("_rank", rank)
            walks = cut(longer.join(room, "community").where(F.col("_rank") <= F.col("room")).select("community", "path"))
        ends = walks.select("community", F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end"), F.slice("path", 2, size - 1).alias("inner"))
        halves.append(_few(ends, ["community", "start", "end"], "inner", BETWEEN))
    there, home = halves
    met = there.join(home.withColumnRenamed("inner", "other"), ["community", "start", "end"]).where(~F.arrays_overlap("inner", "other"))
    return cut(met.select("community").distinct())


def _core(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """edges without those that lead into an account without edges out, or out of one without edges in; a few times over, or until none goes.

    Each step is written out, as the next reads it twice.
    """
    edges = cut(edges.select("community", "u", "v"))
    n = edges.count()
    for _ in range(rounds):
        for a, b in (("u", "v"), ("v", "u")):
            edges = cut(edges.join(edges.select("community", F.col(b).alias(a)).distinct(), ["community", a], "left_semi").select("community", "u", "v"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def longest_cycles(edges: DataFrame, *, bound: int = BOUND, tries: int = 2) -> DataFrame:
    """community, max_cycle_length: the longest simple cycle of 2 to bound (at most 8) accounts; communities without one have no row.

    edges: community, u, v, inside of communities; loops and repetitions don't count.
    Cycles through the `tries` accounts with most edges are sought first, along few
    edges and then along all: communities in which that finds a cycle of bound accounts
    are done. In the others every account is tried as the least of a cycle.
    """
    if not 2 <= bound <= BOUND:
        raise ValueError(f"bound must be from 2 to {BOUND}")
    core = _core(edges.where(F.col("u") != F.col("v")).select("community", "u", "v").distinct())
    degree = cut(core.select("community", F.explode(F.array("u", "v")).alias("account")).groupBy("community", "account").agg(F.count("*").alias("d")))
    top = _most(degree, tries)
    sought = _sought(core, degree, top, bound)
    done = sought.select("community", F.lit(bound).alias("max_cycle_length"))
    left = cut(core.join(sought, "community", "left_anti"))
    if left.isEmpty():
        return done
    quick = _lengths(left, top, bound, least=False)
    full = quick.where(F.col("length") == bound)
    rest = cut(left.join(full, "community", "left_anti"))
    if rest.isEmpty():
        return done.union(quick)
    starts = rest.select("community", F.col("u").alias("account")).distinct()
    each = _lengths(rest, starts, bound, least=True)
    return done.union(full).union(each)


def _most(degree: DataFrame, tries: int) -> DataFrame:
    """The accounts of highest degree of each community, by as many maxima: no task sorts a community."""
    left, out = degree, None
    for _ in range(tries):
        top = cut(left.groupBy("community").agg(F.max(F.struct("d", "account")).alias("top")).select("community", F.col("top.account").alias("account")))
        out = top if out is None else out.union(top)
        left = left.join(top, ["community", "account"], "left_anti")
    return out
