"""Transfer graphs as frames: condensation, degrees, cycles, ranks, communities, paths.

Edges are (u, v) of distinct pairs without loops unless said otherwise. Loops
over the graph write each round to storage (cut), so that a lost executor costs
a reread and plans stay short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.sources.tables import shared_folder

EPS = 1e-9


def cut(df: DataFrame) -> DataFrame:
    """Write df under the folder that driver and executors share, and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def index(txn: DataFrame) -> DataFrame:
    """All accounts with an index in order of id, counted from 0 over two levels so that no task sorts all of them."""
    ids = txn.select(F.col("sender").alias("account")).union(txn.select("receiver")).distinct()
    parts = ids.withColumn("part", F.floor(F.col("account") / 1024))
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("account")) - 1
    return parts.withColumn("i", inside).join(before, F.col("part") == F.col("p")).select("account", (F.col("i") + F.col("ahead")).alias("node_index"))


def condensed(txn: DataFrame) -> DataFrame:
    """u, v, weight (sum of amounts), n: one row a pair, without loops."""
    return txn.where(F.col("sender") != F.col("receiver")).groupBy(F.col("sender").alias("u"), F.col("receiver").alias("v")).agg(F.sum("amount").alias("weight"), F.count("*").alias("n"))


def pairs(txn: DataFrame) -> DataFrame:
    """u, v, weight (sum of amounts), n: one row a pair, loops as well."""
    return txn.groupBy(F.col("sender").alias("u"), F.col("receiver").alias("v")).agg(F.sum("amount").alias("weight"), F.count("*").alias("n"))


def adjacency(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("sender") != F.col("receiver")).select(F.col("sender").alias("u"), F.col("receiver").alias("v")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, u < v."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def degrees(txn: DataFrame) -> DataFrame:
    """Per account: in and out transfers (loops count in both), distinct partners (loops don't)."""
    real = F.col("sender") != F.col("receiver")
    ends = txn.select(F.col("sender").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("from"), F.when(real, F.col("receiver")).alias("to"))
    ends = ends.union(txn.select("receiver", F.lit(1), F.lit(0), F.when(real, F.col("sender")), F.lit(None).cast("long")))
    return ends.groupBy("account").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.countDistinct("from").alias("in_unique"), F.countDistinct("to").alias("out_unique"))


def degrees_of(pairs: DataFrame) -> DataFrame:
    """degrees() of the transfers that pairs() has added up: sums alone, as each pair is one row."""
    real, none = (F.col("u") != F.col("v")).cast("long"), F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("u").alias("account"), none.alias("i"), F.col("n").alias("o"), none.alias("from"), real.alias("to")), F.struct(F.col("v").alias("account"), F.col("n").alias("i"), none.alias("o"), real.alias("from"), none.alias("to")))
    return pairs.select(F.inline(ends)).groupBy("account").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("from").alias("in_unique"), F.sum("to").alias("out_unique"))


def fan_ratio(i: Column, o: Column) -> Column:
    return i / (i + o + EPS)


def fan_concentration(unique: Column, degree: Column) -> Column:
    return F.when(degree > 0, 1 - unique / degree).otherwise(F.lit(0.0))


def scatter_gather(i: Column, o: Column) -> Column:
    low, high = F.least(i, o), F.greatest(i, o)
    return F.pow(low, 2) / (F.pow(high, 2) + EPS) * F.tanh((i + o) / 8)


def volume_asymmetry(i: Column, o: Column) -> Column:
    return (o - i) / (o + i + EPS)


def two_cycles(edges: DataFrame) -> DataFrame:
    """account, two_cycles: partners with edges both ways."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.join(back, ["u", "v"], "left_semi").groupBy(F.col("u").alias("account")).agg(F.count("*").alias("two_cycles"))


def ways(edges: DataFrame) -> DataFrame:
    """x, y of each undirected pair once, x < y, with way: 1 for an edge from x to y, 2 for one back, 3 for both."""
    way = F.when(F.col("u") < F.col("v"), 1).otherwise(2)
    return edges.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), way.alias("way")).groupBy("x", "y").agg(F.sum("way").cast("int").alias("way"))


def triangles(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """a, b, c of each undirected triangle once, with ab, bc, ac: which ways its edges go (1: as named, 2: back, 3: both).

    Pairs are turned from the account with fewer partners to that with more, so
    that an account is the corner of at most about sqrt(2 * pairs) steps out of
    it, however many partners it has. known: ways(edges), if they are known.
    """
    pairs = ways(edges) if known is None else known
    degree = cut(pairs.select(F.explode(F.array("x", "y")).alias("account")).groupBy("account").agg(F.count("*").alias("d")))
    ranked = pairs.join(degree.select(F.col("account").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("account").alias("y"), F.col("d").alias("dy")), "y")
    back = F.struct("dx", "x") > F.struct("dy", "y")
    turned = F.when(back & (F.col("way") < 3), 3 - F.col("way")).otherwise(F.col("way"))
    low, high = F.when(back, F.struct(F.col("dy").alias("d"), F.col("y").alias("id"))).otherwise(F.struct(F.col("dx").alias("d"), F.col("x").alias("id"))), F.when(back, F.struct(F.col("dx").alias("d"), F.col("x").alias("id"))).otherwise(F.struct(F.col("dy").alias("d"), F.col("y").alias("id")))
    return closed(cut(ranked.select(low.alias("low"), high.alias("high"), turned.alias("way"))), "way")


def closed(steps: DataFrame, mark: str) -> DataFrame:
    """a, b, c and the marks ab, bc, ac of each three accounts between all of which there are steps (low, high: structs in whose order steps lead up and that end in id; mark).

    What an account's steps lead to is one list in order, of which the end that comes
    after each of them travels there and is compared with its own list; no wedge is a row.
    """
    each = F.sort_array(F.collect_list(F.struct("high", F.col(mark).alias("mark"))))
    ahead = cut(steps.groupBy(F.col("low.id").alias("at")).agg(each.alias("all")).select("at", F.col("all.high.id").alias("ids"), F.col("all.mark").alias("marks")))
    sent = ahead.where(F.size("ids") > 1).select(F.col("at").alias("a"), "ids", "marks", F.posexplode("ids").alias("_i", "b")).where(F.col("_i") + 1 < F.size("ids"))
    after = lambda c: F.slice(c, F.col("_i") + 2, F.size(c) - F.col("_i") - 1)
    sent = sent.select("a", "b", F.element_at("marks", F.col("_i") + 1).alias("ab"), after("ids").alias("_a_ids"), after("marks").alias("_a_marks"))
    own = ahead.select(F.col("at").alias("b"), F.col("ids").alias("_b_ids"), F.col("marks").alias("_b_marks"))
    both = sent.join(own, "b").withColumn("_met", F.array_intersect("_a_ids", "_b_ids")).where(F.size("_met") > 0)
    each = both.select("a", "b", F.explode("_met").alias("c"), "ab", "_a_ids", "_a_marks", "_b_ids", "_b_marks")
    of = lambda side: F.element_at(f"_{side}_marks", F.array_position(f"_{side}_ids", F.col("c")).cast("int"))
    return each.select("a", "b", "c", "ab", of("b").alias("bc"), of("a").alias("ac"))


def three_cycles(edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """account, three_cycles: directed cycles of three accounts through it; met: triangles(edges), if they are known."""
    goes = lambda c, way: F.col(c).bitwiseAND(way) > 0
    round_ = (goes("ab", 1) & goes("bc", 1) & goes("ac", 2)).cast("int") + (goes("ab", 2) & goes("bc", 2) & goes("ac", 1)).cast("int")
    met = (triangles(edges) if met is None else met).withColumn("n", round_).where(F.col("n") > 0)
    return met.select("n", F.explode(F.array("a", "b", "c")).alias("account")).groupBy("account").agg(F.sum("n").alias("three_cycles"))


def clustering(edges: DataFrame, met: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Local clustering on the undirected graph, 2T / d(d-1); each triangle is met once. met, known: triangles(edges) and ways(edges), if they are known."""
    pairs = undirected(edges) if known is None else known.select(F.col("x").alias("u"), F.col("y").alias("v"))
    corners = (triangles(edges) if met is None else met).select(F.explode(F.array("a", "b", "c")).alias("account")).groupBy("account").agg(F.count("*").alias("t"))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("account")).groupBy("account").agg(F.count("*").alias("d"))
    c = F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0))
    return degree.join(corners, "account", "left").select("account", c.alias("clustering"))


def ego_volumes(txn: DataFrame, micros: int = 7 * 86_400_000_000) -> DataFrame:
    """Amounts in and out of each account over the last days of the data (closed)."""
    last = txn.agg(F.max("us").alias("last"))
    late = txn.join(F.broadcast(last)).where(F.col("us") >= F.col("last") - micros)  # last is one row
    ends = late.select(F.col("sender").alias("account"), F.lit(0.0).alias("i"), F.col("amount").alias("o")).union(late.select("receiver", "amount", F.lit(0.0)))
    return ends.groupBy("account").agg(F.sum("i").alias("ego_in"), F.sum("o").alias("ego_out")).withColumn("asymmetry", volume_asymmetry(F.col("ego_in"), F.col("ego_out")))


def pagerank(weighted: DataFrame, *, damping: float = 0.85, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """account, pagerank: weighted ranks; mass of accounts without edges out is dealt to all.

    After `rounds` rounds, or with a tolerance as soon as the sum of changes in
    three rounds is under tolerance * accounts, if that is earlier.
    """
    nodes = cut(weighted.select(F.col("u").alias("account")).union(weighted.select("v")).distinct())
    n = nodes.count()
    out = weighted.groupBy(F.col("u").alias("o")).agg(F.sum("weight").alias("total"))
    share = cut(weighted.join(out, F.col("u") == F.col("o")).select("u", "v", (F.col("weight") / F.col("total")).alias("share")))
    ends = cut(nodes.join(share.select(F.col("u").alias("account")).distinct(), "account", "left_anti"))
    ranks = held = nodes.withColumn("pagerank", F.lit(1.0 / max(1, n)))
    for turn in range(rounds):
        flow = share.join(ranks, F.col("u") == F.col("account")).groupBy(F.col("v").alias("to")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("flow"))
        lost = ranks.join(ends, "account", "left_semi").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("lost"))
        rank = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)
        ranks = nodes.join(flow, F.col("account") == F.col("to"), "left").join(F.broadcast(lost)).select("account", rank.alias("pagerank"))  # lost is one row
        if turn % 3 == 2:
            ranks = cut(ranks)
            if tolerance is not None:
                moved = ranks.join(held.withColumnRenamed("pagerank", "before"), "account").agg(F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()[0]
                if (moved or 0.0) < tolerance * n:
                    return ranks
                held = ranks
    return ranks


def label_propagation(edges: DataFrame, *, rounds: int = 5, known: DataFrame | None = None) -> DataFrame:
    """account, community: each account takes the commonest label among its partners and itself, the least of equals.

    Takes the place of flow-based community detection, which has no native form.
    Loops only make their account known. known: ways(edges), if they are known.
    """
    pairs = undirected(edges) if known is None else known.select(F.col("x").alias("u"), F.col("y").alias("v"))
    both = cut(pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))))
    labels = cut(both.select(F.col("u").alias("account")).distinct().withColumn("community", F.col("account")))
    both = both.where(F.col("u") != F.col("v"))
    for _ in range(rounds):
        asked = both.join(labels, F.col("v") == F.col("account")).select("u", "community").unionAll(labels.select(F.col("account").alias("u"), "community"))
        votes = asked.groupBy("u", "community").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy(F.col("u").alias("account")).agg(F.min(F.struct(-F.col("n"), "community")).getField("community").alias("community")))
    return labels


def topped_up(communities: DataFrame, accounts: DataFrame) -> DataFrame:
    """communities (account, community) with a community of its own, named after it, for each account that has none."""
    alone = accounts.select("account").distinct().join(communities.select("account"), "account", "left_anti")
    return communities.select("account", "community").unionByName(alone.withColumn("community", F.col("account")))


def weak_components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """account, component (its least account), by passing minima on and shortcutting them."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("account")).agg(F.least(F.min("u"), F.min("v")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, F.col("v") == F.col("account")).groupBy("u").agg(F.min("component").alias("m"))
        moved = labels.join(near, F.col("account") == F.col("u"), "left").select("account", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = moved.select(F.col("account").alias("j"), F.col("component").alias("further"))
        moved = cut(moved.join(jump, F.col("component") == F.col("j"), "left").select("account", F.least("component", F.coalesce("further", "component")).alias("component")))
        if not moved.join(labels, ["account", "component"], "left_anti").limit(1).count():
            return moved
        labels = moved
    raise RuntimeError("weak_components: no fixed point")


def induced(txn: DataFrame, members: DataFrame, column: str = "community") -> DataFrame:
    """Transfers whose ends are different accounts of one community, with that community."""
    a = members.select(F.col("account").alias("sender"), F.col(column).alias(column))
    b = members.select(F.col("account").alias("receiver"), F.col(column).alias("_other"))
    return txn.where(F.col("sender") != F.col("receiver")).join(a, "sender").join(b, "receiver").where(F.col(column) == F.col("_other")).drop("_other")


def community_profiles(txn: DataFrame, members: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a community of two or more: size, density, flow, fans, cycles, Benford, pattern, risk; known: graph_features(txn), if they are known.

    Fans are means over all members of what they have in the whole graph. A
    community has a cycle if a member lies on one of two or three accounts. A
    member is chain-like with at most one partner in and one out inside. Amounts are
    an anomaly if those of the densest part or of the whole community are.
    """
    inner = induced(txn, members)
    size = members.groupBy("community").agg(F.count("*").alias("community_size")).where(F.col("community_size") > 1)
    flow = inner.groupBy("community").agg(F.count("*").alias("edges"), F.sum("amount").alias("total_flow_value"))
    pairs = inner.select("community", F.col("sender").alias("u"), F.col("receiver").alias("v")).distinct()
    ends = pairs.select("community", F.col("u").alias("account"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(pairs.select("community", "v", F.lit(1), F.lit(0)))
    ends = ends.groupBy("account").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    if known is None:
        edges = adjacency(txn)
        on_cycle = two_cycles(edges).select("account").union(three_cycles(edges).select("account")).distinct().withColumn("on_cycle", F.lit(True))
    else:
        on_cycle = known.where((F.col("two_cycles") > 0) | (F.col("three_cycles") > 0)).select("account", F.lit(True).alias("on_cycle"))
    whole = (degrees(txn) if known is None else known).select("account", fan_ratio(F.col("in_unique"), F.col("out_unique")).alias("fan_in"), fan_ratio(F.col("out_unique"), F.col("in_unique")).alias("fan_out"))
    each = members.select("account", "community").join(ends, "account", "left").join(whole, "account", "left").join(on_cycle, "account", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    chain = ((none("i") <= 1) & (none("o") <= 1)).cast("double")
    fans = each.groupBy("community").agg(F.avg(F.coalesce("fan_in", F.lit(0.0))).alias("mean_fan_in"), F.avg(F.coalesce("fan_out", F.lit(0.0))).alias("mean_fan_out"), F.avg(chain).alias("chain_share"), F.max(F.coalesce("on_cycle", F.lit(False))).alias("has_cycle"))
    out = size.join(flow, "community", "left").join(fans, "community", "left").join(dense_benford(txn, members).select("community", "benford_anomaly"), "community", "left")
    n = F.col("community_size")
    out = out.select("community", "community_size", (F.coalesce("edges", F.lit(0)) / (n * (n - 1))).alias("community_density"), F.coalesce("total_flow_value", F.lit(0.0)).alias("total_flow_value"), F.coalesce("mean_fan_in", F.lit(0.0)).alias("mean_fan_in"), F.coalesce("mean_fan_out", F.lit(0.0)).alias("mean_fan_out"), F.coalesce("chain_share", F.lit(0.0)).alias("chain_share"), F.coalesce("has_cycle", F.lit(False)).alias("has_cycle"), F.coalesce("benford_anomaly", F.lit(False)).alias("benford_anomaly"))
    pattern = F.when(F.col("has_cycle"), "circular").when(F.col("mean_fan_in") > 0.7, "fan_in").when(F.col("mean_fan_out") > 0.7, "fan_out").when(F.col("chain_share") > 0.5, "layering_chain").otherwise("mixed")
    largest = size.agg(F.max("community_size").alias("_largest"))
    risk = 100 * (0.25 * S.clamp(F.col("community_density"), 0, 1) + 0.30 * F.col("has_cycle").cast("double") + 0.25 * F.col("benford_anomaly").cast("double") + 0.20 * F.log(n + 1) / F.log(F.col("_largest") + 1))
    out = out.join(F.broadcast(largest))  # largest is one row
    return out.select(*[c for c in out.columns if c != "_largest"], pattern.alias("dominant_pattern"), S.clamp(risk, 0, 100).alias("community_risk_score"))


def prefixes(edges: DataFrame, *, length: int, cap: int) -> DataFrame:
    """start, path of simple paths with length - 1 edges that the first `cap` paths with `length` edges of each start can begin with.

    At each step those go that stand behind prefixes sure to give `cap` paths, and those
    from which no walk of the edges that are left leads on. What an account is sure to
    give, whichever accounts lie on the way to it, is what its partners are sure to,
    less the best of them for each account on the way.
    """
    sure = {}
    for left in range(1, length):
        given = edges.withColumn("_sure", F.lit(1)) if left == 1 else edges.join(sure[left - 1].withColumnRenamed("_end", "v"), "v")
        given = given.groupBy(F.col("u").alias("_end")).agg(F.sum("_sure").alias("_all"), F.max("_sure").alias("_best"))
        sure[left] = cut(given.select("_end", F.greatest(F.lit(0), F.col("_all") - (length - left) * F.col("_best")).alias("_sure")))
    step = edges.toDF("a", "b")
    found = edges.select(F.col("u").alias("start"), F.array("u", "v").alias("path"))
    for left in range(length - 1, 0, -1):
        found = found.join(sure[left], F.element_at("path", -1) == F.col("_end"))
        ahead = F.sum("_sure").over(W.partitionBy("start").orderBy("path").rowsBetween(W.unboundedPreceding, -1))
        found = found.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("_ahead") < cap).select("start", "path")
        if left > 1:
            on = step.join(sure[left - 1], F.col("b") == F.col("_end"), "left_semi")
            found = found.join(on, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("start", F.concat("path", F.array("b")).alias("path"))
    return found


def paths(edges: DataFrame, *, length: int = 3, cap: int = 50) -> DataFrame:
    """start, path (accounts) of simple paths with `length` edges, the first `cap` of each start by order; see prefixes()."""
    edges = cut(edges.select("u", "v"))
    found, step = prefixes(edges, length=length, cap=cap), edges.toDF("a", "b")
    if length > 1:
        found = found.join(step, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("start", F.concat("path", F.array("b")).alias("path"))
    rank = F.row_number().over(W.partitionBy("start").orderBy("path"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def path_values(found: DataFrame, txn: DataFrame) -> DataFrame:
    """found with total_value and path_edges: the largest transfer of each step."""
    best = txn.where(F.col("sender") != F.col("receiver")).groupBy(F.col("sender").alias("u"), F.col("receiver").alias("v")).agg(F.max(F.struct("amount", "tx_id")).alias("best"))
    steps = found.select("path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i")).select("path", "i", F.element_at("path", F.col("i")).alias("u"), F.element_at("path", F.col("i") + 1).alias("v"))
    return steps.join(best, ["u", "v"]).groupBy("path").agg(F.sum("best.amount").alias("total_value"), F.array_sort(F.collect_list(F.struct("i", F.col("best.tx_id").alias("tx_id"))))["tx_id"].alias("path_edges"))


def neighbourhood(edges: DataFrame, centre: int, hops: int = 2, cap: int = 80) -> DataFrame:
    """account, hop: accounts within some hops of one, against and along edges, the nearest `cap`."""
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct()
    seen = edges.sparkSession.createDataFrame([(centre, 0)], "account long, hop int")
    for hop in range(1, hops + 1):
        near = both.join(seen.where(F.col("hop") == hop - 1), F.col("u") == F.col("account")).select(F.col("v").alias("account"), F.lit(hop).alias("hop")).distinct()
        seen = seen.union(near.join(seen.select("account"), "account", "left_anti"))
    return seen.orderBy("hop", "account").limit(cap)


def neighbourhood_edges(edges: DataFrame, centre: int, hops: int = 2, cap: int = 200) -> DataFrame:
    """u, v: the edges between the accounts of a neighbourhood (the nearest `cap`)."""
    near = cut(neighbourhood(edges, centre, hops, cap)).select("account")
    return edges.select("u", "v").distinct().join(near.withColumnRenamed("account", "u"), "u", "left_semi").join(near.withColumnRenamed("account", "v"), "v", "left_semi").select("u", "v")


def betweenness(edges: DataFrame, *, sources: int | None = 300, distinct: bool = False) -> DataFrame:
    """account, betweenness: shortest-path dependencies from `sources` accounts (by hash; None: from all), scaled to all and normalised.

    Breadth first from each source and back: one by one in tasks that hold the graph
    (operators/brandes.py), or all at once in matrices of accounts by sources where it
    has more edges than that (operators/shortest.py). Accounts on no path have 0.
    distinct: edges are known to be so, and no loops.
    """
    from riskweave.operators import brandes, shortest

    steps = edges if distinct else cut(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    nodes = cut(edges.select(F.col("u").alias("account")).union(edges.select("v")).distinct())
    n, m = nodes.count(), steps.count()
    many = n if sources is None else min(sources, n)
    scale = n / max(1, many) / max(1, (n - 1) * (n - 2))
    found = (brandes.dependencies if m <= brandes.WHOLE else shortest.in_turns)(steps, nodes, many, m)
    return found.select("account", (F.col("part") * scale).alias("betweenness"))


def densest(inner: DataFrame, *, eps: float = 0.1, by: str = "pairs", rounds: int = 200) -> DataFrame:
    """community, account, density: the members of the densest part of each community, found by peeling in batches.

    inner: community, u, v, one row a transfer; repeated transfers count each. In a
    round all accounts go that have at most 1 + eps times the mean number of
    transfers; that is more than half of them or nearly so, and rounds grow with the
    logarithm of the accounts. All communities are peeled at once, as joins; no task
    holds a community. Density is transfers / (n * (n - 1)), or with by="accounts"
    transfers / n, for which what is found is at least 1 / (2 + 2 * eps) of the
    densest part there is. Among equal densities the larger part holds.
    """
    if by not in ("pairs", "accounts"):
        raise ValueError(f"by must be pairs or accounts, not {by!r}")
    left = cut(inner.where(F.col("u") != F.col("v")).groupBy("community", "u", "v").agg(F.count("*").alias("n")))
    gone, sizes = [], []
    for turn in range(rounds):
        degree = left.select("community", "n", F.explode(F.array("u", "v")).alias("account")).groupBy("community", "account").agg(F.sum("n").alias("d"))
        degree = cut(degree)
        size = cut(degree.groupBy("community").agg(F.count("*").alias("accounts"), (F.sum("d") / 2).alias("transfers")).withColumn("turn", F.lit(turn)))
        if size.isEmpty():
            break
        sizes.append(size)
        mean = size.select("community", ((1 + eps) * 2 * F.col("transfers") / F.col("accounts")).alias("most"))
        out = cut(degree.join(mean, "community").where(F.col("d") <= F.col("most")).select("community", "account", F.lit(turn).alias("turn")))
        gone.append(out)
        off = lambda c, out=out: out.select("community", F.col("account").alias(c))
        after = left.join(off("u"), ["community", "u"], "left_anti").join(off("v"), ["community", "v"], "left_anti").select("community", "u", "v", "n")
        # Accounts that lose all partners without being peeled leave with the next round's start: they have no transfers left.
        kept = degree.join(out, ["community", "account"], "left_anti").select("community", "account")
        left = cut(after)
        alive = left.select("community", F.explode(F.array("u", "v")).alias("account")).distinct()
        gone.append(cut(kept.join(alive, ["community", "account"], "left_anti").withColumn("turn", F.lit(turn))))
    else:
        raise RuntimeError("densest: accounts are left")
    if not sizes:
        return inner.select("community", F.col("u").alias("account"), F.lit(0.0).alias("density"))
    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[: len(frames) // 2]).union(union(frames[len(frames) // 2 :]))
    n, m = F.col("accounts"), F.col("transfers")
    density = m / (n * (n - 1)) if by == "pairs" else m / n
    best = union(sizes).groupBy("community").agg(F.min(F.struct((-density).alias("less"), "turn")).alias("best"))
    return union(gone).join(best, "community").where(F.col("turn") >= F.col("best.turn")).select("community", "account", (-F.col("best.less")).alias("density"))


def dense_benford(txn: DataFrame, members: DataFrame, **peeling) -> DataFrame:
    """community, densest_size, densest_density, benford_chi2_densest, benford_chi2_community, benford_anomaly of each community with transfers inside.

    The anomaly is a distance over 3.84 among the transfers of the densest part (in
    communities of over two members), or else among all of the community.
    """
    inner = cut(induced(txn, members).select("community", F.col("sender").alias("u"), F.col("receiver").alias("v"), "amount"))
    part = cut(densest(inner, **peeling))
    ends = lambda c: part.select("community", F.col("account").alias(c))
    counts = [F.sum((S.leading_digit(F.col("amount")) == d).cast("int")) for d in range(1, 10)]
    inside = inner.join(ends("u"), ["community", "u"], "left_semi").join(ends("v"), ["community", "v"], "left_semi")
    inside = inside.groupBy("community").agg(S.benford_chi2(counts).alias("chi2"))
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    out = inner.groupBy("community").agg(S.benford_chi2(counts).alias("benford_chi2_community")).join(inside, "community", "left").join(size, "community")
    out = out.join(part.groupBy("community").agg(F.count("*").alias("densest_size"), F.max("density").alias("densest_density")), "community", "left")
    chi2 = F.when(F.col("members") > 2, F.coalesce("chi2", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("community", "densest_size", "densest_density", chi2.alias("benford_chi2_densest"), "benford_chi2_community", ((chi2 > 3.84) | (F.col("benford_chi2_community") > 3.84)).alias("benford_anomaly"))


#: The features of an account in their canonical order (fixed values), but for its id.
GRAPH_FEATURES = (
    "in_degree", "out_degree", "in_unique", "out_unique", "pagerank", "betweenness", "clustering", "two_cycles", "three_cycles", "fan_in_ratio", "fan_out_ratio", "scatter_gather",
    "community", "community_size", "community_density", "ego_in", "ego_out", "asymmetry", "benford_chi2_community",
)


def _laid(txn: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs() of txn, its edges, and their ways(): each is written once, for all that is told of the graph."""
    every = cut(pairs(txn))
    edges = every.where(F.col("u") != F.col("v")).select("u", "v")
    return every, edges, cut(ways(edges))


def exact_features(txn: DataFrame, laid: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row an account: degrees, fans, cycles, clustering and volumes."""
    (every, edges, known), i, o = laid or _laid(txn), F.col("in_unique"), F.col("out_unique")
    out, met = degrees_of(every), cut(triangles(edges, known))
    back = known.where("way = 3").select(F.explode(F.array("x", "y")).alias("account")).groupBy("account").agg(F.count("*").alias("two_cycles"))
    for part in (back, three_cycles(edges, met), clustering(edges, met, known), ego_volumes(txn)):
        out = out.join(part, "account", "left")
    return out.na.fill(0).select("*", fan_ratio(i, o).alias("fan_in_ratio"), fan_ratio(o, i).alias("fan_out_ratio"), scatter_gather(i, o).alias("scatter_gather"))


def graph_features(txn: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row an account with GRAPH_FEATURES; communities (account, community) are found by label propagation unless given."""
    txn = cut(txn.select("sender", "receiver", "amount", "us"))
    every, edges, known = laid = _laid(txn)
    out = cut(exact_features(txn, laid))
    members = cut(topped_up(label_propagation(edges, known=known) if communities is None else communities, out))
    inner = induced(txn, members)
    counts = [F.sum((S.leading_digit(F.col("amount")) == d).cast("int")) for d in range(1, 10)]
    n = F.col("community_size")
    each = members.groupBy("community").agg(F.count("*").alias("community_size")).join(inner.groupBy("community").agg(F.count("*").alias("_edges"), S.benford_chi2(counts).alias("benford_chi2_community")), "community", "left")
    each = each.select("community", "community_size", F.when(n > 1, F.coalesce("_edges", F.lit(0)) / (n * (n - 1))).otherwise(F.lit(0.0)).alias("community_density"), F.coalesce("benford_chi2_community", F.lit(0.0)).alias("benford_chi2_community"))
    ranks = pagerank(every.where(F.col("u") != F.col("v")))
    out = out.join(members.join(each, "community"), "account").join(ranks, "account", "left").join(betweenness(edges, distinct=True), "account", "left")
    return out.na.fill(0).select("account", *GRAPH_FEATURES)


def with_graph_features(txn: DataFrame, features: DataFrame, columns: tuple[str, ...] = GRAPH_FEATURES, prefix: str = "g_") -> DataFrame:
    """txn with its sender's features as prefixed columns, 0 where the sender has none."""
    mine = features.select(F.col("account").alias("_account"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return txn.join(mine, F.col("sender") == F.col("_account"), "left").drop("_account").na.fill(0, [f"{prefix}{c}" for c in columns])
