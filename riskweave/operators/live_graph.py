"""Graph features of a transfer as of its own time.

The transfer itself counts in degrees and in the receiver's inflow; it doesn't in
the cycle it may close nor as the sender's last inflow. Nothing later counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.operators.behaviour import count_distinct, mean_of, moments, running_sums, spread_of, trailing_sums
from riskweave.operators.graph import closed, cut
from riskweave.operators.openings import openings

DAY = 86_400_000_000
FOREVER = float("inf")


def ends(txn: DataFrame) -> DataFrame:
    """Each transfer twice: node, partner and role (in, out)."""
    out = txn.select("tx_id", "us", "amount", F.col("sender").alias("node"), F.col("receiver").alias("partner"), F.lit("out").alias("role"))
    return out.union(txn.select("tx_id", "us", "amount", "receiver", "sender", F.lit("in")))


def fan_in(txn: DataFrame) -> DataFrame:
    """txn with in_unique_24h and inflow_cv: sources and spread of the receiver's last day; under two inflows the spread is 999."""
    out = count_distinct(trailing_sums(txn, "receiver", moments("_day", DAY)), "receiver", "sender", DAY, "in_unique_24h", dealt=True)
    day = [F.col(f"_day_{c}") for c in ("n", "sum", "sq")]
    cv = spread_of(*day) / (mean_of(*day[:2]) + 1e-9)
    return out.select("*", F.when(day[0] < 2, F.lit(999.0)).otherwise(cv).alias("inflow_cv")).drop("_day_n", "_day_sum", "_day_sq")


def receiver_day(txn: DataFrame) -> DataFrame:
    """tx_id and what fan_in() adds; no other column of txn is shuffled."""
    return fan_in(txn.select("tx_id", "us", "sender", "receiver", "amount")).select("tx_id", "in_unique_24h", "inflow_cv")


def sender_history(txn: DataFrame) -> DataFrame:
    """tx_id, last_inflow_amount, last_inflow_gap, relay: the sender's last inflow before, and whether it passes on between few partners over a week."""
    before = W.partitionBy("node").orderBy("us").rangeBetween(W.unboundedPreceding, -1)
    inflow = F.when(F.col("role") == "in", F.struct("us", "amount"))
    both = ends(txn).select("*", F.when(F.col("role") == "in", F.col("partner")).alias("source"), F.when(F.col("role") == "out", F.col("partner")).alias("target"))
    both = count_distinct(both, "node", "source", 7 * DAY, "ins")
    both = count_distinct(both, "node", "target", 7 * DAY, "outs", dealt=True)
    ranked = both.select("*", F.max(inflow).over(before).alias("last"))
    mine = ranked.where(F.col("role") == "out")
    return mine.select(
        "tx_id", F.coalesce(F.col("last.amount"), F.lit(0.0)).alias("last_inflow_amount"), F.coalesce((F.col("us") - F.col("last.us")) / 1e6, F.lit(FOREVER)).alias("last_inflow_gap"),
        (F.col("ins").between(1, 2) & F.col("outs").between(1, 2)).alias("relay"),
    )


def running_degrees(txn: DataFrame) -> DataFrame:
    """txn with the sender's transfers out and distinct receivers so far, this one included; equal times see each other."""
    first = F.row_number().over(W.partitionBy("sender", "receiver").orderBy("us", "tx_id")) == 1
    upto = W.partitionBy("sender").orderBy("us").rangeBetween(W.unboundedPreceding, 0)
    marked = txn.withColumn("_first", first.cast("int"))
    return marked.select(*txn.columns, F.count("*").over(upto).alias("out_degree"), F.sum("_first").over(upto).alias("out_unique"))


def ports(txn: DataFrame) -> DataFrame:
    """txn with port: how many transfers the sender made before."""
    return txn.withColumn("port", F.row_number().over(W.partitionBy("sender").orderBy("us", "tx_id")) - 1)


def closed_cycles(txn: DataFrame) -> DataFrame:
    """tx_id, edge_creates_cycle, cycle_length (2 to 4, else 0).

    A path from receiver to sender is open from the latest first transfer of its
    steps on; see operators/openings.py. Paths are those of distinct pairs, not of
    transfers.
    """
    first = txn.groupBy(F.col("sender").alias("u"), F.col("receiver").alias("v")).agg(F.min("us").alias("at"))
    opened = openings(first)
    length = F.when(F.col("at1") < F.col("us"), 2).when(F.col("at2") < F.col("us"), 3).when(F.col("at3") < F.col("us"), 4).otherwise(0)
    met = txn.join(opened, (F.col("receiver") == F.col("r")) & (F.col("sender") == F.col("s")), "left")
    return met.select("tx_id", length.alias("cycle_length")).withColumn("edge_creates_cycle", F.col("cycle_length") > 0)


def live_features(txn: DataFrame) -> DataFrame:
    """txn with all of the above."""
    return running_degrees(fan_in(txn)).join(sender_history(txn), "tx_id").join(closed_cycles(txn), "tx_id")


def first_transfers(txn: DataFrame) -> DataFrame:
    """u, v, at: the first transfer of each pair of different accounts."""
    return txn.where(F.col("sender") != F.col("receiver")).groupBy(F.col("sender").alias("u"), F.col("receiver").alias("v")).agg(F.min("us").alias("at"))


def latest(*dates: str) -> Column:
    """The latest of some dates, null if one is missing."""
    return F.when(F.greatest(*[F.col(d).isNull().cast("int") for d in dates]) == 0, F.greatest(*dates))


def dated_cycles(txn: DataFrame) -> DataFrame:
    """account, at, two, three: the directed cycles of two and three accounts through an account, by when their last edge first appeared.

    An edge is there from its pair's first transfer on. Wedges are closed from the
    account with fewest partners, as in triangles(), with the dates of both ways.
    """
    goes = F.col("u") < F.col("v")
    pairs = first_transfers(txn).groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.min(F.when(goes, F.col("at"))).alias("there"), F.min(F.when(~goes, F.col("at"))).alias("back"))
    pairs = cut(pairs)
    degree = cut(pairs.select(F.explode(F.array("x", "y")).alias("account")).groupBy("account").agg(F.count("*").alias("d")))
    ranked = pairs.join(degree.select(F.col("account").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("account").alias("y"), F.col("d").alias("dy")), "y")
    turn = F.struct("dx", "x") > F.struct("dy", "y")
    end = lambda d, c: F.struct(F.col(d).alias("d"), F.col(c).alias("id"))
    steps = cut(ranked.select(
        F.when(turn, end("dy", "y")).otherwise(end("dx", "x")).alias("low"), F.when(turn, end("dx", "x")).otherwise(end("dy", "y")).alias("high"),
        F.struct(F.when(turn, F.col("back")).otherwise(F.col("there")).alias("there"), F.when(turn, F.col("there")).otherwise(F.col("back")).alias("back")).alias("dates"),
    ))
    dates = closed(steps, "dates")
    three = dates.select(F.array("a", "b", "c").alias("corners"), F.explode(F.array(latest("ab.there", "bc.there", "ac.back"), latest("ac.there", "bc.back", "ab.back"))).alias("at")).where(F.col("at").isNotNull())
    met = pairs.select(F.array("x", "y").alias("corners"), latest("there", "back").alias("at"), F.lit(1).alias("two"), F.lit(0).alias("three")).where(F.col("at").isNotNull())
    met = met.union(three.select("corners", "at", F.lit(0), F.lit(1)))
    return met.select(F.explode("corners").alias("account"), "at", "two", "three").groupBy("account", "at").agg(F.sum("two").alias("two"), F.sum("three").alias("three"))


def degrees_as_of(txn: DataFrame) -> DataFrame:
    """tx_id and both ends' degrees and the sender's cycles as of the transfer, itself and what is as late as it included.

    Per end in_degree, out_degree, in_degree_unique, out_degree_unique; two_cycles and
    three_cycles. All are running sums by account in one pass.
    """
    first = (F.row_number().over(W.partitionBy("sender", "receiver").orderBy("us", "tx_id")) == 1).cast("long")
    marked = txn.select("tx_id", "us", "sender", "receiver", first.alias("new"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    names = ["in_degree", "out_degree", "in_degree_unique", "out_degree_unique", "two_cycles", "three_cycles"]
    role = lambda name: F.struct("tx_id", F.lit(name).alias("role"))
    columns = [f"_d_{n}" for n in names]
    out = marked.select(role("sender").alias("_row"), F.col("sender").alias("account"), F.col("us").alias("_at"), *[x.alias(c) for x, c in zip((none, one, none, F.col("new"), none, none), columns, strict=True)])
    into = marked.select(role("receiver").alias("_row"), F.col("receiver").alias("account"), F.col("us").alias("_at"), *[x.alias(c) for x, c in zip((one, none, F.col("new"), none, none, none), columns, strict=True)])
    cycles = dated_cycles(txn)
    cycles = cycles.select(F.lit(None).cast(out.schema["_row"].dataType).alias("_row"), "account", F.col("at").alias("_at"), *[x.alias(c) for x, c in zip((none, none, none, none, F.col("two"), F.col("three")), columns, strict=True)])
    met = running_sums(out.union(into).union(cycles), "account", names)
    pick = lambda role, name: F.max(F.when(F.col("_row.role") == role, F.col(name))).alias(f"{role}_{name}")
    return met.groupBy(F.col("_row.tx_id").alias("tx_id")).agg(*[pick("sender", n) for n in names], *[pick("receiver", n) for n in names[:4]])


#: The fields of a live graph vector in their canonical order (fixed values), but for its three keys and its two lists, which two_hop() gives.
LIVE_FIELDS = (
    "sender_in_degree", "sender_out_degree", "sender_in_degree_unique", "sender_out_degree_unique", "sender_2hop_cycle_count", "sender_3hop_cycle_count", "sender_fan_in_score", "sender_fan_out_score",
    "sender_pagerank", "sender_betweenness", "sender_community_id", "sender_community_size", "sender_community_density", "sender_community_risk_score", "sender_benford_chi2_community",
    "receiver_in_degree", "receiver_out_degree", "receiver_community_id", "receiver_community_risk_score", "edge_creates_cycle", "cycle_length", "shared_community",
    "receiver_in_degree_unique_24h", "receiver_inflow_amount_cv", "sender_is_relay_node", "sender_last_inflow_amount", "sender_last_inflow_gap_seconds",
)
#: What an account without a community or graph features counts as.
ABSENT = {"pagerank": 0.0, "betweenness": 0.0, "community": -1, "community_size": 0, "community_density": 0.0, "community_risk_score": 0.0, "benford_chi2_community": 0.0}


def live_vector(txn: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """tx_id, sender, receiver and LIVE_FIELDS, as of each transfer.

    accounts: account and those columns of ABSENT that are known of it, from the graph
    of earlier days.
    """
    out = txn.select("tx_id", "sender", "receiver").join(degrees_as_of(txn), "tx_id")
    out = out.join(receiver_day(txn), "tx_id").join(sender_history(txn), "tx_id").join(closed_cycles(txn), "tx_id")
    known = [c for c in ABSENT if accounts is not None and c in accounts.columns]
    for end in ("sender", "receiver"):
        if known:
            out = out.join(accounts.select(F.col("account").alias(end), *[F.col(c).alias(f"_{end}_{c}") for c in known]), end, "left")
    of = lambda end, c: F.coalesce(F.col(f"_{end}_{c}"), F.lit(ABSENT[c])) if c in known else F.lit(ABSENT[c])
    fan = lambda degree, unique: F.when((F.col(degree) > 0) & (F.col(unique) > 0), 1 - F.col(unique) / F.col(degree)).otherwise(F.lit(0.0))
    named = {
        "sender_2hop_cycle_count": F.col("sender_two_cycles"), "sender_3hop_cycle_count": F.col("sender_three_cycles"), "sender_fan_in_score": fan("sender_in_degree", "sender_in_degree_unique"), "sender_fan_out_score": fan("sender_out_degree", "sender_out_degree_unique"),
        "sender_community_id": of("sender", "community"), "receiver_community_id": of("receiver", "community"), "receiver_community_risk_score": of("receiver", "community_risk_score"),
        "shared_community": (of("sender", "community") == of("receiver", "community")) & (of("sender", "community") >= 0), "receiver_in_degree_unique_24h": F.col("in_unique_24h"), "receiver_inflow_amount_cv": F.col("inflow_cv"),
        "sender_is_relay_node": F.col("relay"), "sender_last_inflow_amount": F.col("last_inflow_amount"), "sender_last_inflow_gap_seconds": F.col("last_inflow_gap"),
    } | {f"sender_{c}": of("sender", c) for c in ABSENT if c != "community"}
    return out.select("tx_id", "sender", "receiver", *[named.get(c, F.col(c)).alias(c) for c in LIVE_FIELDS])


def two_hop(txn: DataFrame, asked: DataFrame, *, cap: int = 200) -> DataFrame:
    """tx_id, accounts (within two steps of the sender either way, as of the transfer, in order) and edges (the first `cap` transfers between them and the sender), for the transfers whose tx_id is in asked.

    Grows with the neighbourhoods of what is asked for: meant for transfers under review.
    """
    pairs = first_transfers(txn)
    both = cut(pairs.select(F.col("u").alias("x"), F.col("v").alias("y"), "at").union(pairs.select("v", "u", "at")).groupBy("x", "y").agg(F.min("at").alias("at")))
    those = cut(txn.join(asked.select("tx_id").distinct(), "tx_id", "left_semi").select("tx_id", F.col("us").alias("now"), "sender"))
    one = those.join(both, (F.col("sender") == F.col("x")) & (F.col("at") <= F.col("now"))).select("tx_id", "now", "sender", F.col("y").alias("near"))
    two = one.join(both, (F.col("near") == F.col("x")) & (F.col("at") <= F.col("now"))).where(F.col("y") != F.col("sender")).select("tx_id", "now", "sender", F.col("y").alias("near"))
    near = cut(one.union(two).distinct())
    within = near.select("tx_id", "now", "near").union(those.select("tx_id", "now", "sender"))
    moves = txn.select(F.col("tx_id").alias("edge"), "us", F.col("sender").alias("from"), F.col("receiver").alias("to"), "amount")
    inside = within.join(moves, (F.col("near") == F.col("from")) & (F.col("us") <= F.col("now"))).join(within.select(F.col("tx_id").alias("_t"), F.col("near").alias("_n")), (F.col("tx_id") == F.col("_t")) & (F.col("to") == F.col("_n")))
    rank = F.row_number().over(W.partitionBy("tx_id").orderBy("us", "edge"))
    first = inside.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    listed = first.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("us", "edge", "from", "to", "amount"))).alias("edges"))
    accounts = near.groupBy("tx_id").agg(F.array_sort(F.collect_set("near")).alias("accounts"))
    return those.select("tx_id").join(accounts, "tx_id", "left").join(listed, "tx_id", "left")
