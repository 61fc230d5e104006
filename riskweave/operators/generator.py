"""Synthetic accounts and transfers with planted laundering rings.

All draws are hashes of ids and a seed, so any partitioning gives the same data.
Plans of rings are made on the driver (a few rows each); rows are made in Spark.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from riskweave.sources.tables import COUNTRIES

BANKS = ("Alpha", "Beta", "Gamma", "Delta", "Epsilon")


@dataclass(frozen=True)
class Config:
    accounts: int = 400
    transactions: int = 5000
    rings: int = 10
    days: int = 90
    seed: int = 42
    start: str = "2025-01-01"

    def __post_init__(self):
        if self.accounts < 20 or self.transactions < 1 or self.days < 1:
            raise ValueError("too small to generate from")


def uniform(seed: int, *parts) -> Column:
    """A reproducible draw from [0, 1) for the given columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**40)) + 0.5) / float(2**40)


def normal(seed: int, *parts) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *parts))) * F.cos(uniform(seed, F.lit("t"), *parts) * 6.283185307179586)


def accounts(spark: SparkSession, cfg: Config) -> DataFrame:
    """Customers (70%), businesses (25%) and institutions (5%) with KYC levels, incomes and devices."""
    u = lambda name: uniform(cfg.seed, F.lit(name), F.col("id"))
    kind = F.when(u("kind") < 0.7, "individual").when(u("kind") < 0.95, "business").otherwise("institution")
    at = spark.range(cfg.accounts)
    return at.select(
        F.concat(F.lit("ACC-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("account_id"), F.col("id").alias("number"), kind.alias("customer_type"),
        F.element_at(F.array(*map(F.lit, BANKS)), (u("bank") * len(BANKS)).cast("int") + 1).alias("bank"), F.when(u("home") < 0.9, "IN").otherwise(F.element_at(F.array(*map(F.lit, COUNTRIES)), (u("country") * len(COUNTRIES)).cast("int") + 1)).alias("home_country"),
        F.when(u("kyc") < 0.05, 0).when(u("kyc") < 0.25, 1).when(u("kyc") < 0.7, 2).otherwise(3).alias("kyc_level"), (u("shell") < 0.03).alias("is_shell"), (u("ring") < 0.1).alias("is_potential_ring_member"),
        F.exp(10 + 0.8 * normal(cfg.seed, F.lit("mean"), F.col("id"))).alias("typical_tx_amount_mean"), F.round(F.exp(13 + normal(cfg.seed, F.lit("income"), F.col("id"))), 2).alias("declared_income"),
        F.concat(F.lit("dev-"), F.when(u("public") < 0.05, (u("spot") * 50).cast("int")).otherwise(F.col("id") + 1000).cast("string")).alias("home_device_id"),
    )


def normal_traffic(spark: SparkSession, cfg: Config) -> DataFrame:
    """Background transfers: lognormal amounts around the sender's own level, two peaks a day, now and then another device."""
    u = lambda name: uniform(cfg.seed, F.lit(name), F.col("id"))
    at = spark.range(cfg.transactions)
    sender = (u("sender") * cfg.accounts).cast("long")
    receiver = (sender + 1 + (u("receiver") * (cfg.accounts - 1)).cast("long")) % cfg.accounts
    hour = F.when(u("peak") < 0.5, 11 + 2 * normal(cfg.seed, F.lit("hour"), F.col("id"))).otherwise(18 + 2 * normal(cfg.seed, F.lit("hour"), F.col("id")))
    seconds = F.floor(u("day") * cfg.days) * 86400 + F.pmod(hour, F.lit(24.0)) * 3600
    who = accounts(spark, cfg).select(F.col("number").alias("s"), "typical_tx_amount_mean", "home_device_id", "home_country", "bank")
    rows = at.select(F.col("id"), sender.alias("sender"), receiver.alias("receiver"), seconds.alias("seconds")).join(who, F.col("sender") == F.col("s"))
    return rows.select(
        F.concat(F.lit("N-"), F.col("id").cast("string")).alias("tx_id"), "sender", "receiver", F.timestamp_micros((F.unix_timestamp(F.lit(cfg.start), "yyyy-MM-dd") * 1_000_000 + F.col("seconds") * 1e6).cast("long")).alias("ts"),
        F.round(F.col("typical_tx_amount_mean") * F.exp(0.5 * normal(cfg.seed, F.lit("amount"), F.col("id"))), 2).alias("amount"), F.when(u("device") < 0.85, F.col("home_device_id")).otherwise(F.concat(F.lit("dev-"), F.col("id").cast("string"))).alias("device"),
        F.col("home_country").alias("country"), F.lit(None).cast("string").alias("ring_id"), F.lit(None).cast("string").alias("typology"),
    )


def income(spark: SparkSession, cfg: Config, per_account: int = 2) -> DataFrame:
    """Credits from outside (sender -1), spread over the days."""
    who = accounts(spark, cfg).select("number", "declared_income").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(per_account - 1))))
    at = F.unix_timestamp(F.lit(cfg.start), "yyyy-MM-dd") + (F.col("turn") + uniform(cfg.seed, F.lit("pay"), F.col("number"), F.col("turn"))) * (cfg.days * 86400 / per_account)
    return who.select(
        F.concat(F.lit("I-"), "number", F.lit("-"), "turn").alias("tx_id"), F.lit(-1).cast("long").alias("sender"), F.col("number").alias("receiver"), F.timestamp_micros((at * 1e6).cast("long")).alias("ts"), F.round(F.col("declared_income") / 12, 2).alias("amount"),
        F.lit("dev-bank").alias("device"), F.lit("IN").alias("country"), F.lit(None).cast("string").alias("ring_id"), F.lit(None).cast("string").alias("typology"),
    )


# Shape and limits of each typology (least and most transfers, hours, least and most amount).
CATALOGUE = {
    "structuring": (5, 15, 24, 850_000, 999_000), "circular_laundering": (3, 6, 48, 300_000, 900_000), "layering_chain": (3, 8, 48, 300_000, 2_000_000), "fan_in": (5, 15, 12, 100_000, 300_000), "fan_out": (5, 15, 12, 100_000, 300_000),
    "fraud_ring": (4, 10, 36, 50_000, 400_000), "dormant_activation": (10, 14, 24, 150_000, 500_000), "velocity_burst": (15, 24, 1, 20_000, 90_000), "cross_border_layering": (3, 5, 40, 500_000, 1_500_000), "round_tripping": (3, 3, 72, 400_000, 1_200_000),
}


def clamp_parameters(typology: str, size: int | None = None, amount: float | None = None) -> tuple[int, float]:
    """A plan's size and amount within the catalogue's limits."""
    low, high, _, least, most = CATALOGUE[typology]
    return max(low, min(high, size or low)), round(max(least, min(most, amount or (least + most) / 2)), 2)


def plan(typology: str, ring: str, members: list[int], *, size: int, amount: float, start: float, seed: int) -> list[dict]:
    """Planned transfers of one ring: sender, receiver, seconds from the start of the data, amount."""
    if typology not in CATALOGUE:
        raise ValueError(f"unknown typology {typology!r}")
    rng, hours = random.Random(f"{seed}:{ring}"), CATALOGUE[typology][2]
    chain = members[: size + 1]
    pairs = {
        "structuring": lambda: [(members[0], members[1])] * size,
        "velocity_burst": lambda: [(members[0], members[1 + i % (len(members) - 1)]) for i in range(size)],
        "fan_in": lambda: [(m, members[0]) for m in members[1 : size + 1]],
        "fan_out": lambda: [(members[0], m) for m in members[1 : size + 1]],
        "dormant_activation": lambda: [(members[0], m) for m in members[1 : size + 1]],
        "fraud_ring": lambda: [(a, b) for a in members[:size] for b in members[:size] if a != b and rng.random() < 0.7],
    }.get(typology)
    closed = typology in ("circular_laundering", "round_tripping")
    edges = pairs() if pairs else [*zip(chain[:size], chain[1:size] + ([chain[0]] if closed else [chain[size]]), strict=True)]
    gap, at, left, rows = hours * 3600 / max(1, len(edges)), start, amount, []
    for a, b in edges:
        at += max(60.0, min(gap, rng.expovariate(1 / max(60.0, gap / 2))))
        passing = typology in ("circular_laundering", "layering_chain", "cross_border_layering", "round_tripping")
        left = left * rng.uniform(0.95, 1.0) if passing and rows else left
        value = left if passing else min(999_000, max(850_000, rng.gauss(920_000, 30_000))) if typology == "structuring" else amount * rng.uniform(0.95, 1.05)
        rows.append({"ring_id": ring, "typology": typology, "step": len(rows), "sender": a, "receiver": b, "seconds": at, "amount": round(value, 2)})
    return rows


def rings(spark: SparkSession, cfg: Config) -> DataFrame:
    """Transfers of cfg.rings planned rings, over all typologies in turn, with disjoint members."""
    rng = random.Random(cfg.seed)
    pool = list(range(cfg.accounts))
    rng.shuffle(pool)
    rows: list[dict] = []
    names = list(CATALOGUE)
    for i in range(cfg.rings):
        typology = names[i % len(names)]
        low, high, hours, _, _ = CATALOGUE[typology]
        size, amount = clamp_parameters(typology, rng.randint(low, high), rng.uniform(*CATALOGUE[typology][3:]))
        if len(pool) < size + 1:
            break
        members, pool = pool[: size + 1], pool[size + 1 :]
        rows += plan(typology, f"ring-{i:04d}", members, size=size, amount=amount, start=rng.uniform(0, max(1, cfg.days * 86400 - hours * 3600)), seed=cfg.seed)
    planned = spark.createDataFrame(rows, "ring_id string, typology string, step int, sender long, receiver long, seconds double, amount double")
    at = F.unix_timestamp(F.lit(cfg.start), "yyyy-MM-dd") + F.col("seconds")
    return planned.select(
        F.concat("ring_id", F.lit("-"), "step").alias("tx_id"), "sender", "receiver", F.timestamp_micros((at * 1e6).cast("long")).alias("ts"), "amount",
        F.concat(F.lit("dev-"), F.when(uniform(cfg.seed, F.lit("shared"), F.col("ring_id"), F.col("sender")) < 0.7, F.col("ring_id")).otherwise(F.col("sender").cast("string"))).alias("device"), F.lit("IN").alias("country"), "ring_id", "typology",
    )


def prestage(planned: DataFrame, seed: int) -> DataFrame:
    """Deposits of 0.6 to 1.05 of a ring sender's outflow, one to seven days before its first transfer."""
    sums = planned.groupBy("ring_id", "sender").agg(F.sum("amount").alias("outflow"), F.min("ts").alias("first"))
    u = lambda name: uniform(seed, F.lit(name), F.col("ring_id"), F.col("sender"))
    return sums.select(
        F.concat(F.lit("P-"), "ring_id", F.lit("-"), "sender").alias("tx_id"), F.lit(-1).cast("long").alias("sender"), F.col("sender").alias("receiver"), F.timestamp_micros((F.unix_micros("first") - (1 + 6 * u("when")) * 86_400_000_000).cast("long")).alias("ts"),
        F.round(F.col("outflow") * (0.6 + 0.45 * u("share")), 2).alias("amount"), F.lit("dev-bank").alias("device"), F.lit("IN").alias("country"), F.lit(None).cast("string").alias("ring_id"), F.lit(None).cast("string").alias("typology"),
    )


def generate(spark: SparkSession, cfg: Config = Config()) -> DataFrame:
    """All transfers, with times made unique in order of (ts, tx_id) within a tie."""
    planned = rings(spark, cfg)
    every = normal_traffic(spark, cfg).unionByName(income(spark, cfg)).unionByName(planned).unionByName(prestage(planned, cfg.seed))
    return unique_times(every)


def unique_times(df: DataFrame) -> DataFrame:
    """df with times made unique: inside each millisecond rows are a microsecond apart, in order of (ts, tx_id).

    So no row reaches the time of one after it; over a thousand rows in one
    millisecond are an error.
    """
    ms = F.floor(F.unix_micros("ts") / 1000)
    tie = F.row_number().over(W.partitionBy("_ms").orderBy("ts", "tx_id")) - 1
    placed = df.withColumn("_ms", ms).withColumn("_tie", tie)
    at = F.when(F.col("_tie") < 1000, F.col("_ms") * 1000 + F.col("_tie")).otherwise(F.raise_error(F.lit("over 1000 rows in a millisecond")).cast("long"))
    return placed.withColumn("ts", F.timestamp_micros(at)).drop("_ms", "_tie")


def ring_ratios(df: DataFrame, suspicious: Column) -> DataFrame:
    """account, suspicious, total, ratio, has_before, has_after: of each account with suspicious transfers, its share of them, and whether it has others before and after their median time.

    df: us, sender, receiver. A transfer to oneself counts once.
    """
    marked = df.select("us", "sender", "receiver", suspicious.alias("bad"))
    each = marked.select("us", F.col("sender").alias("account"), "bad").unionByName(marked.where(F.col("sender") != F.col("receiver")).select("us", F.col("receiver").alias("account"), "bad"))
    bad = each.where("bad").groupBy("account").agg(F.count("*").alias("suspicious"), F.percentile("us", 0.5).alias("median"))
    both = each.join(bad, "account")
    other = ~F.col("bad")
    return both.groupBy("account").agg(F.max("suspicious").alias("suspicious"), F.count("*").alias("total"), F.max(other & (F.col("us") < F.col("median"))).alias("has_before"), F.max(other & (F.col("us") > F.col("median"))).alias("has_after")).withColumn("ratio", F.col("suspicious") / F.col("total"))


def rebalance(generated: DataFrame, *, most: float = 0.4, seed: int = 1) -> DataFrame:
    """Ordinary transfers to add, so that no account of a ring has more than `most` of its transfers in it and each has some before and after.

    Same columns as generated; amounts are small and times within that of all.
    """
    rows = generated.withColumn("us", F.unix_micros("ts"))
    span = rows.agg(F.min("us").alias("_from"), F.max("us").alias("_to"))
    need = F.greatest(F.ceil(F.col("suspicious") / most) - F.col("total"), (~F.col("has_before")).cast("long") + (~F.col("has_after")).cast("long"))
    wanted = ring_ratios(rows.where(F.col("sender") >= 0), F.col("ring_id").isNotNull()).where(F.col("account") >= 0).select("account", "has_before", need.cast("int").alias("need")).where(F.col("need") > 0)
    each = wanted.select("account", "has_before", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("i")).join(F.broadcast(span))  # span is one row
    u = lambda name: uniform(seed, F.lit(name), F.col("account"), F.col("i"))
    # The first is early unless there is one before already, the next one late; others fall anywhere.
    turn = F.col("i") + F.col("has_before").cast("int")
    share = F.when(turn == 1, u("at") * 0.01).when(turn == 2, 1 - u("at") * 0.01).otherwise(u("at"))
    at = F.timestamp_micros((F.col("_from") + share * (F.col("_to") - F.col("_from"))).cast("long"))
    made = each.select(F.concat(F.lit("N-"), "account", F.lit("-"), "i").alias("tx_id"), F.col("account").alias("sender"), F.lit(-1).cast("long").alias("receiver"), at.alias("ts"), F.round(500 + 4500 * u("amount"), 2).alias("amount"))
    return made.select(*[F.col(c).cast(generated.schema[c].dataType).alias(c) if c in made.columns else F.lit(None).cast(generated.schema[c].dataType).alias(c) for c in generated.columns])


def truth(generated: DataFrame) -> DataFrame:
    """tx_id, suspicious_flag, ring_id, typology and the ring's size and value."""
    by = W.partitionBy("ring_id")
    bad = generated.where(F.col("ring_id").isNotNull()).select("tx_id", F.lit("Suspicious").alias("suspicious_flag"), "ring_id", "typology", F.count("*").over(by).alias("ring_size"), F.sum("amount").over(by).alias("total_ring_value"))
    return bad.unionByName(generated.where(F.col("ring_id").isNull()).select("tx_id", F.lit("Normal").alias("suspicious_flag")), allowMissingColumns=True)


def split_by_time(df: DataFrame, share: float = 0.9, ring: str = "ring_id") -> DataFrame:
    """df with part (hist, stream): the first share by time is hist, but a ring with transfers on both sides is stream as a whole."""
    cut = df.agg(F.percentile(F.unix_micros("ts"), share).alias("_cut"))
    placed = df.join(F.broadcast(cut)).withColumn("_late", F.unix_micros("ts") > F.col("_cut"))  # cut is one row
    late = placed.where(F.col(ring).isNotNull() & F.col("_late")).select(F.col(ring).alias("_ring")).distinct()
    out = placed.join(late, F.col(ring) == F.col("_ring"), "left")
    return out.withColumn("part", F.when(F.col("_late") | F.col("_ring").isNotNull(), "stream").otherwise("hist")).drop("_late", "_cut", "_ring")


def replay_balances(df: DataFrame, opening: float = 0.0) -> DataFrame:
    """df (tx_id, ts, sender, receiver, amount) with balance_before, balance_after of the sender and accepted.

    A transfer over the balance is refused, which changes all that follows it in
    any account it reaches, so one ordered pass over all rows is needed: one
    task. running_balances() is the form without refusals, which scales.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "tx_id"], kind="stable")
        held: dict[int, float] = {}
        rows = []
        for s, r, amount in zip(frame["sender"], frame["receiver"], frame["amount"], strict=True):
            before = held.get(s, opening)
            ok = s < 0 or before >= amount
            if ok:
                held[s] = before - amount
                held[r] = held.get(r, opening) + amount
            rows.append((before, before - amount if ok else before, ok))
        return frame[["tx_id"]].assign(**dict(zip(("balance_before", "balance_after", "accepted"), map(list, zip(*rows, strict=True)), strict=True)))

    return df.select("tx_id", "ts", "sender", "receiver", "amount", F.lit(1).alias("all")).groupBy("all").applyInPandas(run, "tx_id string, balance_before double, balance_after double, accepted boolean")


def running_balances(df: DataFrame, opening: float = 0.0) -> DataFrame:
    """tx_id and the sender's balance_after, with nothing refused."""
    moves = df.select("tx_id", "ts", F.col("sender").alias("account"), (-F.col("amount")).alias("d"), F.lit(1).alias("out")).unionByName(df.select("tx_id", "ts", F.col("receiver").alias("account"), F.col("amount").alias("d"), F.lit(0).alias("out")))
    upto = W.partitionBy("account").orderBy("ts", "tx_id", "out").rowsBetween(W.unboundedPreceding, 0)
    return moves.withColumn("balance_after", F.lit(opening) + F.sum("d").over(upto)).where(F.col("out") == 1).select("tx_id", "balance_after")
