"""Offline evaluation of alerts against sealed labels. The only reader of labels.

Curves and areas follow the step-wise definitions: scores are grouped by value,
so ties count once, and running counts go over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.operators.alerts import RAISED

LAYERS = ("rule", "graph", "supervised", "anomaly", "tgn")
# Typologies that a report always lists.
TYPOLOGIES = ("structuring", "circular_laundering", "layering_chain", "fan_in", "fan_out", "fraud_ring", "dormant_activation", "velocity_burst", "cross_border_layering", "round_tripping")
RULE_IDS = tuple(f"R{i:02d}" for i in range(1, 16))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def join_evaluation(stream: DataFrame, alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a transaction of the stream: y_true, y_pred, y_score, latency_ms and the alert's and label's columns.

    Repeated alerts of a transaction count by the latest, repeated labels once.
    """
    last = F.row_number().over(W.partitionBy("tx_id").orderBy(F.desc("created_at"), "alert_id"))
    alerts = alerts.withColumn("_n", last).where(F.col("_n") == 1).drop("_n")
    base = stream.select("tx_id", "ts").dropDuplicates(["tx_id"])
    out = base.join(alerts, "tx_id", "left").join(truth.dropDuplicates(["tx_id"]), "tx_id", "left")
    return out.select(
        "*", F.coalesce((F.col("suspicious_flag") == "Suspicious").cast("int"), F.lit(0)).alias("y_true"), F.coalesce(F.col("status").isin(*RAISED).cast("int"), F.lit(0)).alias("y_pred"),
        F.coalesce(S.clamp(F.col("transaction_risk_score") / 100, 0, 1), F.lit(0.0)).alias("y_score"), ((F.unix_micros("created_at") - F.unix_micros("ts")) / 1000).alias("latency_ms"),
    )


def confusion(joined: DataFrame) -> DataFrame:
    """One row of counts and rates."""
    count = lambda t, p: F.coalesce(F.sum(((F.col("y_true") == t) & (F.col("y_pred") == p)).cast("long")), F.lit(0))
    out = joined.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return out.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("f1_macro"), ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))


def curve(joined: DataFrame, score: str = "y_score") -> DataFrame:
    """threshold, tp, fp, precision, recall, fpr for each distinct score, from the highest.

    Distinct scores are few against rows once scores are rounded to `1e-6`; the
    running counts go over those alone.
    """
    at = joined.select(F.round(F.col(score), 6).alias("threshold"), "y_true").groupBy("threshold").agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))
    down = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    at = at.select("threshold", "p", "n", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(W.partitionBy()).alias("all_p"), F.sum("n").over(W.partitionBy()).alias("all_n"))
    return at.select("threshold", "p", "n", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_p")).alias("recall"), ratio(F.col("fp"), F.col("all_n")).alias("fpr"), "all_p", "all_n")


def areas(joined: DataFrame, score: str = "y_score") -> DataFrame:
    """One row: average_precision and roc_auc; both 0 where only one class is there."""
    at = curve(joined, score)
    gain = F.sum(ratio(F.col("p"), F.col("all_p")) * F.col("precision"))
    # Pairs of a positive above a negative, ties as half.
    above = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2)
    one = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    return at.agg(F.coalesce(F.when(one, gain), F.lit(0.0)).alias("average_precision"), F.coalesce(F.when(one, above / (F.max("all_p") * F.max("all_n"))), F.lit(0.0)).alias("roc_auc"))


def thin(points: DataFrame, order: str, n: int = 100) -> DataFrame:
    """At most n points, evenly spaced in order, first and last included."""
    ranked = points.select("*", (F.row_number().over(W.orderBy(order)) - 1).alias("_i"), F.count("*").over(W.partitionBy()).alias("_all"))
    step = F.greatest(F.lit(1.0), (F.col("_all") - 1) / F.lit(float(n - 1)))
    kept = F.floor(F.ceil(F.col("_i") / step) * step + 1e-9) == F.col("_i")
    return ranked.where(kept).drop("_i", "_all")


def layer_credit(joined: DataFrame) -> DataFrame:
    """layer, led, share, mean_score over caught suspicious transactions; the first of equal layers leads."""
    parts = F.array(*[F.coalesce(F.col(f"contribution_{x}"), F.lit(0.0)) for x in LAYERS])
    lead = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), F.array_position(parts, F.array_max(parts)).cast("int"))
    hits = joined.where((F.col("y_true") == 1) & (F.col("y_pred") == 1)).select(lead.alias("lead"), F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(f"score_{x}").alias("score")) for x in LAYERS])).alias("of"))
    out = hits.groupBy("of.layer").agg(F.sum((F.col("lead") == F.col("of.layer")).cast("long")).alias("led"), F.count("*").alias("n"), F.avg("of.score").alias("mean_score"))
    return out.select("layer", "led", ratio(F.col("led"), F.col("n")).alias("share"), "mean_score")


def rings(joined: DataFrame) -> DataFrame:
    """One row: rings, those detected (half of it or more) and partly, their rate and mean coverage."""
    by = joined.where((F.col("y_true") == 1) & F.col("fraud_ring_id").isNotNull()).groupBy("fraud_ring_id").agg((F.sum("y_pred") / F.count("*")).alias("coverage"))
    n, found = F.count("*"), F.sum((F.col("coverage") >= 0.5).cast("long"))
    return by.agg(n.alias("rings"), F.coalesce(found, F.lit(0)).alias("detected"), F.coalesce(F.sum((F.col("coverage") > 0).cast("long")), F.lit(0)).alias("partial"), ratio(F.coalesce(found, F.lit(0)).cast("double"), n).alias("rate"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"))


def community_match(joined: DataFrame) -> DataFrame:
    """One row: mean over clusters of the share of their commonest community."""
    by = joined.where(F.col("cluster").isNotNull() & F.col("community").isNotNull()).groupBy("cluster", "community").agg(F.count("*").alias("n"))
    return by.groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("share")).agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("community_match"))


def group_precision(joined: DataFrame, least: float = 61) -> DataFrame:
    return joined.where(F.col("group_risk_score") >= least).agg(F.coalesce(F.avg(F.col("y_true").cast("double")), F.lit(0.0)).alias("group_precision"))


def typology_rates(joined: DataFrame) -> DataFrame:
    """typology, n, detected, rate for all known typologies and any others met."""
    seen = joined.where((F.col("y_true") == 1) & F.col("typology").isNotNull()).groupBy("typology").agg(F.count("*").alias("n"), F.sum("y_pred").alias("detected"))
    known = joined.sparkSession.createDataFrame([(t,) for t in TYPOLOGIES], "typology string")
    return known.join(seen, "typology", "full").select("typology", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("detected", F.lit(0)).alias("detected"), ratio(F.coalesce("detected", F.lit(0)).cast("double"), F.coalesce("n", F.lit(0))).alias("rate"))


def rule_precision(joined: DataFrame) -> DataFrame:
    """rule, fired, hits, precision for all rules, from the distinct L1 patterns of each row."""
    fired = joined.select("y_true", F.explode(F.array_distinct(F.transform("patterns", S.rule_of))).alias("rule")).where(F.col("rule").isNotNull())
    sums = fired.groupBy("rule").agg(F.count("*").alias("fired"), F.sum("y_true").alias("hits"))
    known = joined.sparkSession.createDataFrame([(r,) for r in RULE_IDS], "rule string")
    return known.join(sums, "rule", "left").select("rule", F.coalesce("fired", F.lit(0)).alias("fired"), F.coalesce("hits", F.lit(0)).alias("hits"), ratio(F.coalesce("hits", F.lit(0)).cast("double"), F.coalesce("fired", F.lit(0))).alias("precision"))


def latency(joined: DataFrame) -> DataFrame:
    """One row of event-to-alert skew, over what is not negative."""
    return joined.where(F.col("latency_ms") >= 0).agg(F.count("*").alias("n"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.percentile("latency_ms", 0.95), F.lit(0.0)).alias("p95_ms"), F.coalesce(F.percentile("latency_ms", 0.99), F.lit(0.0)).alias("p99_ms"))


def dataset_stats(joined: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.coalesce(F.sum("y_true"), F.lit(0))
    return joined.agg(n.alias("transactions"), bad.alias("suspicious"), F.coalesce(F.sum("y_pred"), F.lit(0)).alias("alerts"), F.round(ratio(bad.cast("double"), n), 6).alias("illicit_ratio"))


def report(joined: DataFrame, published: dict[str, float]) -> DataFrame:
    """One row: all headline figures, and the difference of f1, precision, recall and average precision to published ones where given."""
    out = confusion(joined)
    for part in (areas(joined), rings(joined), group_precision(joined), dataset_stats(joined), latency(joined)):
        out = out.join(F.broadcast(part))  # each is one row
    for name, value in published.items():
        out = out.withColumn(f"delta_{name}", F.col(name) - F.lit(value))
    return out


def probe_results(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """probe, missing, passed: whether each probe's expected rules are among those seen."""
    all_seen = seen.groupBy("probe").agg(F.array_distinct(F.flatten(F.collect_list("triggered_rules"))).alias("seen"))
    missing = F.array_except("expected", F.coalesce("seen", F.array().cast("array<string>")))
    return expected.join(all_seen, "probe", "left").select("probe", missing.alias("missing"), (F.size(missing) == 0).alias("passed"))
