"""Fusion of layer scores to one risk, its breakdown, patterns and explanation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import scalars as S

# Weights of the layers.
WEIGHTS = {"rule_score": 0.30, "graph_score": 0.25, "supervised_score": 0.20, "anomaly_score": 0.15, "tgn_score": 0.10}
LAYERS = {"rule_score": "Rules", "graph_score": "Graph", "supervised_score": "Supervised model", "anomaly_score": "Anomaly", "tgn_score": "Embedding"}


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) != set(WEIGHTS):
        raise ValueError(f"weights must name {sorted(WEIGHTS)}")
    if not math.isclose(sum(weights.values()), 1.0, abs_tol=1e-6):
        raise ValueError("weights must sum to 1")
    return weights


def with_layers(df: DataFrame) -> DataFrame:
    """df with all layer scores and community columns; what is missing or null is 0."""
    out = df
    for c in (*WEIGHTS, "community_risk", "community_density"):
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    return out.withColumn("has_cycle", F.coalesce(F.col("has_cycle"), F.lit(False)) if "has_cycle" in df.columns else F.lit(False))


def fuse(df: DataFrame, weights: dict[str, float] | None = None, meta: Column | None = None) -> DataFrame:
    """df with transaction and group risk, levels, breakdown, leader and fusion mode.

    meta, a probability, takes the place of the weighted sum if given.
    """
    weights = check_weights(weights or WEIGHTS)
    out = with_layers(df)
    total = sum((F.col(c) * w for c, w in list(weights.items())[1:]), F.col("rule_score") * weights["rule_score"])
    out = out.withColumn("transaction_risk_score", S.clamp(total if meta is None else meta * 100, 0, 100))
    bump = S.clamp(F.col("community_density"), 0, 1) * 15 + F.col("has_cycle").cast("double") * 10
    out = out.withColumn("group_risk_score", S.clamp(F.greatest("transaction_risk_score", "community_risk") + bump, 0, 100))
    parts = [F.round(F.col(c) * w, 4) for c, w in weights.items()]
    names = F.array(*[F.lit(c) for c in weights])
    return out.select(
        "*", S.risk_level(F.col("transaction_risk_score")).alias("risk_level"), S.risk_level(F.col("group_risk_score")).alias("risk_level_group"),
        F.map_from_arrays(names, F.array(*parts)).alias("contributions"), F.element_at(names, F.array_position(F.array(*parts), F.array_max(F.array(*parts))).cast("int")).alias("leading_layer"),
        F.lit("static_weights" if meta is None else "meta_learner").alias("fusion_mode"),
    )


def patterns(rules: Column, community_risk: Column, community_pattern: Column, features: Column, drivers: Column, remarks: Column) -> Column:
    """Patterns of all layers with their prefixes, each once, in order."""
    tag = lambda prefix, items: F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    community = F.when(community_risk >= 60, F.array(F.concat(F.lit("L2:"), F.coalesce(community_pattern, F.lit("community"))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tag("L1:", rules), community, tag("L3:", F.slice(features, 1, 2)), tag("L4:", F.slice(drivers, 1, 2)), tag("L5:", F.slice(remarks, 1, 2))))


def explanation(df: DataFrame) -> DataFrame:
    """df with an explanation that opens with the leading layer."""
    said = F.create_map(*[x for pair in LAYERS.items() for x in map(F.lit, pair)])
    lead = F.format_string("%s leads with %.1f of %.1f points", said[F.col("leading_layer")], F.col("contributions")[F.col("leading_layer")], F.col("transaction_risk_score"))
    rules = F.when(F.size("triggered_rules") > 0, F.concat(F.lit("rules "), F.concat_ws(", ", "triggered_rules")))
    return df.withColumn("explanation", F.concat_ws("; ", lead, rules))
