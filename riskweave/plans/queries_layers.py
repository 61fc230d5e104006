"""The training matrix and the fusion of real layer scores, from transfers to alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import alerts as A
from riskweave.operators import fusion as U
from riskweave.operators import graph as G
from riskweave.operators import matrix as X
from riskweave.operators import models as M
from riskweave.plans.queries_core import query, r
from riskweave.sources.tables import txn


def _prepared(spark, d):
    """Transfers with label and part, communities by label, graph features, and the matrix at the rules' default limits, each written once."""
    labelled = txn(spark, d).withColumn("label", (F.col("amount") % 7 < 1).cast("int"))
    t = G.cut(M.stratified_split(labelled, "tx_id", "label"))  # while rows have few columns
    members = G.cut(G.label_propagation(G.adjacency(t)))
    graph = G.cut(G.graph_features(t, members))
    return t, members, graph, G.cut(X.training_matrix(t, graph))


@query("ml_matrix")
def ml_matrix(spark, d):
    t = G.cut(txn(spark, d))
    return X.training_matrix(t, G.cut(G.graph_features(t))).select("tx_id", *X.TRAINING)


@query("fus_layers")
def fus_layers(spark, d):
    """Alerts from rules, communities, boosters, anomaly models and embeddings; small models, as the query shows the path."""
    t, members, graph, matrix = _prepared(spark, d)
    profiles = G.cut(G.community_profiles(t, members, graph))
    scored = X.layer_scores(matrix, "label", graph=graph, profiles=profiles, members=members, rounds=3, trees=5, epochs=2)
    found = U.explanation(U.fuse(scored))
    scores = [r(c).alias(c) for c in ("rule_score", "graph_score", "supervised_score", "anomaly_score", "tgn_score", "transaction_risk_score", "group_risk_score")]
    return A.trigger(found).select("alert_id", "tx_id", "sender", "receiver", "triggered_rules", *scores, "risk_level", "risk_level_group", "leading_layer", "explanation")
