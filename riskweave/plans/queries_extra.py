"""Queries that carry graph features to transactions, complete communities, and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskweave.operators import alerts as A
from riskweave.operators import generator as N
from riskweave.operators import graph as G
from riskweave.plans.queries_core import _EDGES, TXN_SQL, D, _labels_sql, query, r
from riskweave.plans.queries_risk import RULED_SQL, fused
from riskweave.sources.tables import export_split, shared_folder, txn, write_joined

_DEGREES = """dg AS (SELECT account, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(DISTINCT src) AS in_unique, count(DISTINCT dst) AS out_unique
  FROM (SELECT sender AS account, 0 AS i, 1 AS o, NULL::BIGINT AS src, CASE WHEN sender <> receiver THEN receiver END AS dst FROM txn UNION ALL SELECT receiver, 1, 0, CASE WHEN sender <> receiver THEN sender END, NULL FROM txn) GROUP BY account)"""
_TWO = "two AS (SELECT a.u AS account, count(*) AS two_cycles FROM e a JOIN e b ON a.u = b.v AND a.v = b.u GROUP BY a.u)"
_EXACT = f"""{_EDGES}, {_DEGREES}, {_TWO}, three AS (SELECT a.u AS account, count(*) AS three_cycles FROM e a JOIN e b ON a.v = b.u JOIN e c ON b.v = c.u AND c.v = a.u WHERE a.u <> b.v GROUP BY a.u),
  p AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e), tr AS (SELECT account, count(*) AS t FROM (SELECT unnest([a.u, b.u, b.v]) AS account FROM p a JOIN p b ON a.v = b.u JOIN p c ON c.u = a.u AND c.v = b.v) GROUP BY account),
  pd AS (SELECT account, count(*) AS d FROM (SELECT unnest([u, v]) AS account FROM p) GROUP BY account),
  late AS (SELECT * FROM txn WHERE us >= (SELECT max(us) FROM txn) - {7 * D}), eg AS (SELECT account, sum(i) AS ego_in, sum(o) AS ego_out FROM (SELECT sender AS account, 0.0::DOUBLE AS i, amount AS o FROM late UNION ALL SELECT receiver, amount, 0 FROM late) GROUP BY account)"""


@query("gr_features_exact", f"""WITH {TXN_SQL}, {_EXACT} SELECT dg.account, in_degree, out_degree, in_unique, out_unique, coalesce(two_cycles, 0)::BIGINT AS two_cycles, coalesce(three_cycles, 0)::BIGINT AS three_cycles,
  round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1))::DOUBLE ELSE 0 END, 6) AS clustering, round(coalesce(ego_in, 0), 2) AS ego_in, round(coalesce(ego_out, 0), 2) AS ego_out, round(in_unique / (in_unique + out_unique + 1e-9::DOUBLE), 6) AS fan_in_ratio, round(out_unique / (in_unique + out_unique + 1e-9::DOUBLE), 6) AS fan_out_ratio
  FROM dg LEFT JOIN two USING (account) LEFT JOIN three USING (account) LEFT JOIN pd USING (account) LEFT JOIN tr USING (account) LEFT JOIN eg USING (account)""")
def gr_features_exact(spark, d):
    out = G.exact_features(txn(spark, d))
    return out.select("account", "in_degree", "out_degree", "in_unique", "out_unique", "two_cycles", "three_cycles", r("clustering", 6).alias("clustering"), r("ego_in", 2).alias("ego_in"), r("ego_out", 2).alias("ego_out"), r("fan_in_ratio", 6).alias("fan_in_ratio"), r("fan_out_ratio", 6).alias("fan_out_ratio"))


@query("jn_graph_features", f"""WITH {TXN_SQL}, {_EDGES}, {_DEGREES}, {_TWO} SELECT tx_id, in_degree AS g_in_degree, out_degree AS g_out_degree, in_unique AS g_in_unique, out_unique AS g_out_unique, coalesce(two_cycles, 0)::BIGINT AS g_two_cycles
  FROM txn JOIN dg ON dg.account = sender LEFT JOIN two ON two.account = sender""")
def jn_graph_features(spark, d):
    t = txn(spark, d)
    features = G.degrees(t).join(G.two_cycles(G.adjacency(t)), "account", "left")
    columns = ("in_degree", "out_degree", "in_unique", "out_unique", "two_cycles")
    return G.with_graph_features(t, features, columns).select("tx_id", *[f"g_{c}" for c in columns])


@query("jn_communities_topped_up", f"""WITH {TXN_SQL}, {_EDGES}, {_labels_sql()}, a AS (SELECT sender AS account FROM txn UNION SELECT receiver FROM txn) SELECT account, coalesce(community, account) AS community FROM a LEFT JOIN l5 USING (account)""")
def jn_communities_topped_up(spark, d):
    t = txn(spark, d)
    accounts = t.select(F.col("sender").alias("account")).union(t.select("receiver"))
    return G.topped_up(G.label_propagation(G.adjacency(t)), accounts)


@query("gr_neighbourhood_edges", f"""WITH {TXN_SQL}, {_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), n AS (SELECT 1 AS account, 0 AS hop UNION ALL SELECT DISTINCT v, 1 FROM b WHERE u = 1 AND v <> 1), k AS (SELECT account FROM n ORDER BY hop, account LIMIT 200)
  SELECT u, v FROM e WHERE u IN (SELECT account FROM k) AND v IN (SELECT account FROM k)""")
def gr_neighbourhood_edges(spark, d):
    return G.neighbourhood_edges(G.adjacency(txn(spark, d)), 1, hops=1)


@query("agg_ring_ratio", f"""WITH {TXN_SQL}, m AS (SELECT us, sender AS account, amount > 3500000 AS bad FROM txn UNION ALL SELECT us, receiver, amount > 3500000 FROM txn WHERE sender <> receiver), b AS (SELECT account, count(*) AS suspicious, quantile_cont(us, 0.5) AS median FROM m WHERE bad GROUP BY account)
  SELECT account, max(suspicious) AS suspicious, count(*) AS total, bool_or(NOT bad AND us < median) AS has_before, bool_or(NOT bad AND us > median) AS has_after, round(max(suspicious) / count(*)::DOUBLE, 6) AS ratio FROM m JOIN b USING (account) GROUP BY account""")
def agg_ring_ratio(spark, d):
    return N.ring_ratios(txn(spark, d), F.col("amount") > 3_500_000).select("account", "suspicious", "total", "has_before", "has_after", r("ratio", 6).alias("ratio"))


@query("alr_point", f"""WITH {RULED_SQL} SELECT tx_id, sha256(tx_id::VARCHAR) AS alert_id, glevel AS risk_level_group FROM alerts WHERE (level IN ('High', 'Critical') OR glevel IN ('High', 'Critical')) AND sha256(tx_id::VARCHAR) = (SELECT min(sha256(tx_id::VARCHAR)) FROM alerts WHERE level IN ('High', 'Critical') OR glevel IN ('High', 'Critical'))""")
def alr_point(spark, d):
    found = G.cut(A.trigger(fused(spark, d)).select("tx_id", "alert_id", "risk_level_group"))
    least = found.agg(F.min("alert_id")).first()[0]
    return A.alert_by_id(found, least or "")


@query("src_export", f"""WITH {TXN_SQL}, s AS (SELECT amount, amount > 3500000 AS bad, us > (SELECT quantile_cont(us, 0.9) FROM txn) AS late FROM txn)
  SELECT CASE WHEN late THEN 'stream_transactions' ELSE 'historical_transactions' END AS file, count(*) AS n, round(sum(amount), 2) AS total, 0::BIGINT AS labels FROM s GROUP BY ALL UNION ALL SELECT 'hidden_ground_truth', count(*), round(sum(amount), 2), 1 FROM s WHERE bad""")
def src_export(spark, d):
    """The files of a split, written and read back: rows, amounts, and how many label columns they have."""
    t = txn(spark, d).withColumn("is_suspicious", F.col("amount") > 3_500_000)
    split = N.split_by_time(t.withColumn("ring_id", F.lit(None).cast("string"))).drop("ring_id")
    home = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export_split(split, t.where("is_suspicious").select("tx_id", "amount", "is_suspicious"), home)
    out = None
    for name in ("historical_transactions", "stream_transactions", "hidden_ground_truth"):
        rows = spark.read.option("header", True).csv(f"{home}/{name}")
        labels = len({"is_suspicious", "fraud_ring_id", "laundering_stage", "synthetic_pattern_type"} & set(rows.columns))
        part = rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("total")).select(F.lit(name).alias("file"), "n", "total", F.lit(labels).cast("long").alias("labels"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_joined_sink", f"WITH {TXN_SQL} SELECT tx_id, [channel, country] AS tags, amount FROM txn WHERE international")
def src_joined_sink(spark, d):
    joined = txn(spark, d).where("international").select("tx_id", F.array("channel", "country").alias("tags"), "amount")
    return write_joined(joined, f"{shared_folder(spark)}/joined-{uuid.uuid4().hex}")
