"""Queries on paths, dense parts, cycles and flow of the whole transfer graph, and graph features as of each transfer."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.operators import cycles as C
from riskweave.operators import flow as FL
from riskweave.operators import graph as G
from riskweave.operators import live_graph as L
from riskweave.operators import suspicious as X
from riskweave.operators import behaviour as B
from riskweave.operators import models as M
from riskweave.operators import networks as NN
from riskweave.operators import tree_shap as TS
from riskweave.plans.queries_core import _COUNTS, _EDGES, TXN_SQL, D, _densest_sql, _labels_sql, chi2_sql, query, r
from riskweave.plans.queries_risk import COLUMNS, _streamed, modelled
from riskweave.sources.tables import txn
from riskweave.streaming import keyed as K


def _betweenness_sql(levels: int = 8) -> str:
    """From every account, depth by depth and back."""
    steps = ["p0 AS (SELECT account AS s, account AS n, 1.0::DOUBLE AS w FROM nodes)"]
    seen = "SELECT s, n FROM p0"
    for i in range(1, levels):
        steps.append(f"p{i} AS MATERIALIZED (SELECT s, v AS n, sum(w) AS w FROM p{i - 1} JOIN e ON n = u WHERE (s, v) NOT IN ({seen}) GROUP BY s, v)")
        seen += f" UNION ALL SELECT s, n FROM p{i}"
    steps.append(f"b{levels - 1} AS (SELECT s, n, w, 0.0::DOUBLE AS x FROM p{levels - 1})")
    for i in range(levels - 2, 0, -1):
        steps.append(f"b{i} AS MATERIALIZED (SELECT p.s, p.n, p.w, p.w * coalesce(sum((1 + b.x) / b.w), 0) AS x FROM p{i} p LEFT JOIN (SELECT b.*, e.u FROM b{i + 1} b JOIN e ON e.v = b.n) b ON b.s = p.s AND b.u = p.n GROUP BY p.s, p.n, p.w)")
    union = " UNION ALL ".join(f"SELECT n, x FROM b{i}" for i in range(1, levels))
    return f"""WITH {TXN_SQL}, {_EDGES}, nodes AS (SELECT u AS account FROM e UNION SELECT v FROM e), {', '.join(steps)}, t AS (SELECT n, sum(x) AS x FROM ({union}) GROUP BY n), k AS (SELECT count(*) AS n FROM nodes)
  SELECT account, round(coalesce(x, 0) / greatest(1, (k.n - 1) * (k.n - 2)), 8) AS betweenness FROM nodes CROSS JOIN k LEFT JOIN t ON t.n = account"""


@query("gr_betweenness", _betweenness_sql())
def gr_betweenness(spark, d):
    return G.betweenness(G.adjacency(txn(spark, d)), sources=None).select("account", r("betweenness", 8).alias("betweenness"))


def _inner(spark, d):
    t = txn(spark, d)
    return t, G.cut(G.label_propagation(G.adjacency(t)))


@query("gr_densest", f"WITH {TXN_SQL}, {_EDGES}, {_labels_sql(5)}, {_densest_sql()} SELECT community, account, round(density, 8) AS density FROM part")
def gr_densest(spark, d):
    t, members = _inner(spark, d)
    inner = G.induced(t, members).select("community", F.col("sender").alias("u"), F.col("receiver").alias("v"))
    return G.densest(inner).select("community", "account", r("density", 8).alias("density"))


@query("gr_dense_benford", f"""WITH {TXN_SQL}, {_EDGES}, {_labels_sql(5)}, {_densest_sql()},
  x AS (SELECT community, {chi2_sql(_COUNTS)} AS chi2 FROM i JOIN part p USING (community) JOIN part q USING (community) WHERE p.account = u AND q.account = v GROUP BY community),
  y AS (SELECT community, {chi2_sql(_COUNTS)} AS whole FROM i GROUP BY community), z AS (SELECT community, count(*) AS n FROM l5 GROUP BY community), w AS (SELECT community, count(*) AS n, max(density) AS density FROM part GROUP BY community),
  v AS (SELECT community, w.n, w.density, CASE WHEN z.n > 2 THEN coalesce(chi2, 0) ELSE 0 END AS chi2, whole FROM y JOIN z USING (community) LEFT JOIN w USING (community) LEFT JOIN x USING (community))
  SELECT community, n AS densest_size, round(density, 8) AS densest_density, round(chi2, 4) AS benford_chi2_densest, round(whole, 4) AS benford_chi2_community, chi2 > 3.84 OR whole > 3.84 AS benford_anomaly FROM v""")
def gr_dense_benford(spark, d):
    t, members = _inner(spark, d)
    out = G.dense_benford(t, members)
    return out.select("community", "densest_size", r("densest_density", 8).alias("densest_density"), r("benford_chi2_densest").alias("benford_chi2_densest"), r("benford_chi2_community").alias("benford_chi2_community"), "benford_anomaly")


#: The two partners to which an account sends most.
_MAIN = """w AS (SELECT sender AS u, receiver AS v, sum(amount) AS weight FROM txn WHERE sender <> receiver GROUP BY ALL), m AS (SELECT u, v, weight FROM w QUALIFY row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) <= 2)"""


def _main_flows(spark, d):
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("weight"), "v"))
    return G.condensed(txn(spark, d)).withColumn("rank", rank).where("rank <= 2").select("u", "v", "weight")


@query("gr_longest_cycles", f"""WITH RECURSIVE {TXN_SQL}, {_MAIN}, b AS (SELECT u, v FROM m UNION SELECT v, u FROM m), c(node, seen) AS (SELECT u, v FROM b UNION SELECT c.node, b.v FROM c JOIN b ON c.seen = b.u),
  k AS (SELECT node, least(node, min(seen)) AS community FROM c GROUP BY node),
  p(start, path) AS (SELECT u, [u, v] FROM m WHERE v > u UNION ALL SELECT start, list_append(path, v) FROM p JOIN m ON m.u = path[-1] WHERE v > start AND NOT list_contains(path, v) AND len(path) < 8),
  f AS (SELECT start, len(path) AS n FROM p JOIN m ON m.u = path[-1] AND m.v = start) SELECT community, max(n)::INT AS max_cycle_length FROM f JOIN k ON k.node = start GROUP BY community""")
def gr_longest_cycles(spark, d):
    """The longest cycle of main flows in each of their components."""
    main = G.cut(_main_flows(spark, d))
    components = G.weak_components(main).select("account", F.col("component").alias("community"))
    at = components.select(F.col("account").alias("u"), "community")
    return C.longest_cycles(main.join(at, "u").select("community", "u", "v"))


_COMPONENTS = """b AS (SELECT u, v FROM m UNION SELECT v, u FROM m), c(node, seen) AS (SELECT u, v FROM b UNION SELECT c.node, b.v FROM c JOIN b ON c.seen = b.u), k AS (SELECT node, least(node, min(seen)) AS community FROM c GROUP BY node)"""


@query("gr_short_cycles", f"""WITH RECURSIVE {TXN_SQL}, {_MAIN}, {_COMPONENTS},
  p(start, path) AS (SELECT u, [u, v] FROM m WHERE v > u UNION ALL SELECT start, list_append(path, v) FROM p JOIN m ON m.u = path[-1] WHERE v > start AND NOT list_contains(path, v) AND len(path) < 8),
  f AS (SELECT community, list_append(path, start) AS path FROM p JOIN m ON m.u = path[-1] AND m.v = start JOIN k ON k.node = start QUALIFY row_number() OVER (PARTITION BY community ORDER BY len(path), path) <= 50),
  s AS (SELECT sender AS u, receiver AS v, max(amount) AS amount FROM txn GROUP BY ALL), j AS (SELECT path, unnest(range(1, len(path))) AS i FROM f), t AS (SELECT path, sum(amount) AS total FROM j JOIN s ON s.u = path[i] AND s.v = path[i + 1] GROUP BY path)
  SELECT community, path, (len(path) - 1)::INT AS path_length, round(total, 2) AS total_value FROM f JOIN t USING (path)""")
def gr_short_cycles(spark, d):
    """The first 50 round trips of main flows in each of their components."""
    main = G.cut(_main_flows(spark, d))
    at = G.weak_components(main).select(F.col("account").alias("u"), F.col("component").alias("community"))
    found = G.cut(X.short_cycles(main.join(at, "u").select("community", "u", "v")))
    return found.join(G.path_values(found.select("path"), txn(spark, d)), "path").select("community", "path", F.col("length").alias("path_length"), r("total_value", 2).alias("total_value"))


@query("gr_suspicious_paths")
def gr_suspicious_paths(spark, d):
    return X.profiles_and_paths(*_inner(spark, d))[2]


@query("gr_longest_cycles_of_communities")
def gr_longest_cycles_of_communities(spark, d):
    t, members = _inner(spark, d)
    return C.longest_cycles(G.induced(t, members).select("community", F.col("sender").alias("u"), F.col("receiver").alias("v")))


@query("gr_flow_communities")
def gr_flow_communities(spark, d):
    return FL.flow_communities(_main_flows(spark, d), turns=6, least_share=4)[0]


_FIELDS = ("sender_in_degree", "sender_out_degree", "sender_in_degree_unique", "sender_out_degree_unique", "sender_2hop_cycle_count", "sender_3hop_cycle_count", "receiver_in_degree", "receiver_out_degree")
_LIVE_SQL = f"""WITH {TXN_SQL}, {_EDGES}, {_labels_sql(5)}, z AS (SELECT community, count(*) AS n FROM l5 GROUP BY community),
  f AS MATERIALIZED (SELECT sender AS u, receiver AS v, min(us) AS x FROM txn WHERE sender <> receiver GROUP BY ALL),
  g AS (SELECT *, (row_number() OVER (PARTITION BY sender, receiver ORDER BY us, tx_id) = 1)::INT AS new FROM txn),
  two AS (SELECT a.u AS account, greatest(a.x, b.x) AS dt, 1 AS two, 0 AS three FROM f a JOIN f b ON a.u = b.v AND a.v = b.u),
  three AS (SELECT a.u AS account, greatest(a.x, b.x, c.x) AS dt, 0 AS two, 1 AS three FROM f a JOIN f b ON a.v = b.u JOIN f c ON b.v = c.u AND c.v = a.u),
  ev AS (SELECT tx_id, 's' AS role, sender AS account, us AS dt, 0 AS i, 1 AS o, 0 AS iu, new AS ou, 0 AS two, 0 AS three FROM g UNION ALL SELECT tx_id, 'r', receiver, us, 1, 0, new, 0, 0, 0 FROM g
    UNION ALL SELECT NULL, NULL, account, dt, 0, 0, 0, 0, two, three FROM two UNION ALL SELECT NULL, NULL, account, dt, 0, 0, 0, 0, two, three FROM three),
  s AS (SELECT tx_id, role, {', '.join(f'sum({c}) OVER w AS {c}' for c in ('i', 'o', 'iu', 'ou', 'two', 'three'))} FROM ev WINDOW w AS (PARTITION BY account ORDER BY dt RANGE UNBOUNDED PRECEDING)),
  n AS (SELECT tx_id, {', '.join(f"max({c}) FILTER (WHERE role = '{k}')::BIGINT AS {k}{c}" for k in 'sr' for c in ('i', 'o', 'iu', 'ou', 'two', 'three'))} FROM s WHERE tx_id IS NOT NULL GROUP BY tx_id),
  d AS (SELECT tx_id, (count(DISTINCT sender) OVER w)::INT AS iu24, CASE WHEN count(*) OVER w < 2 THEN 999 ELSE stddev_pop(amount) OVER w / (avg(amount) OVER w + 1e-9) END AS cv FROM txn WINDOW w AS (PARTITION BY receiver ORDER BY us RANGE BETWEEN {D} PRECEDING AND CURRENT ROW))
  SELECT t.tx_id, si AS sender_in_degree, so AS sender_out_degree, siu AS sender_in_degree_unique, sou AS sender_out_degree_unique, stwo AS sender_2hop_cycle_count, sthree AS sender_3hop_cycle_count, ri AS receiver_in_degree, ro AS receiver_out_degree,
    round(CASE WHEN si > 0 AND siu > 0 THEN 1 - siu / si::DOUBLE ELSE 0 END, 6) AS sender_fan_in_score, round(CASE WHEN so > 0 AND sou > 0 THEN 1 - sou / so::DOUBLE ELSE 0 END, 6) AS sender_fan_out_score,
    coalesce(a.community, -1) AS sender_community_id, coalesce(b.community, -1) AS receiver_community_id, coalesce(z.n, 0) AS sender_community_size, coalesce(a.community = b.community, false) AS shared_community,
    iu24 AS receiver_in_degree_unique_24h, round(cv, 4) AS receiver_inflow_amount_cv
  FROM txn t JOIN n USING (tx_id) JOIN d USING (tx_id) LEFT JOIN l5 a ON a.account = sender LEFT JOIN l5 b ON b.account = receiver LEFT JOIN z ON z.community = a.community"""


@query("live_vector", _LIVE_SQL)
def live_vector(spark, d):
    """The fields of the live vector that no other query has."""
    t, members = _inner(spark, d)
    accounts = members.join(members.groupBy("community").agg(F.count("*").alias("community_size")), "community")
    out = L.live_vector(t, accounts)
    return out.select(
        "tx_id", *_FIELDS, r("sender_fan_in_score", 6).alias("sender_fan_in_score"), r("sender_fan_out_score", 6).alias("sender_fan_out_score"), "sender_community_id", "receiver_community_id", "sender_community_size", "shared_community",
        "receiver_in_degree_unique_24h", r("receiver_inflow_amount_cv").alias("receiver_inflow_amount_cv"),
    )



@query("str_account_features", """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events) SELECT event_id, user_id, row_number() OVER w AS n_events, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS velocity_1h,
  round(coalesce((us - lag(us) OVER w) / 1e6::DOUBLE, 0), 3) AS gap_seconds, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) = 1 AS new_type, round((us - min(us) OVER (PARTITION BY user_id)) / 1e6::DOUBLE, 3) AS age_seconds FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""")
def str_account_features(spark, d):
    K.use_state_store(spark)
    out = _streamed(spark, d, lambda s: K.account_features(K.prioritised(s)))
    return out.select("event_id", "user_id", "n_events", "velocity_1h", r("gap_seconds", 3).alias("gap_seconds"), "new_type", r("age_seconds", 3).alias("age_seconds"))


@query("str_memory")
def str_memory(spark, d):
    K.use_state_store(spark)
    return _streamed(spark, d, lambda s: K.account_memory(K.prioritised(s))).select("event_id", "user_id", r("drift", 6).alias("drift"))


@query("ml_partner_embeddings")
def ml_partner_embeddings(spark, d):
    t = txn(spark, d)
    edges = G.cut(G.adjacency(t))
    nodes = G.cut(NN.node_features(G.degrees(t), ["in_degree", "out_degree", "in_unique", "out_unique"]))
    return NN.PartnerEmbeddings(epochs=3).fit(nodes, edges).embed(nodes, edges)


@query("ml_split", f"""WITH {TXN_SQL}, l AS (SELECT tx_id, (fmod(amount, 7) < 1)::INT AS label FROM txn), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(tx_id::VARCHAR), tx_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM l)
  SELECT tx_id, label, (i >= floor(n * 0.6::DOUBLE + 0.5))::INT + (i >= floor(n * 0.8::DOUBLE + 0.5))::INT AS part FROM k""")
def ml_split(spark, d):
    labelled = txn(spark, d).select("tx_id", (F.col("amount") % 7 < 1).cast("int").alias("label"))
    return M.stratified_split(labelled, "tx_id", "label")


@query("ml_attributions")
def ml_attributions(spark, d):
    """Why a booster scores each transfer as it does."""
    from pyspark.ml.classification import GBTClassifier

    data = M.assemble(M.class_weight(G.cut(M.stratified_split(modelled(spark, d), "tx_id", "label"))), COLUMNS)
    model = GBTClassifier(maxIter=5, maxDepth=4, stepSize=0.1, weightCol="weight", seed=42).fit(data.where("part = 0"))
    return TS.tree_attributions(data, COLUMNS, model, top=5).select("tx_id", "base_value", "margin", "top_features")


@query("ml_autoencoder")
def ml_autoencoder(spark, d):
    data = G.cut(B.standardise(modelled(spark, d).select("tx_id", *COLUMNS), COLUMNS))
    z = [f"z_{c}" for c in COLUMNS]
    return NN.Autoencoder(z, hidden=16, code=4, epochs=3).fit(data, "tx_id").score(data).select("tx_id", "mse", "drivers")
