"""Further queries: joins with communities and labels, set operations, sampling, patterns, narratives, sessions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.operators import behaviour as B
from riskweave.operators import fusion as U
from riskweave.operators import graph as G
from riskweave.operators import models as M
from riskweave.operators import rules as R
from riskweave.plans.queries_core import _EDGES, TXN_SQL, _labels_sql, query, r
from riskweave.plans.queries_risk import RULED_SQL, _streamed, fused, labelled, ruled
from riskweave.sources.tables import table, txn
from riskweave.streaming import stream as T


@query("jn_communities", f"""WITH {TXN_SQL}, {_EDGES}, {_labels_sql()} SELECT tx_id, coalesce(a.community, -1) AS sender_community, coalesce(b.community, -1) AS receiver_community, coalesce(a.community = b.community, false) AS shared_community
  FROM txn LEFT JOIN l5 a ON a.account = sender LEFT JOIN l5 b ON b.account = receiver""")
def jn_communities(spark, d):
    t = txn(spark, d)
    labels = G.label_propagation(G.adjacency(t))
    a, b = (labels.select(F.col("account").alias(f"{x}_account"), F.col("community").alias(x)) for x in "ab")
    out = t.join(a, F.col("sender") == F.col("a_account"), "left").join(b, F.col("receiver") == F.col("b_account"), "left")
    return out.select("tx_id", F.coalesce("a", F.lit(-1)).alias("sender_community"), F.coalesce("b", F.lit(-1)).alias("receiver_community"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("shared_community"))


@query("jn_scores_labels", "SELECT doc_id, coalesce(toxic = 1, false) AS sar_filed, n_chars % 100 AS score FROM documents LEFT JOIN labels USING (doc_id)")
def jn_scores_labels(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    return table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("sar_filed"), (F.col("n_chars") % 100).alias("score"))


@query("agg_quiet_accounts", f"WITH {TXN_SQL} SELECT account, count(*) AS transfers FROM (SELECT sender AS account FROM txn UNION ALL SELECT receiver FROM txn) GROUP BY account HAVING count(*) <= 4")
def agg_quiet_accounts(spark, d):
    t = txn(spark, d)
    ends = t.select(F.col("sender").alias("account")).unionAll(t.select("receiver"))
    return ends.groupBy("account").agg(F.count("*").alias("transfers")).where("transfers <= 4")


@query("agg_class_weight", "SELECT toxic AS label, count(*) AS n, round(max(CASE WHEN toxic = 1 THEN (SELECT sum((toxic = 0)::INT) / greatest(1, sum((toxic = 1)::INT))::DOUBLE FROM labels) ELSE 1 END), 6) AS weight FROM labels GROUP BY toxic")
def agg_class_weight(spark, d):
    return M.class_weight(table(spark, d, "labels").select(F.col("toxic").alias("label"))).groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("agg_top_patterns", f"WITH {RULED_SQL}, x AS (SELECT unnest(fired) AS rule, amount FROM ruled) SELECT rule, count(*) AS n, round(max(amount), 2) AS most FROM x GROUP BY rule ORDER BY n DESC, rule LIMIT 5")
def agg_top_patterns(spark, d):
    x = ruled(spark, d).select(F.explode("triggered_rules").alias("rule"), "amount")
    return x.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.max("amount"), 2).alias("most")).orderBy(F.desc("n"), "rule").limit(5)


@query("gr_undirected", f"WITH {TXN_SQL}, p AS (SELECT DISTINCT least(sender, receiver) AS u, greatest(sender, receiver) AS v FROM txn WHERE sender <> receiver) SELECT u, v FROM p UNION ALL SELECT v, u FROM p")
def gr_undirected(spark, d):
    pairs = G.undirected(G.adjacency(txn(spark, d)))
    return pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


@query("gr_induced", f"""WITH {TXN_SQL}, {_EDGES}, {_labels_sql()} SELECT a.community, count(*) AS transfers, round(sum(amount), 2) AS flow FROM txn JOIN l5 a ON a.account = sender JOIN l5 b ON b.account = receiver AND a.community = b.community WHERE sender <> receiver GROUP BY a.community""")
def gr_induced(spark, d):
    t = txn(spark, d)
    return G.induced(t, G.label_propagation(G.adjacency(t))).groupBy("community").agg(F.count("*").alias("transfers"), F.round(F.sum("amount"), 2).alias("flow"))


@query("set_roles", f"WITH {TXN_SQL}, s AS (SELECT DISTINCT sender AS a FROM txn), t AS (SELECT DISTINCT receiver AS a FROM txn) SELECT 'both' AS role, count(*) AS n FROM (SELECT a FROM s INTERSECT SELECT a FROM t) UNION ALL SELECT 'sends', count(*) FROM (SELECT a FROM s EXCEPT SELECT a FROM t) UNION ALL SELECT 'any', count(*) FROM (SELECT a FROM s UNION SELECT a FROM t)")
def set_roles(spark, d):
    t = txn(spark, d)
    s, q = t.select(F.col("sender").alias("a")), t.select(F.col("receiver").alias("a"))
    counted = lambda df, role: df.agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), "n")
    return counted(s.intersect(q), "both").unionAll(counted(s.subtract(q), "sends")).unionAll(counted(s.union(q).distinct(), "any"))


@query("srt_stride", f"WITH {TXN_SQL} SELECT tx_id, us FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY us, tx_id) AS i FROM txn) WHERE i % 10 = 1")
def srt_stride(spark, d):
    ranked = txn(spark, d).withColumn("i", F.row_number().over(B.ordered()))
    return ranked.where("i % 10 = 1").select("tx_id", "us")


@query("srt_top_drivers", """SELECT doc_id, list_transform(list_sort([{'o': -(n % 7 / 7.0::DOUBLE), 'c': 'a'}, {'o': -(n % 11 / 11.0::DOUBLE), 'c': 'b'}, {'o': -(n % 13 / 13.0::DOUBLE), 'c': 'c'}, {'o': -(n % 17 / 17.0::DOUBLE), 'c': 'd'}])[1:3], lambda x: x.c) AS drivers FROM (SELECT doc_id, n_chars AS n FROM documents)""")
def srt_top_drivers(spark, d):
    n = F.col("n_chars")
    parts = F.array(*[F.struct((-(n % m / m)).alias("o"), F.lit(c).alias("c")) for c, m in zip("abcd", (7, 11, 13, 17), strict=True)])
    return table(spark, d, "documents").select("doc_id", F.slice(F.array_sort(parts), 1, 3)["c"].alias("drivers"))


@query("win_disambiguate", "SELECT event_id, epoch_us(ts) // 60000000 * 60000000 + row_number() OVER (PARTITION BY epoch_us(ts) // 60000000 ORDER BY event_id) - 1 AS us FROM events")
def win_disambiguate(spark, d):
    minute = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 60000000 * 60000000")
    at = table(spark, d, "events").select("event_id", minute.alias("minute"))
    return at.select("event_id", (F.col("minute") + F.row_number().over(W.partitionBy("minute").orderBy("event_id")) - 1).alias("us"))


@query("fus_patterns", f"""WITH {RULED_SQL} SELECT tx_id, list_concat(list_transform(fired, lambda x: 'L1:' || x), CASE WHEN anomaly >= 60 THEN ['L2:circular'] ELSE [] END, ['L3:amount'], CASE WHEN cycle THEN ['L5:closes a cycle'] ELSE [] END) AS patterns FROM fused""")
def fus_patterns(spark, d):
    none = F.array().cast("array<string>")
    p = U.patterns(F.col("triggered_rules"), F.col("anomaly_score"), F.lit("circular"), F.array(F.lit("amount"), F.lit("amount")), none, F.when(F.col("edge_creates_cycle"), F.array(F.lit("closes a cycle"))))
    return fused(spark, d).select("tx_id", p.alias("patterns"))


@query("fus_breakdown", f"WITH {RULED_SQL} SELECT tx_id, round(0.3 * rule_score, 4) AS rule_points, round(25.0 * cycle::INT, 4) AS graph_points, floor(0.15::DOUBLE * anomaly + 0.5) AS anomaly_points FROM fused")
def fus_breakdown(spark, d):
    c = F.col("contributions")
    return fused(spark, d).select("tx_id", c["rule_score"].alias("rule_points"), c["graph_score"].alias("graph_points"), F.floor(F.col("anomaly_score") * 0.15 + 0.5).cast("double").alias("anomaly_points"))


_RULE_ROWS = ", ".join(f"('{x.id}', {x.weight}::DOUBLE)" for x in R.RULES)


@query("api_narrative", f"""WITH {RULED_SQL}, ruleset(rule, weight) AS (VALUES {_RULE_ROWS}), x AS (SELECT tx_id, unnest(fired) AS rule FROM alerts WHERE glevel = 'Critical')
  SELECT tx_id, count(*) AS indicators, round(max(weight), 2) AS strongest, CASE WHEN max(weight) >= 1 THEN 'file a report' WHEN count(*) > 2 THEN 'investigate' ELSE 'monitor' END AS recommendation FROM x JOIN ruleset USING (rule) GROUP BY tx_id""")
def api_narrative(spark, d):
    weights = spark.createDataFrame([(x.id, x.weight) for x in R.RULES], "rule string, weight double")
    found = fused(spark, d).where("risk_level_group = 'Critical'").select("tx_id", F.explode("triggered_rules").alias("rule")).join(F.broadcast(weights), "rule")  # a row a rule
    advice = F.when(F.max("weight") >= 1, "file a report").when(F.count("*") > 2, "investigate").otherwise("monitor")
    return found.groupBy("tx_id").agg(F.count("*").alias("indicators"), F.round(F.max("weight"), 2).alias("strongest"), advice.alias("recommendation"))


@query("api_filter_text", f"WITH {TXN_SQL} SELECT tx_id FROM txn WHERE contains(lower(concat_ws(' ', tx_id, sender, receiver, channel, country)), 'click') AND country = 'AE'")
def api_filter_text(spark, d):
    words = F.lower(F.concat_ws(" ", "tx_id", "sender", "receiver", "channel", "country"))
    return txn(spark, d).where(words.contains("click") & (F.col("country") == "AE")).select("tx_id")


@query("ev_curve_thin")
def ev_curve_thin(spark, d):
    from riskweave.operators.evaluation import curve, thin

    return thin(curve(labelled(spark, d)), "threshold", 20).select("threshold", r("precision", 6).alias("precision"), r("recall", 6).alias("recall"))


@query("str_sessions", """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def str_sessions(spark, d):
    out = _streamed(spark, d, T.sessions, "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("ml_meta_fusion")
def ml_meta_fusion(spark, d):
    """A booster over layer scores in place of the fixed weights, fitted on two thirds and applied to the rest."""
    data = M.hash_split(labelled(spark, d).withColumn("label", F.col("y_true")), "tx_id", "label", (0.5, 0.2, 0.3))
    columns = [f"score_{x}" for x in ("rule", "graph", "supervised", "anomaly", "tgn")]
    scored = M.SupervisedScorer(columns, rounds=4, trees=8).fit(data.where("part = 0"), data.where("part = 1")).score(data.where("part = 2"))
    return U.fuse(scored.select("tx_id", "supervised_score"), meta=F.col("supervised_score") / 100).select("tx_id", "transaction_risk_score", "risk_level", "fusion_mode")
