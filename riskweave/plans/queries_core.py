"""Queries over the transaction view, each with DuckDB SQL for the same result."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.operators import behaviour as B
from riskweave.operators import graph as G
from riskweave.operators import live_graph as L
from riskweave.sources.tables import TXN_SQL, table, txn

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
H, D = 3_600_000_000, 86_400_000_000
BENFORD_SQL = [repr(x) for x in S.BENFORD]
DIGIT = "substr(abs(trunc(amount))::BIGINT::VARCHAR, 1, 1)::INT"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def r(c, places: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def over(width: int, key: str = "sender") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)"


def chi2_sql(counts: list[str]) -> str:
    n = "(" + " + ".join(counts) + ")"
    return f"CASE WHEN {n} >= 5 THEN " + " + ".join(f"power({c} - {n} * {e}::DOUBLE, 2) / ({n} * {e}::DOUBLE)" for c, e in zip(counts, BENFORD_SQL, strict=True)) + " ELSE 0.0::DOUBLE END"


@query("src_txn_view", f"WITH {TXN_SQL} SELECT tx_id, us, sender, receiver, amount, channel, device, ip, country, receiver_country, international, lat, lon, kyc FROM txn")
def src_txn_view(spark, d):
    return txn(spark, d).select("tx_id", "us", "sender", "receiver", "amount", "channel", "device", "ip", "country", "receiver_country", "international", "lat", "lon", "kyc")


@query("prj_temporal", f"""WITH {TXN_SQL} SELECT tx_id, hour(ts)::INT AS hour_of_day, (isodow(ts) - 1)::INT AS day_of_week, hour(ts) >= 22 OR hour(ts) < 6 AS night, isodow(ts) >= 6 AS weekend,
  round(sin(2 * pi() * hour(ts) / 24), 4) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 4) + 0.0 AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 4) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 4) + 0.0 AS dow_cos FROM txn""")
def prj_temporal(spark, d):
    ts = F.col("ts")
    (hs, hc), (ds, dc) = S.cyclic(S.hour_of(ts), 24), S.cyclic(S.weekday_of(ts), 7)
    return txn(spark, d).select("tx_id", S.hour_of(ts).alias("hour_of_day"), S.weekday_of(ts).alias("day_of_week"), S.is_night(ts).alias("night"), S.is_weekend(ts).alias("weekend"), *[(r(x) + 0.0).alias(n) for x, n in ((hs, "hour_sin"), (hc, "hour_cos"), (ds, "dow_sin"), (dc, "dow_cos"))])


@query("prj_amount", f"""WITH {TXN_SQL} SELECT tx_id, amount % 100000 = 0 AS round_amount, amount BETWEEN 850000 AND 999000 AS sub_threshold, round(ln(1 + greatest(amount, 0)), 6) AS amount_log,
  {DIGIT} AS digit, greatest(1, {DIGIT}) AS digit_clipped, round(log10(1 + 1.0::DOUBLE / greatest(1, {DIGIT})), 6) AS benford, greatest(0.0::DOUBLE, least(100.0::DOUBLE, amount / 10000)) AS clamped FROM txn""")
def prj_amount(spark, d):
    a = F.col("amount")
    expected = F.element_at(F.array(*[F.lit(x) for x in S.BENFORD]), S.clipped_digit(a))
    return txn(spark, d).select("tx_id", S.round_amount(a).alias("round_amount"), S.sub_threshold(a).alias("sub_threshold"), r(S.log_amount(a), 6).alias("amount_log"), S.leading_digit(a).alias("digit"), S.clipped_digit(a).alias("digit_clipped"), r(expected, 6).alias("benford"), S.clamp(a / 10000, 0, 100).alias("clamped"))


HAVERSINE = "2 * 6371.0088 * asin(sqrt(greatest(0.0::DOUBLE, least(1.0::DOUBLE, power(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * power(sin(radians({b2} - {a2}) / 2), 2)))))"


@query("win_travel", f"""WITH {TXN_SQL}, p AS (SELECT *, lag(us) OVER w AS pus, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM txn WINDOW w AS (PARTITION BY sender ORDER BY us, tx_id)),
  g AS (SELECT *, coalesce(greatest(0.0::DOUBLE, (us - pus) / 1e6::DOUBLE), 0) AS gap, CASE WHEN plat IS NULL THEN 0 ELSE {HAVERSINE.format(a1='plat', a2='plon', b1='lat', b2='lon')} END AS km FROM p)
  SELECT tx_id, round(gap, 6) AS tx_gap_seconds, round(km, 2) AS geo_distance_km, coalesce(gap > 0 AND km / (gap / 3600) > 900, false) AS impossible_travel_flag,
  country IN ('AE', 'MU', 'CN', 'NG', 'PK') OR receiver_country IN ('AE', 'MU', 'CN', 'NG', 'PK') AS high_risk FROM g""")
def win_travel(spark, d):
    return B.travel(txn(spark, d)).select("tx_id", r("tx_gap_seconds", 6).alias("tx_gap_seconds"), r("geo_distance_km", 2).alias("geo_distance_km"), "impossible_travel_flag", S.high_risk(F.col("country"), F.col("receiver_country")).alias("high_risk"))


@query("prj_scores", f"""WITH {TXN_SQL} SELECT tx_id, round(100 / (1 + exp(-(s - 65) * 0.2)), 6) AS recalibrated, round(greatest(0, least(100, 50 - 200 * (s / 100 - 0.5))), 6) AS from_decision, round(greatest(0, least(100, (s / 100 - 0.1) * 200)), 6) AS from_error,
  CASE WHEN s <= 30 THEN 'Low' WHEN s <= 60 THEN 'Medium' WHEN s <= 80 THEN 'High' ELSE 'Critical' END AS level FROM (SELECT tx_id, greatest(0, least(100, amount / 50000)) AS s FROM txn)""")
def prj_scores(spark, d):
    s = F.col("s")
    at = txn(spark, d).select("tx_id", S.clamp(F.col("amount") / 50000, 0, 100).alias("s"))
    return at.select("tx_id", r(S.recalibrate(s), 6).alias("recalibrated"), r(S.decision_to_score(s / 100 - 0.5), 6).alias("from_decision"), r(S.reconstruction_to_score(s / 100, F.lit(0.1)), 6).alias("from_error"), S.risk_level(s).alias("level"))


@query("prj_vectors", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, round(CASE WHEN list_dot_product(a, a) * list_dot_product(b, b) > 0 THEN 0.5 * greatest(0, least(2, 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))) ELSE 1 END, 6) AS drift,
  round(1 - 1 / (1 + exp(-list_dot_product(a, b))), 6) AS link FROM p""")
def prj_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pair = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pair.select("vec_id", r(S.embedding_drift(F.col("a"), F.col("b")), 6).alias("drift"), r(S.link_surprise(F.col("a"), F.col("b")), 6).alias("link"))


@query("prj_text", f"""WITH {TXN_SQL} SELECT tx_id, CASE WHEN amount >= 1e7 THEN printf('%.2f Cr', amount / 1e7) WHEN amount >= 1e5 THEN printf('%.2f L', amount / 1e5) ELSE printf('%.0f', amount) END AS humanised,
  substr('ACC-' || sender, 1, 5) AS label, strftime(ts, '%d %b %Y %H:%M') AS shown, lower(channel) IN ('true', '1', 't', 'yes', 'y') AS truth, contains(lower(concat_ws(' ', sender, receiver, channel)), 'click') AS matches FROM txn WHERE round(amount * 1e-5, 3) <> round(amount * 1e-5, 2) OR amount < 1e5""")
def prj_text(spark, d):
    a = F.col("amount")
    keep = (F.round(a * 1e-5, 3) != F.round(a * 1e-5, 2)) | (a < 1e5)
    words = F.lower(F.concat_ws(" ", "sender", "receiver", "channel"))
    return txn(spark, d).where(keep).select("tx_id", S.humanise_amount(a).alias("humanised"), F.concat(F.lit("ACC-"), "sender").substr(1, 5).alias("label"), F.date_format("ts", "dd MMM yyyy HH:mm").alias("shown"), S.truth(F.col("channel")).alias("truth"), words.contains("click").alias("matches"))


@query("prj_json", """SELECT event_id, [event_type, 'L1:R0' || (event_id % 9 + 1)] AS patterns, 'R0' || (event_id % 9 + 1) AS rule, json_extract(props, '$.k')::DOUBLE AS score, NULL::DOUBLE AS absent FROM events""")
def prj_json(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("event_type", F.concat(F.lit("L1:R0"), (F.col("event_id") % 9 + 1)))))
    printed = F.concat(F.lit("['"), "event_type", F.lit("', 'L1:R0"), (F.col("event_id") % 9 + 1), F.lit("']"))
    listed = S.parse_list(F.coalesce(text, printed))
    nested = F.concat(F.lit('{"scores":'), "props", F.lit("}"))
    return e.select("event_id", listed.alias("patterns"), S.rule_of(F.element_at(listed, 2)).alias("rule"), S.breakdown_field(nested, "scores", "k").alias("score"), S.breakdown_field(nested, "scores", "none").alias("absent"))


@query("prj_filter", f"WITH {TXN_SQL} SELECT tx_id, amount FROM txn WHERE amount BETWEEN 500000 AND 2000000 AND us >= (SELECT max(us) FROM txn) - 7 * {D}")
def prj_filter(spark, d):
    t = txn(spark, d)
    last = t.agg(F.max("us").alias("last"))
    return t.where(F.col("amount").between(500000, 2000000)).join(F.broadcast(last)).where(F.col("us") >= F.col("last") - 7 * D).select("tx_id", "amount")  # last is one row


@query("prj_label_codes", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment_code FROM customer")
def prj_label_codes(spark, d):
    from riskweave.operators.models import label_codes

    return label_codes(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "c_mktsegment_code")


@query("prj_edge_features", f"""WITH {TXN_SQL} SELECT tx_id, [round(amount / 1e6, 6), round(ln(1 + amount), 6), international::INT::DOUBLE, round(port / (port + 1.0::DOUBLE), 6)] AS edge, port FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY us, tx_id) - 1 AS port FROM txn)""")
def prj_edge_features(spark, d):
    e = S.edge_features(F.col("amount"), F.col("international"), F.col("port"))
    return L.ports(txn(spark, d)).select("tx_id", F.transform(e, lambda x: F.round(x, 6)).alias("edge"), F.col("port").cast("long").alias("port"))


@query("win_velocity", f"WITH {TXN_SQL} SELECT tx_id, count(*) {over(H)} AS tx_velocity_1h, count(*) {over(6 * H)} AS tx_velocity_6h, count(*) {over(D)} AS tx_velocity_24h, count(*) {over(7 * D)} AS tx_velocity_7d FROM txn")
def win_velocity(spark, d):
    return B.velocity(txn(spark, d)).select("tx_id", *[f"tx_velocity_{w}" for w in ("1h", "6h", "24h", "7d")])


@query("win_amounts", f"""WITH {TXN_SQL} SELECT tx_id, round(avg(amount) {over(7 * D)}, 2) AS avg_amount_7d, round(coalesce(stddev_pop(amount) {over(7 * D)}, 0), 2) AS std_amount_7d, round(sum(amount) {over(30 * D)} / 30, 2) AS avg_daily_volume_30d,
  round((amount - avg(amount) {over(30 * D)}) / CASE WHEN stddev_pop(amount) {over(30 * D)} > 0 THEN stddev_pop(amount) {over(30 * D)} ELSE 1 END, 4) AS amount_zscore FROM txn""")
def win_amounts(spark, d):
    return B.amounts(txn(spark, d)).select("tx_id", r("avg_amount_7d", 2).alias("avg_amount_7d"), r("std_amount_7d", 2).alias("std_amount_7d"), r("avg_daily_volume_30d", 2).alias("avg_daily_volume_30d"), r("amount_zscore").alias("amount_zscore"))


@query("win_ratios", f"""WITH {TXN_SQL} SELECT tx_id, round(avg((hour(ts) >= 22 OR hour(ts) < 6)::INT) {over(30 * D)}, 6) AS night_tx_ratio, round(avg((isodow(ts) >= 6)::INT) {over(30 * D)}, 6) AS weekend_tx_ratio, round(avg(international::INT) {over(30 * D)}, 6) AS cross_border_ratio_30d FROM txn""")
def win_ratios(spark, d):
    return B.ratios(txn(spark, d)).select("tx_id", *[r(c, 6).alias(c) for c in ("night_tx_ratio", "weekend_tx_ratio", "cross_border_ratio_30d")])


@query("win_distinct", f"WITH {TXN_SQL} SELECT tx_id, (count(DISTINCT receiver) {over(7 * D)})::INT AS beneficiary_count_7d, (count(DISTINCT receiver) {over(30 * D)})::INT AS beneficiary_count_30d, (count(DISTINCT ip) {over(D)})::INT AS ip_change_count_24h FROM txn")
def win_distinct(spark, d):
    return B.distincts(txn(spark, d)).select("tx_id", "beneficiary_count_7d", "beneficiary_count_30d", "ip_change_count_24h")


@query("win_switches", f"""WITH {TXN_SQL}, c AS (SELECT *, coalesce((lag(country) OVER w <> country)::INT, 0) AS cc, coalesce((lag(device) OVER w <> device)::INT, 0) AS dc FROM txn WINDOW w AS (PARTITION BY sender ORDER BY us, tx_id)),
  u AS (SELECT *, sum(cc) OVER w AS cu, sum(dc) OVER w AS du FROM c WINDOW w AS (PARTITION BY sender ORDER BY us, tx_id ROWS UNBOUNDED PRECEDING))
  SELECT tx_id, (cu - first_value(cu) {over(7 * D)})::BIGINT AS country_switch_count_7d, (du - first_value(du) {over(7 * D)})::BIGINT AS device_change_count_7d FROM u""")
def win_switches(spark, d):
    return B.switches(txn(spark, d)).select("tx_id", "country_switch_count_7d", "device_change_count_7d")


@query("win_devices", f"""WITH {TXN_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY sender, device ORDER BY us, tx_id) = 1 AS new_device_flag FROM txn)
  SELECT f.tx_id, new_device_flag, greatest(0, sum(new_device_flag::INT) OVER (PARTITION BY f.device ORDER BY us, tx_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS shared_device_count, greatest(0, n - 1)::BIGINT AS shared_device_count_total
  FROM f JOIN (SELECT device, count(DISTINCT sender) AS n FROM txn GROUP BY device) t ON t.device = f.device""")
def win_devices(spark, d):
    return B.shared_devices_total(B.devices(txn(spark, d))).select("tx_id", "new_device_flag", "shared_device_count", "shared_device_count_total")


_WINDOWED = [f"(sum(({DIGIT} = {x})::INT) {over(30 * D)})" for x in range(1, 10)]


@query("win_digits", f"""WITH {TXN_SQL}, c AS (SELECT tx_id, {', '.join(f'{w} AS d{i}' for i, w in enumerate(_WINDOWED, 1))} FROM txn),
  e AS (SELECT tx_id, -sum(p * log2(p)) AS h FROM (SELECT tx_id, n / sum(n) OVER (PARTITION BY tx_id)::DOUBLE AS p FROM (SELECT a.tx_id, b.receiver, count(*) AS n FROM txn a JOIN txn b ON a.sender = b.sender AND b.us BETWEEN a.us - {30 * D} AND a.us GROUP BY ALL)) GROUP BY tx_id)
  SELECT tx_id, round({chi2_sql([f'd{i}' for i in range(1, 10)])}, 4) AS benford_chi2_score, round(h, 4) + 0.0 AS receiver_entropy FROM c JOIN e USING (tx_id)""")
def win_digits(spark, d):
    return B.digits(txn(spark, d)).select("tx_id", r("benford_chi2_score").alias("benford_chi2_score"), (r("receiver_entropy") + 0.0).alias("receiver_entropy"))


@query("win_buckets", f"""WITH {TXN_SQL}, b AS (SELECT *, floor((us - (SELECT min(us) FROM txn)) / ({30 * D})::DOUBLE)::BIGINT AS bucket FROM txn), c AS (SELECT sender, bucket, receiver, count(*) AS n, {', '.join(f'sum(({DIGIT} = {x})::INT) AS d{x}' for x in range(1, 10))} FROM b GROUP BY ALL),
  s AS (SELECT sender, bucket, sum(n) AS t, sum(n * log2(n)) AS nl, {', '.join(f'sum(d{x}) AS d{x}' for x in range(1, 10))} FROM c GROUP BY ALL)
  SELECT sender, bucket, t::BIGINT AS n_tx, round({chi2_sql([f'd{i}' for i in range(1, 10)])}, 4) AS benford_chi2, round(log2(t) - nl / t, 4) + 0.0 AS receiver_entropy FROM s""")
def win_buckets(spark, d):
    return B.buckets(txn(spark, d)).select("sender", "bucket", "n_tx", r("benford_chi2").alias("benford_chi2"), (r("receiver_entropy") + 0.0).alias("receiver_entropy"))


@query("win_last_inflow", f"""WITH {TXN_SQL}, i AS (SELECT receiver AS node, us, max(amount) AS amount FROM txn GROUP BY ALL)
  SELECT t.tx_id, coalesce(i.amount, 0) AS last_inflow_amount, round(coalesce((t.us - i.us) / 1e6::DOUBLE, -1), 6) AS last_inflow_gap FROM txn t ASOF LEFT JOIN i ON t.sender = i.node AND t.us > i.us""")
def win_last_inflow(spark, d):
    gap = F.when(F.col("last_inflow_gap") == float("inf"), F.lit(-1.0)).otherwise(F.col("last_inflow_gap"))
    return L.sender_history(txn(spark, d)).select("tx_id", "last_inflow_amount", r(gap, 6).alias("last_inflow_gap"))


@query("win_relay", f"""WITH {TXN_SQL}, e AS (SELECT tx_id, us, sender AS node, receiver AS partner, 'out' AS role FROM txn UNION ALL SELECT tx_id, us, receiver, sender, 'in' FROM txn),
  w AS (SELECT *, count(DISTINCT CASE WHEN role = 'in' THEN partner END) {over(7 * D, 'node')} AS i, count(DISTINCT CASE WHEN role = 'out' THEN partner END) {over(7 * D, 'node')} AS o FROM e)
  SELECT tx_id, i BETWEEN 1 AND 2 AND o BETWEEN 1 AND 2 AS relay FROM w WHERE role = 'out'""")
def win_relay(spark, d):
    return L.sender_history(txn(spark, d)).select("tx_id", "relay")


@query("win_fan_in", f"""WITH {TXN_SQL} SELECT tx_id, (count(DISTINCT sender) {over(D, 'receiver')})::INT AS in_unique_24h, round(CASE WHEN count(*) {over(D, 'receiver')} < 2 THEN 999 ELSE stddev_pop(amount) {over(D, 'receiver')} / (avg(amount) {over(D, 'receiver')} + 1e-9) END, 4) AS inflow_cv FROM txn""")
def win_fan_in(spark, d):
    return L.fan_in(txn(spark, d)).select("tx_id", "in_unique_24h", r("inflow_cv").alias("inflow_cv"))


@query("win_degrees", f"""WITH {TXN_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY sender, receiver ORDER BY us, tx_id) = 1)::INT AS first FROM txn)
  SELECT tx_id, count(*) OVER w AS out_degree, (sum(first) OVER w)::BIGINT AS out_unique FROM f WINDOW w AS (PARTITION BY sender ORDER BY us RANGE UNBOUNDED PRECEDING)""")
def win_degrees(spark, d):
    return L.running_degrees(txn(spark, d)).select("tx_id", "out_degree", "out_unique")


@query("win_split", f"""WITH {TXN_SQL} SELECT tx_id, CASE WHEN us > (SELECT quantile_cont(us, 0.9) FROM txn) THEN 'stream' ELSE 'hist' END AS part FROM txn""")
def win_split(spark, d):
    from riskweave.operators.generator import split_by_time

    return split_by_time(txn(spark, d).withColumn("ring_id", F.lit(None).cast("string"))).select("tx_id", "part")


@query("win_timeline", f"WITH {TXN_SQL} SELECT tx_id, us, sender, receiver, amount FROM (SELECT * FROM txn WHERE sender IN (1, 2) OR receiver IN (1, 2) ORDER BY us, tx_id LIMIT 30)")
def win_timeline(spark, d):
    mine = F.col("sender").isin(1, 2) | F.col("receiver").isin(1, 2)
    return txn(spark, d).where(mine).orderBy("us", "tx_id").limit(30).select("tx_id", "us", "sender", "receiver", "amount")


@query("win_monotone", f"WITH {TXN_SQL} SELECT count(*) AS violations FROM (SELECT lag(us) OVER (PARTITION BY sender ORDER BY tx_id) > us AS bad FROM txn) WHERE bad")
def win_monotone(spark, d):
    bad = F.lag("us").over(W.partitionBy("sender").orderBy("tx_id")) > F.col("us")
    return txn(spark, d).select(bad.alias("bad")).where("bad").agg(F.count("*").alias("violations"))


@query("agg_profiles", f"""WITH {TXN_SQL} SELECT sender, count(*) AS n_tx, round(avg(amount), 2) AS mean_amount, round(coalesce(stddev_samp(amount), 0), 2) AS std_amount, round(quantile_cont(amount, 0.95), 2) AS p95_amount, count(DISTINCT receiver) AS beneficiaries FROM txn GROUP BY sender""")
def agg_profiles(spark, d):
    return B.profiles(txn(spark, d)).select("sender", "n_tx", r("mean_amount", 2).alias("mean_amount"), r("std_amount", 2).alias("std_amount"), r("p95_amount", 2).alias("p95_amount"), "beneficiaries")


@query("agg_standardise", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 4) AS z_c_acctbal FROM customer")
def agg_standardise(spark, d):
    return B.standardise(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r("z_c_acctbal").alias("z_c_acctbal"))


@query("agg_peers", f"""WITH {TXN_SQL}, s AS (SELECT sender, count(*) AS n, avg(amount) AS mean, list_sort(list(amount))[(count(*) // 2 + 1)::INT] AS upper_median, max(amount) AS most FROM txn GROUP BY sender)
  SELECT t.tx_id, s.n, round(s.mean, 2) AS mean, s.upper_median, s.most, round(t.amount / s.mean, 4) AS multiple, t.amount / s.mean >= 3 AS outlier FROM txn t JOIN s USING (sender)""")
def agg_peers(spark, d):
    t = txn(spark, d)
    ranked = t.select("sender", "amount", F.row_number().over(W.partitionBy("sender").orderBy("amount", "tx_id")).alias("i"), F.count("*").over(W.partitionBy("sender")).alias("n_rows"))
    stats = ranked.groupBy("sender").agg(F.count("*").alias("n"), F.avg("amount").alias("mean"), F.max(F.when(F.col("i") == F.floor(F.col("n_rows") / 2) + 1, F.col("amount"))).alias("upper_median"), F.max("amount").alias("most"))
    return t.join(stats, "sender").select("tx_id", "n", r("mean", 2).alias("mean"), "upper_median", "most", r(F.col("amount") / F.col("mean")).alias("multiple"), (F.col("amount") / F.col("mean") >= 3).alias("outlier"))


@query("jn_accounts", f"""WITH {TXN_SQL} SELECT t.tx_id, coalesce(a.c_name, t.sender::VARCHAR) AS sender_name, coalesce(b.c_name, t.receiver::VARCHAR) AS receiver_name, a.c_nationkey AS nation FROM txn t LEFT JOIN customer a ON a.c_custkey = t.sender * 2 LEFT JOIN customer b ON b.c_custkey = t.receiver * 2""")
def jn_accounts(spark, d):
    t, c = txn(spark, d), table(spark, d, "customer")
    a = c.select((F.col("c_custkey")).alias("a_key"), F.col("c_name").alias("a_name"), F.col("c_nationkey").alias("nation"))
    b = c.select((F.col("c_custkey")).alias("b_key"), F.col("c_name").alias("b_name"))
    out = t.join(a, F.col("sender") * 2 == F.col("a_key"), "left").join(b, F.col("receiver") * 2 == F.col("b_key"), "left")
    return out.select("tx_id", F.coalesce("a_name", F.col("sender").cast("string")).alias("sender_name"), F.coalesce("b_name", F.col("receiver").cast("string")).alias("receiver_name"), "nation")


@query("jn_profile_fallback", f"""WITH {TXN_SQL}, p AS (SELECT sender, avg(amount) AS m FROM txn WHERE sender % 3 <> 0 GROUP BY sender) SELECT tx_id, round(coalesce(m, (SELECT avg(m) FROM p)), 2) AS baseline FROM txn LEFT JOIN p USING (sender)""")
def jn_profile_fallback(spark, d):
    t = txn(spark, d)
    p = t.where(F.col("sender") % 3 != 0).groupBy("sender").agg(F.avg("amount").alias("m"))
    mean = p.agg(F.avg("m").alias("all"))
    return t.join(p, "sender", "left").join(F.broadcast(mean)).select("tx_id", r(F.coalesce("m", "all"), 2).alias("baseline"))  # mean is one row


ORDERS_SQL = """SELECT o_custkey AS sender, l_suppkey AS receiver, l_extendedprice * (1 - l_discount) AS amount, l_shipdate AS ts, c_nationkey AS from_nation, s_nationkey AS to_nation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


def orders_txn(spark, d):
    """lineitem as transfers from customers to suppliers."""
    l, o, c, s = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("o_custkey").alias("sender"), F.col("l_suppkey").alias("receiver"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.col("l_shipdate").alias("ts"), F.col("c_nationkey").alias("from_nation"), F.col("s_nationkey").alias("to_nation"))


@query("agg_corridors", f"SELECT from_nation, to_nation, count(*) AS n, round(sum(amount), 0) AS total, count(DISTINCT sender) AS senders FROM ({ORDERS_SQL}) GROUP BY ALL")
def agg_corridors(spark, d):
    return orders_txn(spark, d).groupBy("from_nation", "to_nation").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 0).alias("total"), F.countDistinct("sender").alias("senders"))


@query("agg_cube", f"SELECT from_nation, to_nation, count(*) AS n FROM ({ORDERS_SQL}) GROUP BY CUBE (from_nation, to_nation)")
def agg_cube(spark, d):
    return orders_txn(spark, d).cube("from_nation", "to_nation").agg(F.count("*").alias("n"))


@query("gr_condensed", f"WITH {TXN_SQL} SELECT sender AS u, receiver AS v, round(sum(amount), 2) AS weight, count(*) AS n FROM txn WHERE sender <> receiver GROUP BY ALL")
def gr_condensed(spark, d):
    return G.condensed(txn(spark, d)).select("u", "v", r("weight", 2).alias("weight"), "n")


@query("gr_index", f"WITH {TXN_SQL} SELECT account, row_number() OVER (ORDER BY account) - 1 AS node_index FROM (SELECT sender AS account FROM txn UNION SELECT receiver FROM txn)")
def gr_index(spark, d):
    return G.index(txn(spark, d))


_DEGREES = """d AS (SELECT account, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(DISTINCT f) AS in_unique, count(DISTINCT t) AS out_unique FROM (
  SELECT sender AS account, 0 AS i, 1 AS o, NULL AS f, CASE WHEN sender <> receiver THEN receiver END AS t FROM txn UNION ALL SELECT receiver, 1, 0, CASE WHEN sender <> receiver THEN sender END, NULL FROM txn) GROUP BY account)"""


@query("gr_degrees", f"WITH {TXN_SQL}, {_DEGREES} SELECT *, round(in_unique / (in_unique + out_unique + 1e-9::DOUBLE), 6) AS fan_in_ratio, round(CASE WHEN in_degree > 0 THEN 1 - in_unique / in_degree::DOUBLE ELSE 0 END, 6) AS fan_in_concentration, round(power(least(in_unique, out_unique), 2) / (power(greatest(in_unique, out_unique), 2) + 1e-9) * tanh((in_unique + out_unique) / 8.0::DOUBLE), 6) AS scatter_gather FROM d")
def gr_degrees(spark, d):
    i, o = F.col("in_unique"), F.col("out_unique")
    return G.degrees(txn(spark, d)).select("*", r(G.fan_ratio(i, o), 6).alias("fan_in_ratio"), r(G.fan_concentration(i, F.col("in_degree")), 6).alias("fan_in_concentration"), r(G.scatter_gather(i, o), 6).alias("scatter_gather"))


_EDGES = "e AS (SELECT DISTINCT sender AS u, receiver AS v FROM txn WHERE sender <> receiver)"


@query("gr_cycles", f"""WITH {TXN_SQL}, {_EDGES}, two AS (SELECT a.u AS account, count(*) AS two_cycles FROM e a JOIN e b ON a.u = b.v AND a.v = b.u GROUP BY a.u),
  three AS (SELECT a.u AS account, count(*) AS three_cycles FROM e a JOIN e b ON a.v = b.u JOIN e c ON b.v = c.u AND c.v = a.u WHERE a.u <> b.v GROUP BY a.u) SELECT account, coalesce(two_cycles, 0) AS two_cycles, coalesce(three_cycles, 0) AS three_cycles FROM two FULL JOIN three USING (account)""")
def gr_cycles(spark, d):
    e = G.adjacency(txn(spark, d))
    return G.two_cycles(e).join(G.three_cycles(e), "account", "full").na.fill(0)


@query("gr_clustering", f"""WITH {TXN_SQL}, {_EDGES}, p AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e), t AS (SELECT unnest([a.u, b.u, b.v]) AS account FROM p a JOIN p b ON a.v = b.u JOIN p c ON c.u = a.u AND c.v = b.v),
  n AS (SELECT account, count(*) AS t FROM t GROUP BY account), g AS (SELECT account, count(*) AS d FROM (SELECT unnest([u, v]) AS account FROM p) GROUP BY account)
  SELECT account, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1))::DOUBLE ELSE 0 END, 6) AS clustering FROM g LEFT JOIN n USING (account)""")
def gr_clustering(spark, d):
    return G.clustering(G.adjacency(txn(spark, d))).select("account", r("clustering", 6).alias("clustering"))


@query("gr_ego_volumes", f"""WITH {TXN_SQL}, late AS (SELECT * FROM txn WHERE us >= (SELECT max(us) FROM txn) - {7 * D}), s AS (SELECT account, sum(i) AS i, sum(o) AS o FROM (SELECT sender AS account, 0.0::DOUBLE AS i, amount AS o FROM late UNION ALL SELECT receiver, amount, 0 FROM late) GROUP BY account)
  SELECT account, round(i, 2) AS ego_in, round(o, 2) AS ego_out, round((o - i) / (o + i + 1e-9), 6) AS asymmetry FROM s""")
def gr_ego_volumes(spark, d):
    return G.ego_volumes(txn(spark, d)).select("account", r("ego_in", 2).alias("ego_in"), r("ego_out", 2).alias("ego_out"), r("asymmetry", 6).alias("asymmetry"))


def _pagerank_sql(rounds: int = 10) -> str:
    steps = ["r0 AS (SELECT account, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS p FROM nodes)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.account, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(f.flow, 0) + coalesce((SELECT sum(p) FROM r{i} WHERE account NOT IN (SELECT u FROM s)), 0) / (SELECT count(*) FROM nodes)) AS p
  FROM nodes n LEFT JOIN (SELECT s.v, sum(s.share * r.p) AS flow FROM s JOIN r{i} r ON s.u = r.account GROUP BY s.v) f ON f.v = n.account)""")
    return f"""WITH {TXN_SQL}, c AS (SELECT sender AS u, receiver AS v, sum(amount) AS w FROM txn WHERE sender <> receiver GROUP BY ALL), s AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS share FROM c), nodes AS (SELECT u AS account FROM c UNION SELECT v FROM c),
  {', '.join(steps)} SELECT account, round(p, 8) AS pagerank FROM r{rounds}"""


@query("gr_pagerank", _pagerank_sql())
def gr_pagerank(spark, d):
    return G.pagerank(G.condensed(txn(spark, d))).select("account", r("pagerank", 8).alias("pagerank"))


def _labels_sql(rounds: int = 5) -> str:
    steps = ["l0 AS (SELECT DISTINCT u AS account, u AS community FROM b)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT u AS account, community FROM (SELECT b.u, l.community, count(*) AS n FROM b JOIN l{i} l ON b.v = l.account GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, community) = 1)")
    return f"p AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM e), b AS (SELECT u, v FROM p UNION SELECT v, u FROM p UNION SELECT u, u FROM p UNION SELECT v, v FROM p), {', '.join(steps)}"


@query("gr_communities", f"WITH {TXN_SQL}, {_EDGES}, {_labels_sql()} SELECT account, community FROM l5")
def gr_communities(spark, d):
    return G.label_propagation(G.adjacency(txn(spark, d)))


def _densest_sql(rounds: int = 12) -> str:
    """CTEs part (community, account, density) and i (transfers inside of communities)."""
    steps = ["i AS (SELECT a.community, sender AS u, receiver AS v, amount FROM txn JOIN l5 a ON sender = a.account JOIN l5 b ON receiver = b.account AND a.community = b.community WHERE sender <> receiver)", "t0 AS (SELECT community, u, v, count(*) AS n FROM i GROUP BY ALL)"]
    for k in range(rounds):
        steps += [
            f"d{k} AS MATERIALIZED (SELECT community, account, sum(n) AS d FROM (SELECT community, u AS account, n FROM t{k} UNION ALL SELECT community, v, n FROM t{k}) GROUP BY ALL)",
            f"s{k} AS (SELECT community, count(*) AS accounts, sum(d) / 2.0::DOUBLE AS transfers, {k} AS turn FROM d{k} GROUP BY community)",
            f"o{k} AS MATERIALIZED (SELECT community, account FROM d{k} JOIN s{k} USING (community) WHERE d <= 2.2::DOUBLE * transfers / accounts)",
            f"t{k + 1} AS MATERIALIZED (SELECT * FROM t{k} WHERE (community, u) NOT IN (SELECT community, account FROM o{k}) AND (community, v) NOT IN (SELECT community, account FROM o{k}))",
        ]
    sizes = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(rounds))
    alive = " UNION ALL ".join(f"SELECT community, account, {k} AS turn FROM d{k}" for k in range(rounds))
    return ", ".join(steps) + f""", sizes AS ({sizes}), best AS (SELECT community, min((-(transfers / (accounts * (accounts - 1))), turn)) AS b FROM sizes GROUP BY community), alive AS ({alive}),
  part AS (SELECT alive.community, account, -b[1] AS density FROM alive JOIN best ON best.community = alive.community AND turn = b[2])"""


_COUNTS = [f"sum(({DIGIT} = {x})::INT)" for x in range(1, 10)]


@query("gr_profiles", f"""WITH {TXN_SQL}, {_EDGES}, {_labels_sql()}, {_densest_sql()}, z AS (SELECT community, count(*) AS n FROM l5 GROUP BY community HAVING count(*) > 1),
  f AS (SELECT community, count(*) AS edges, sum(amount) AS flow, {chi2_sql(_COUNTS)} AS chi2 FROM i GROUP BY community), q AS (SELECT DISTINCT community, u, v FROM i),
  g AS (SELECT community, account, sum(i) AS i, sum(o) AS o FROM (SELECT community, u AS account, 0 AS i, 1 AS o FROM q UNION ALL SELECT community, v, 1, 0 FROM q) GROUP BY ALL),
  de AS (SELECT account, count(DISTINCT src) AS i, count(DISTINCT dst) AS o FROM (SELECT u AS account, v AS dst, NULL AS src FROM e UNION ALL SELECT v, NULL, u FROM e) GROUP BY account),
  cy AS (SELECT a.u AS account FROM e a JOIN e b ON a.u = b.v AND a.v = b.u UNION SELECT a.u FROM e a JOIN e b ON a.v = b.u JOIN e c ON b.v = c.u AND c.v = a.u),
  dn AS (SELECT community, {chi2_sql(_COUNTS)} AS dense FROM i JOIN part p USING (community) JOIN part q USING (community) WHERE p.account = u AND q.account = v GROUP BY community),
  h AS (SELECT community, avg(coalesce(de.i / (de.i + de.o + 1e-9::DOUBLE), 0)) AS fi, avg(coalesce(de.o / (de.i + de.o + 1e-9::DOUBLE), 0)) AS fo, avg((coalesce(g.i, 0) <= 1 AND coalesce(g.o, 0) <= 1)::INT) AS ch, bool_or(cy.account IS NOT NULL) AS cyc
    FROM l5 LEFT JOIN (SELECT account, i, o FROM g) g USING (account) LEFT JOIN de USING (account) LEFT JOIN cy USING (account) GROUP BY community),
  m AS (SELECT z.community, z.n, coalesce(edges, 0) / (n * (n - 1))::DOUBLE AS density, coalesce(flow, 0) AS flow, coalesce(fi, 0) AS fi, coalesce(fo, 0) AS fo, coalesce(ch, 0) AS ch, cyc, coalesce(chi2, 0) > 3.84 OR (n > 2 AND coalesce(dense, 0) > 3.84) AS ben FROM z LEFT JOIN f USING (community) LEFT JOIN dn USING (community) LEFT JOIN h USING (community))
  SELECT community, n AS community_size, round(density, 6) AS community_density, round(flow, 2) AS total_flow_value, cyc AS has_cycle, ben AS benford_anomaly, CASE WHEN cyc THEN 'circular' WHEN fi > 0.7 THEN 'fan_in' WHEN fo > 0.7 THEN 'fan_out' WHEN ch > 0.5 THEN 'layering_chain' ELSE 'mixed' END AS dominant_pattern,
  round(greatest(0, least(100, 100 * (0.25 * least(1, density) + 0.30 * cyc::INT + 0.25 * ben::INT + 0.20 * ln(n + 1) / ln(max(n) OVER () + 1)))), 4) AS community_risk_score FROM m""")
def gr_profiles(spark, d):
    t = txn(spark, d)
    out = G.community_profiles(t, G.cut(G.label_propagation(G.adjacency(t))))
    return out.select("community", "community_size", r("community_density", 6).alias("community_density"), r("total_flow_value", 2).alias("total_flow_value"), "has_cycle", "benford_anomaly", "dominant_pattern", r("community_risk_score").alias("community_risk_score"))


@query("gr_components", f"""WITH RECURSIVE {TXN_SQL}, {_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), w(node, seen) AS (SELECT u, v FROM b UNION SELECT w.node, b.v FROM w JOIN b ON w.seen = b.u) SELECT node AS account, least(node, min(seen)) AS component FROM w GROUP BY node""")
def gr_components(spark, d):
    return G.weak_components(G.adjacency(txn(spark, d)))


#: Prefixes are left out behind those that give 20 paths for sure: an account's edges out less the accounts on the way.
@query("gr_paths", f"""WITH {TXN_SQL}, {_EDGES}, fan AS (SELECT u, count(*) AS n FROM e GROUP BY u), p AS (SELECT u AS start, [u, v] AS path FROM e),
  q AS (SELECT start, list_append(path, v) AS path FROM p JOIN e ON path[-1] = e.u WHERE NOT list_contains(path, e.v)),
  k AS (SELECT start, path FROM q JOIN fan ON fan.u = path[-1] QUALIFY coalesce(sum(greatest(0, n - 2)) OVER (PARTITION BY start ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20),
  x AS (SELECT start, list_append(path, v) AS path FROM k JOIN e ON path[-1] = e.u WHERE NOT list_contains(path, e.v) QUALIFY row_number() OVER (PARTITION BY start ORDER BY list_append(path, v)) <= 20),
  s AS (SELECT sender AS u, receiver AS v, max(amount) AS amount FROM txn GROUP BY ALL), j AS (SELECT path, unnest(range(1, len(path))) AS i FROM x)
  SELECT path, round(sum(amount), 2) AS total_value FROM j JOIN s ON s.u = path[i] AND s.v = path[i + 1] GROUP BY path""")
def gr_paths(spark, d):
    t = txn(spark, d)
    return G.path_values(G.paths(G.adjacency(t), length=3, cap=20), t).select("path", r("total_value", 2).alias("total_value"))


@query("gr_neighbourhood", f"""WITH {TXN_SQL}, {_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), h0 AS (SELECT 1 AS account, 0 AS hop), h1 AS (SELECT DISTINCT v AS account, 1 AS hop FROM b WHERE u = 1 AND v <> 1),
  h2 AS (SELECT DISTINCT b.v AS account, 2 AS hop FROM b JOIN h1 ON b.u = h1.account WHERE b.v <> 1 AND b.v NOT IN (SELECT account FROM h1)) SELECT account::BIGINT AS account, hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 ORDER BY hop, account LIMIT 80)""")
def gr_neighbourhood(spark, d):
    return G.neighbourhood(G.adjacency(txn(spark, d)), 1, hops=2)


@query("gr_features")
def gr_features(spark, d):
    return G.graph_features(txn(spark, d))


@query("live_cycles", f"""WITH {TXN_SQL}, f AS (SELECT sender AS u, receiver AS v, min(us) AS x FROM txn GROUP BY ALL), two AS (SELECT a.u, b.v, min(greatest(a.x, b.x)) AS x FROM f a JOIN f b ON a.v = b.u GROUP BY ALL), k AS (SELECT DISTINCT receiver AS r, sender AS s FROM txn),
  three AS (SELECT k.r AS u, k.s AS v, min(greatest(f.x, two.x)) AS x FROM k JOIN f ON f.u = k.r JOIN two ON two.u = f.v AND two.v = k.s GROUP BY ALL)
  SELECT tx_id, coalesce(CASE WHEN a.x < us THEN 2 WHEN b.x < us THEN 3 WHEN c.x < us THEN 4 END, 0)::INT AS cycle_length, coalesce(CASE WHEN a.x < us THEN 2 WHEN b.x < us THEN 3 WHEN c.x < us THEN 4 END, 0) > 0 AS edge_creates_cycle
  FROM txn LEFT JOIN f a ON a.u = receiver AND a.v = sender LEFT JOIN two b ON b.u = receiver AND b.v = sender LEFT JOIN three c ON c.u = receiver AND c.v = sender""")
def live_cycles(spark, d):
    return L.closed_cycles(txn(spark, d))


@query("feature_matrix")
def feature_matrix(spark, d):
    return B.features(txn(spark, d)).select("tx_id", "sender", *B.FEATURES)


assert math.isclose(sum(S.BENFORD), 1.0)
