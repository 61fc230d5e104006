"""Rules, scalars, fusion, evaluation, sources, generator and streams on small fixtures."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.operators import alerts as A
from riskweave.operators import behaviour as B
from riskweave.operators import evaluation as E
from riskweave.operators import fusion as U
from riskweave.operators import generator as N
from riskweave.operators import graph as G
from riskweave.operators import live_graph as L
from riskweave.operators import models as M
from riskweave.operators import rules as R
from riskweave.sources import tables as T
from riskweave.streaming import stream as X

QUIET = dict(
    amount=1000.0, sub_threshold_flag=False, tx_velocity_1h=1, tx_velocity_24h=1, tx_gap_seconds=10.0, impossible_travel_flag=False, geo_distance_km=0.0, high_risk_country_flag=False, international=False, new_device_flag=False, shared_device_count=0, beneficiary_count_7d=1,
    edge_creates_cycle=False, cycle_length=0, round_amount_flag=False, kyc=2, benford_chi2_score=0.0, in_unique_24h=1, inflow_cv=999.0, last_inflow_amount=0.0, last_inflow_gap=float("inf"), relay=False,
)
CASES = [
    ("R01", dict(amount=1_000_001.0), dict(amount=1_000_000.0)), ("R02", dict(sub_threshold_flag=True, tx_velocity_1h=3), dict(sub_threshold_flag=True, tx_velocity_1h=2)), ("R03", dict(tx_velocity_1h=11), dict(tx_velocity_1h=10)),
    ("R03", dict(tx_velocity_24h=51), dict(tx_velocity_24h=50)), ("R04", dict(tx_gap_seconds=15_552_001.0, amount=100_001.0), dict(tx_gap_seconds=15_552_000.0, amount=100_001.0)), ("R05", dict(impossible_travel_flag=True), {}),
    ("R06", dict(high_risk_country_flag=True, international=True), dict(high_risk_country_flag=True)), ("R07", dict(new_device_flag=True, amount=200_001.0), dict(new_device_flag=True, amount=200_000.0)), ("R08", dict(shared_device_count=6), dict(shared_device_count=5)),
    ("R09", dict(beneficiary_count_7d=21), dict(beneficiary_count_7d=20)), ("R10", dict(edge_creates_cycle=True, cycle_length=2), {}), ("R11", dict(round_amount_flag=True, tx_velocity_24h=6), dict(round_amount_flag=True, tx_velocity_24h=5)),
    ("R12", dict(kyc=0, amount=500_001.0), dict(kyc=None, amount=500_001.0)), ("R13", dict(benford_chi2_score=3.85), dict(benford_chi2_score=3.84)), ("R14", dict(in_unique_24h=5, inflow_cv=0.34), dict(in_unique_24h=5, inflow_cv=0.35)),
    ("R15", dict(last_inflow_amount=1100.0, relay=True, last_inflow_gap=7199.0), dict(last_inflow_amount=1100.0, relay=True, last_inflow_gap=7200.0)),
]
KINDS = {bool: "boolean", int: "int", float: "double"}


def frame(spark, rows):
    schema = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in QUIET.items()) + ", n int"
    return spark.createDataFrame([tuple((QUIET | r).values()) + (i,) for i, r in enumerate(rows)], schema)


def test_rules_at_their_thresholds(spark):
    rows = [x for _, on, off in CASES for x in (on, off)]
    got = {r.n: r for r in R.evaluate(frame(spark, rows)).collect()}
    for i, (rule, _, _) in enumerate(CASES):
        assert rule in got[2 * i].triggered_rules, rule
        assert rule not in got[2 * i + 1].triggered_rules, rule
        assert len(got[2 * i].rule_texts) == len(got[2 * i].triggered_rules)


@pytest.mark.parametrize("row, score", [(dict(amount=2e6), 70), (dict(high_risk_country_flag=True, international=True), 58), ({}, 0), (dict(amount=2e6, edge_creates_cycle=True), 80)])
def test_rule_score(spark, row, score):
    assert R.evaluate(frame(spark, [row])).first().rule_score == pytest.approx(score)


def test_rule_of_missing_columns_does_not_fire(spark):
    out = R.evaluate(spark.createDataFrame([(2e6,)], "amount double")).first()
    assert out.triggered_rules == ["R01"]


def test_fusion(spark):
    df = spark.createDataFrame([(10.0, 20.0, 80.0, 40.0, 50.0), (0.0, 0.0, 0.0, 0.0, None)], "rule_score double, graph_score double, supervised_score double, anomaly_score double, tgn_score double")
    out = U.fuse(df).collect()
    assert out[0].transaction_risk_score == pytest.approx(35.0) and out[1].transaction_risk_score == 0
    group = spark.createDataFrame([(200.0, 1.0, True, 50.0)], "supervised_score double, community_density double, has_cycle boolean, community_risk double")
    got = U.fuse(group).first()
    assert got.group_risk_score == pytest.approx(75.0) and got.risk_level_group == "High" and got.leading_layer == "supervised_score"
    with pytest.raises(ValueError):
        U.check_weights({**U.WEIGHTS, "rule_score": 0.5})
    with pytest.raises(ValueError):
        U.check_weights({"rule_score": 1.0})


def test_levels_and_scalars(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (30.5,), (60.0,), (60.5,), (80.0,), (80.5,), (100.0,)], "x double")
    assert [r[0] for r in df.select(S.risk_level(F.col("x"))).collect()] == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]
    lists = spark.createDataFrame([('["a","b"]',), ("['a', 'b']",), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in lists.select(S.parse_list(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], ["a"], [], []]
    km = spark.range(1).select(S.haversine_km(F.lit(28.6), F.lit(77.2), F.lit(25.2), F.lit(55.3))).first()[0]
    assert 2150 < km < 2250
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in vectors.select(S.embedding_drift(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1.0]
    digits = spark.createDataFrame([(1000.0,), (0.5,), (987654.3,), (-3.0,)], "x double")
    assert [tuple(r) for r in digits.select(S.leading_digit(F.col("x")), S.clipped_digit(F.col("x"))).collect()] == [(1, 1), (0, 1), (9, 9), (3, 1)]


BASE = dt.datetime(2026, 5, 1, 12)
# Ten rows: truth, ring, typology, alerted, score, patterns.
TABLE = [
    (1, "A", "structuring", True, 75, ["L1:R02", "L1:R11", "L3:amount_raw"]), (1, "A", "structuring", True, 75, ["L1:R02", "L3:amount_raw"]), (1, "B", "layering_chain", True, 75, ["L1:R15", "L1:R06", "L3:channel_Web"]), (1, "B", "layering_chain", False, None, None),
    (1, "C", "fan_in", True, 75, ["L1:R14", "L2:community_has_cycle", "L4:fan_in_score"]), (1, "D", "round_tripping", False, None, None), (0, None, None, True, 75, ["L1:R03"]), (0, None, None, True, 65, ["L1:R10"]), (0, None, None, False, None, None), (0, None, None, False, None, None),
]


def joined(spark):
    ts = [BASE + dt.timedelta(minutes=i) for i in range(10)]
    stream = spark.createDataFrame([(f"tx{i:02d}", ts[i]) for i in range(10)], "tx_id string, ts timestamp")
    rows = [(f"tx{i:02d}", f"al{i}", "Open", float(t[4]), 85.0, ts[i] + dt.timedelta(milliseconds=200), t[5], i % 3) for i, t in enumerate(TABLE) if t[3]]
    rows.append(("tx00", "al-old", "Dismissed", 1.0, 1.0, ts[0], [], 9))  # an older alert of the same transaction
    alerts = spark.createDataFrame(rows, "tx_id string, alert_id string, status string, transaction_risk_score double, group_risk_score double, created_at timestamp, patterns array<string>, community int")
    truth = spark.createDataFrame([(f"tx{i:02d}", "Suspicious" if t[0] else "Normal", t[1], t[1], t[2]) for i, t in enumerate(TABLE)], "tx_id string, suspicious_flag string, fraud_ring_id string, cluster string, typology string")
    return E.join_evaluation(stream, alerts, truth)


def test_evaluation_truth_table(spark):
    j = joined(spark).persist()
    assert j.count() == 10
    c = E.confusion(j).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (4, 2, 2, 2)
    assert c.precision == pytest.approx(2 / 3) and c.f1_macro == pytest.approx(0.5833, abs=1e-4) and c.fpr == 0.5 and c.fnr == pytest.approx(1 / 3)
    a = E.areas(j).first()
    assert a.average_precision == pytest.approx(0.7333, abs=1e-4) and a.roc_auc == pytest.approx(0.6667, abs=1e-4)
    r = E.rings(j).first()
    assert (r.rings, r.detected, r.partial, r.rate, r.mean_coverage) == (4, 3, 3, 0.75, 0.625)
    assert E.group_precision(j).first()[0] == pytest.approx(2 / 3)
    rules = {x.rule: (x.fired, x.hits) for x in E.rule_precision(j).collect()}
    assert rules["R02"] == (2, 2) and rules["R03"] == (1, 0) and rules["R15"] == (1, 1) and rules["R01"] == (0, 0) and len(rules) == 15
    kinds = {x.typology: x.rate for x in E.typology_rates(j).collect()}
    assert kinds["structuring"] == 1 and kinds["layering_chain"] == 0.5 and kinds["round_tripping"] == 0 and len(kinds) == 10
    assert E.latency(j).first().mean_ms == pytest.approx(200)
    one = j.where("y_true = 1")
    assert tuple(E.areas(one).first()) == (0.0, 0.0)
    assert E.report(j, {"f1": 0.7}).first().delta_f1 == pytest.approx(2 / 3 - 0.7)


def test_alert_store(spark):
    df = spark.createDataFrame([(1, BASE, "High", "Low"), (2, BASE + dt.timedelta(1), "Low", "Critical"), (3, BASE, "Low", "Medium")], "tx_id int, ts timestamp, risk_level string, risk_level_group string")
    found = A.trigger(df)
    assert sorted(r.tx_id for r in found.collect()) == [1, 2]
    changes = spark.createDataFrame([], "alert_id string, status string, changed_at timestamp")
    first = found.where("tx_id = 1").first().alert_id
    changes = A.set_status(A.set_status(changes, first, "Investigating", "2026-05-02"), first, "Dismissed", "2026-05-03")
    assert {r.tx_id: r.status for r in A.with_status(found, changes).collect()} == {1: "Dismissed", 2: "Open"}
    assert [r.tx_id for r in A.list_alerts(found).collect()] == [2, 1]
    with pytest.raises(ValueError):
        A.set_status(changes, first, "Closed", "2026-05-03")


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("t1", "a", "b", "12.5", "2026-01-01 10:00:00", "yes"), (None, "a", "b", "1", "2026-01-01", None), ("t3", "", "b", "x", "never", "no")], "transaction_id string, sender_account string, receiver_account string, amount string, timestamp string, is_international string")
    raw = raw.withColumns({"currency": F.lit(None).cast("string"), "payment_channel": F.lit(None).cast("string")})
    good, bad = T.parse_upload(raw)
    assert good.count() == 2 and good.where("transaction_id = 't1'").first().is_international
    assert len(bad.first().errors) == 3
    store = T.ArtifactStore(spark, str(tmp_path))
    store.save("x", spark.range(3))
    assert store.load("x").count() == 3 and store.names() == ["x"] and store.delete("x") and not store.exists("x")
    with pytest.raises(T.ArtifactNotFound):
        store.load("x")
    with pytest.raises(ValueError):
        store.save("../x", spark.range(1))
    assert T.read_or_empty(spark, str(tmp_path / "none"), T.TRANSACTION).count() == 0


def brute_cycles(rows):
    edges, out = [], {}
    for tx, us, s, r in sorted(rows, key=lambda x: (x[1], x[0])):
        length, front, seen = 0, {r}, {r}
        for depth in range(1, 4):
            ahead = {v for u, v in edges if u in front}
            if s in ahead:
                length = depth + 1
                break
            front = ahead - seen
            seen |= front
        out[tx] = length
        edges.append((s, r))
    return out


def test_live_cycles_against_replay(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i * 1000, rng.randrange(12), rng.randrange(12)) for i in range(60)]
    df = spark.createDataFrame(rows, "tx_id long, us long, sender long, receiver long")
    assert {r.tx_id: r.cycle_length for r in L.closed_cycles(df).collect()} == brute_cycles(rows)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)], "u long, v long")
    assert {r.account: r.three_cycles for r in G.three_cycles(edges).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.account: r.clustering for r in G.clustering(edges).collect()} == {1: 1.0, 2: 1.0, 3: pytest.approx(1 / 3), 4: 0.0, 7: 0.0, 8: 0.0}
    ranks = G.pagerank(edges.withColumn("weight", F.lit(1.0)), rounds=12)
    assert ranks.agg(F.sum("pagerank")).first()[0] == pytest.approx(1.0)
    assert {r.account: r.component for r in G.weak_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    assert {tuple(r.path) for r in G.paths(edges, length=2).collect()} == {(1, 2, 3), (2, 3, 1), (2, 3, 4), (3, 1, 2)}
    line = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert {r.account: r.betweenness for r in G.betweenness(line).collect()} == {1: 0.0, 2: pytest.approx(0.5), 3: 0.0}
    dense = G.densest(edges.withColumn("community", F.lit(1).cast("long"))).collect()
    assert sorted((r.account, r.density) for r in dense) == [(1, 0.5), (2, 0.5), (3, 0.5)]
    twice = edges.union(edges.where("u = 7")).union(edges.where("u = 7")).withColumn("community", F.lit(1).cast("long"))
    assert sorted((r.account, r.density) for r in G.densest(twice).collect()) == [(7, 1.5), (8, 1.5)]  # three transfers between two accounts


def test_paths_behind_dead_ends(spark):
    # Account 1 has 30 two-step prefixes into dead ends ahead of the only ones that go on.
    rows = [(1, 2)] + [(2, 100 + i) for i in range(30)] + [(2, 500)] + [(500, 600 + i) for i in range(25)] + [(500, 1), (600, 2)]
    near: dict[int, list[int]] = {}
    for u, v in rows:
        near.setdefault(u, []).append(v)
    every = [(a, b, c, e) for a in near for b in near[a] for c in near.get(b, []) for e in near.get(c, []) if len({a, b, c, e}) == 4]
    for cap in (1, 3, 20, 1000):
        expected = {p for a in near for p in sorted(p for p in every if p[0] == a)[:cap]}
        assert {tuple(r.path) for r in G.paths(spark.createDataFrame(rows, "u long, v long"), cap=cap).collect()} == expected
    assert len([p for p in every if p[0] == 1]) == 25


def test_few_prefixes_of_paths_are_followed(spark):
    """Among 30 accounts that all lead to all, one or two prefixes give the first paths of each; with dead ends, hubs and ways back, paths are those of brute force."""
    full = spark.createDataFrame([(a, b) for a in range(30) for b in range(30) if a != b], "u long, v long")
    assert G.prefixes(full, length=3, cap=20).count() == 30
    assert G.prefixes(full, length=4, cap=20).count() == 30
    rng = random.Random(5)
    rows = {(a, b) for a in range(14) for b in rng.sample(range(14), 3) if a != b} | {(0, b) for b in range(1, 40)} | {(b, 0) for b in range(20, 40)} | {(b, b + 20) for b in range(20, 30)}
    near: dict[int, list[int]] = {}
    for u, v in sorted(rows):
        near.setdefault(u, []).append(v)
    edges = spark.createDataFrame(sorted(rows), "u long, v long")
    for length in (1, 3, 4):
        every = [(a,) for a in near]
        for _ in range(length):
            every = [(*p, b) for p in every for b in near.get(p[-1], []) if b not in p]
        for cap in (1, 4, 30):
            want = {p for a in near for p in sorted(p for p in every if p[0] == a)[:cap]}
            assert {tuple(r.path) for r in G.paths(edges, length=length, cap=cap).collect()} == want


def test_rule_queries_carry_what_rules_look_at(spark, tmp_path):
    """No receiver entropy and no columns of the source that no rule looks at are shuffled with a transfer."""
    from riskweave.plans.queries_risk import scored_features

    row = (1, dt.datetime(2024, 1, 1, 5, 6, 7, 89), 1, "click", 3.5, '{"k": 3}')
    spark.createDataFrame([row, (2, row[1], 0, *row[3:])], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = scored_features(spark, str(tmp_path))
    assert not set(got.columns) & {"receiver_entropy", "channel", "k", "ip", "country", "receiver_country", "lat", "lon", "device", "tx_velocity_6h", "tx_velocity_7d"}
    assert {r.tx_id: r.ts for r in got.select("tx_id", "ts").collect()} == {r.tx_id: r.ts for r in T.txn(spark, str(tmp_path)).select("tx_id", "ts").collect()}


def test_queries_over_all_transfers(spark):
    from riskweave.plans.registry import QUERIES
    from riskweave.sources.tables import txn

    where = "/root/testdata/sf0.001"
    rows = [(r.tx_id, r.sender, r.receiver, r.amount) for r in txn(spark, where).collect()]
    near: dict[int, set[int]] = {}
    out: dict[int, set[int]] = {}
    for _, u, v, _ in rows:
        if u != v:
            out.setdefault(u, set()).add(v)
            near.setdefault(u, {u}).add(v)
            near.setdefault(v, {v}).add(u)
    label = {a: a for a in near}
    for _ in range(5):
        votes = {a: Counter(label[b] for b in near[a]) for a in near}
        label = {a: min(c, key=lambda x: (-c[x], x)) for a, c in votes.items()}
    assert {r.account: r.community for r in QUERIES["gr_communities"](spark, where).collect()} == label
    joined = {r.tx_id: (r.sender_community, r.receiver_community) for r in QUERIES["jn_communities"](spark, where).collect()}
    assert joined == {i: (label.get(u, -1), label.get(v, -1)) for i, u, v, _ in rows}
    inner = [(label[u], u, v, x) for _, u, v, x in rows if u != v and label[u] == label[v]]
    flows = {r.community: r.transfers for r in QUERIES["gr_induced"](spark, where).collect()}
    assert flows == Counter(c for c, *_ in inner)
    sizes = Counter(label.values())
    assert {r.community: r.community_size for r in QUERIES["gr_profiles"](spark, where).collect()} == {c: n for c, n in sizes.items() if n > 1}
    assert {r.community for r in QUERIES["gr_densest"](spark, where).collect()} == {c for c, *_ in inner}
    assert {r.account for r in QUERIES["gr_betweenness"](spark, where).collect()} == set(near)
    component: dict[int, int] = {}
    for a in sorted(near):
        todo = [] if a in component else [a]
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = a
                todo += near[x]
    assert {r.account: r.component for r in QUERIES["gr_components"](spark, where).collect()} == component
    first = {p for a in out for p in sorted((a, b, c, e) for b in out[a] for c in out.get(b, ()) for e in out.get(c, ()) if len({a, b, c, e}) == 4)[:20]}
    assert {tuple(r.path) for r in QUERIES["gr_paths"](spark, where).collect()} == first
    one = near.get(1, {1}) - {1}
    two = {b for a in one for b in near[a]} - one - {1}
    assert [(r.account, r.hop) for r in QUERIES["gr_neighbourhood"](spark, where).orderBy("hop", "account").collect()] == [(1, 0), *[(a, 1) for a in sorted(one)], *[(a, 2) for a in sorted(two)]][:80]


def test_generator(spark):
    cfg = N.Config(accounts=200, transactions=300, rings=10, days=30)
    made = N.generate(spark, cfg).persist()
    assert made.count() == made.select("tx_id").distinct().count() == made.select("ts").distinct().count()
    again = N.generate(spark, cfg)
    assert made.exceptAll(again).count() == 0
    assert {r.typology for r in made.where("typology is not null").select("typology").distinct().collect()} == set(N.CATALOGUE)
    money = made.where("typology = 'structuring'").agg(F.min("amount"), F.max("amount")).first()
    assert 850_000 <= money[0] <= money[1] <= 999_000
    parts = N.split_by_time(made).groupBy("ring_id").agg(F.countDistinct("part").alias("n")).where("ring_id is not null and n > 1")
    assert parts.count() == 0
    replay = N.replay_balances(made, opening=1e12)
    assert replay.where("not accepted").count() == 0
    both = replay.join(N.running_balances(made, opening=1e12).withColumnRenamed("balance_after", "running"), "tx_id").join(made.where("sender >= 0").select("tx_id"), "tx_id")
    assert both.where(F.abs(F.col("balance_after") - F.col("running")) > 0.5).count() == 0
    assert N.clamp_parameters("fan_in", 100, 1.0) == (15, 100_000)
    with pytest.raises(ValueError):
        N.plan("none", "r", [1, 2], size=1, amount=1, start=0, seed=1)


def test_models(spark):
    rows = [(i, math.sin(i), float(i % 5), int(i % 5 == 0)) for i in range(300)] + [(999, 40.0, 90.0, 1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    scores = {r.id: r.isolation for r in M.isolation_scores(df, ["a", "b"], "id", trees=50).collect()}
    assert max(scores, key=scores.get) == 999
    outlier = {r.id: r.outlier for r in M.local_outlier_scores(df, ["a", "b"], "id", k=10).collect()}
    assert outlier[999] > 2
    parts = M.hash_split(df, "id", "label").groupBy("part").count().collect()
    assert len(parts) == 3
    data = M.hash_split(df, "id", "label")
    out = M.SupervisedScorer(["a", "b"], rounds=3, trees=5).fit(data.where("part = 0"), data.where("part = 1")).score(df)
    means = {r.label: r.m for r in out.groupBy("label").agg(F.avg("supervised_score").alias("m")).collect()}
    assert means[1] > means[0] and out.where("agreement < 0 or agreement > 1").count() == 0


def test_stream_sinks(spark, tmp_path):
    rows = [(i, BASE + dt.timedelta(minutes=i), i % 3, "click", float(i), "{}") for i in range(100)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = X.event_stream(spark, str(tmp_path / "in"))
    X.run_available(X.enrich(stream, spark.createDataFrame([(1, "x")], "user_id long, name string")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    q = X.alert_sink(X.event_stream(spark, str(tmp_path / "in")).where("value > 50"), str(tmp_path / "alerts"), str(tmp_path / "ck2"), key="event_id")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 49


def test_windows_by_entering_and_leaving(spark):
    """Distinct counts and entropies of trailing frames against lists of them, with ties, nulls and frames that end on a row."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 60), rng.randrange(3), rng.choice((1, 2, 3, 4, None)), 5.0) for i in range(300)]
    df = spark.createDataFrame(rows, "tx_id long, us long, sender long, receiver long, amount double")
    got = B.frame_sums(df, "sender", "receiver", 7, {"n": B.distinct_count, "nlogn": B.n_log_n}).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = Counter(v for _, t, s, v, _ in rows if s == r.sender and r.us - 7 <= t <= r.us and v is not None)
        assert r.n == len(seen) and r.nlogn == pytest.approx(sum(c * math.log2(c) for c in seen.values()), abs=1e-9)
    assert B.count_distinct(df.where("false"), "sender", "receiver", 7, "n").count() == 0


def test_triangles_of_a_hub(spark):
    """Each triangle once, whichever way its edges go; a hub with the least id makes no pairs of its partners."""
    rng = random.Random(5)
    edges = {(0, i) for i in range(1, 40)} | {(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(120)} | {(i, 0) for i in range(1, 40, 3)}
    edges = {(u, v) for u, v in edges if u != v}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    pairs = {frozenset(e) for e in edges}
    want = {t for t in itertools.combinations(range(40), 3) if all(frozenset(p) in pairs for p in itertools.combinations(t, 2))}
    met = [tuple(sorted((r.a, r.b, r.c))) for r in G.triangles(df).collect()]
    assert len(met) == len(set(met)) and set(met) == want
    cycles = {}
    for a, b, c in itertools.permutations(range(40), 3):
        if (a, b) in edges and (b, c) in edges and (c, a) in edges:
            cycles[a] = cycles.get(a, 0) + 1
    assert {r.account: r.three_cycles for r in G.three_cycles(df).collect()} == cycles


def test_community_patterns(spark):
    """A ring of three is circular, a plain chain is a chain, members without inner edges count."""
    rows = [(1, 2), (2, 3), (3, 1), (11, 12), (12, 13), (21, 22), (23, 22), (24, 22), (25, 22), (26, 22)]
    txn = spark.createDataFrame([(i, i, u, v, 1000.0) for i, (u, v) in enumerate(rows)], "tx_id long, us long, sender long, receiver long, amount double")
    members = spark.createDataFrame([(a, a // 10) for a in (1, 2, 3, 11, 12, 13, 14, 21, 22, 23, 24, 25, 26)], "account long, community long")
    got = {r.community: r for r in G.community_profiles(txn, members).collect()}
    assert got[0].has_cycle and got[0].dominant_pattern == "circular"
    assert not got[1].has_cycle and got[1].dominant_pattern == "layering_chain" and got[1].chain_share == 1.0 and got[1].community_size == 4
    assert got[2].dominant_pattern == "fan_out" and got[2].mean_fan_out == pytest.approx(5 / 6)


def test_paths_behind_dead_ends(spark):
    """A start whose first prefixes all end keeps the path behind them."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 62)] + [(61, 100), (100, 101)], "u long, v long")
    assert [r.path for r in G.paths(edges, length=3, cap=5).where("start = 0").collect()] == [[0, 61, 100, 101]]


def test_times_are_unique(spark):
    """Rows of one microsecond don't run into those of the next ones."""
    rows = [(f"t{i}", 1_000_000 + (0 if i < 5 else i - 4)) for i in range(12)] + [("late", 5_000_000)]
    df = spark.createDataFrame(rows, "tx_id string, us long").select("tx_id", F.timestamp_micros("us").alias("ts"))
    got = [r.us for r in N.unique_times(df).select(F.unix_micros("ts").alias("us")).collect()]
    assert len(set(got)) == len(rows) and max(got) == 5_000_000 and min(got) == 1_000_000


def test_rebalancing_rings(spark):
    made = N.generate(spark, N.Config(accounts=120, transactions=600, rings=6))
    more = N.rebalance(made)
    assert more.columns == made.columns and more.where("ring_id is not null").count() == 0
    both = made.unionByName(more).withColumn("us", F.unix_micros("ts"))
    ratios = N.ring_ratios(both.where("sender >= 0"), F.col("ring_id").isNotNull()).where("account >= 0").collect()
    assert ratios and all(r.ratio <= 0.4 + 1e-9 and r.has_before and r.has_after for r in ratios)


def test_database_rows(spark, tmp_path):
    """Alerts as id and JSON from a database (the one that Spark brings along)."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [("a1", '{"rule_score": 70.0, "graph_score": 10.5}'), ("a2", '{"rule_score": 5}'), ("a3", "no json")]
    spark.createDataFrame(rows, "alert_id string, breakdown string").write.format("jdbc").options(url=url, dbtable="alerts", driver=driver).save()
    schema = "rule_score double, graph_score double"
    from pyspark.sql.types import _parse_datatype_string

    got = T.read_database(spark, url, 'SELECT "alert_id", "breakdown" FROM alerts', _parse_datatype_string(schema), driver=driver)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [("a1", 70.0, 10.5), ("a2", 5.0, None), ("a3", None, None)]


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        T.shared_folder(Cluster())


def test_features_of_all_accounts(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 4), (5, 6), (6, 5)]
    txn = spark.createDataFrame([(i, 1000 * i, u, v, 100.0 * (i + 1)) for i, (u, v) in enumerate(rows)], "tx_id long, us long, sender long, receiver long, amount double")
    features = G.graph_features(txn)
    got = {r.account: r for r in features.collect()}
    assert features.columns == ["account", *G.GRAPH_FEATURES] and set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1].three_cycles == 1 and got[5].two_cycles == 1 and got[4].community == 4 and got[4].community_size == 1 and got[4].community_density == 0.0
    joined = {r.tx_id: r for r in G.with_graph_features(txn, features.where("account <> 2"), ("in_degree", "three_cycles")).collect()}
    assert joined[0].g_three_cycles == 1 and joined[1].g_in_degree == 0 and len(joined) == 6
    exact = G.pagerank(G.condensed(txn), rounds=200, tolerance=1e-9)
    assert exact.agg(F.sum("pagerank")).first()[0] == pytest.approx(1.0) and len({round(r.pagerank, 6) for r in exact.collect()}) == 1


def test_status_reads_its_alerts_as_written(spark):
    """The plan over alerts and changes holds the scored transfers once, as a table, and none of their expressions."""
    from riskweave.plans.registry import QUERIES

    plan = QUERIES["alr_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "rule_score" not in plan and "props" not in plan
