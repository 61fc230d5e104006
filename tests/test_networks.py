"""The networks against numerical gradients, PCA and held-out links."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import models as M
from riskweave.operators import networks as N


def numeric(loss, weights, eps=1e-6):
    out = []
    for i, w in enumerate(weights):
        g = np.zeros_like(w)
        for at in np.ndindex(*w.shape):
            moved = [x.copy() for x in weights]
            moved[i][at] += eps
            up = loss(moved)
            moved[i][at] -= 2 * eps
            g[at] = (up - loss(moved)) / (2 * eps)
        out.append(g)
    return out


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(1)
    batch = pd.DataFrame({"x": list(rng.normal(size=(7, 5)))})
    weights = N.drawn_weights([(5, 4), (4,), (4, 2), (2,), (2, 4), (4,), (4, 5), (5,)], 3)
    _, got = N._autoencoder_gradient(weights, batch)
    for a, b in zip(got, numeric(lambda w: N._autoencoder_gradient(w, batch)[0], weights), strict=True):
        assert a == pytest.approx(b, abs=1e-5)
    pairs = pd.DataFrame({"y": [1.0, 0.0, 1.0], **{f"own_{s}": list(rng.normal(size=(3, 4))) for s in "ab"}, **{f"others_{s}": [list(rng.normal(size=(k, 4))) for k in (2, 0, 3)] for s in "ab"}})
    weights = N.drawn_weights([(4, 3), (3,), (6, 2), (2,)], 5)
    _, got = N._link_gradient(weights, pairs)
    for a, b in zip(got, numeric(lambda w: N._link_gradient(w, pairs)[0], weights), strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_summed_gradients_are_those_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    weights = N.drawn_weights([(3, 2), (2,), (2, 1), (1,), (1, 2), (2,), (2, 3), (3,)], 1)
    want = N._autoencoder_gradient(weights, pd.DataFrame({"x": list(x)}))
    for parts in (1, 3, 50):
        df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(parts)
        loss, n, got = N.summed_gradients(df, weights, N._autoencoder_gradient)
        assert n == 60 and loss == pytest.approx(want[0])
        assert all(a == pytest.approx(b) for a, b in zip(got, want[1], strict=True))
    assert N.summed_gradients(df.where("false"), weights, N._autoencoder_gradient)[1] == 0


def test_autoencoder_beats_pca_on_a_curve(spark):
    """Points near a closed curve in 8 columns: two straight directions can't follow its turns, a code of two numbers can."""
    rng = np.random.default_rng(4)
    t = rng.uniform(0, 2 * np.pi, 900)
    x = np.stack([f(k * t) for k in (1, 2, 3, 4) for f in (np.sin, np.cos)], axis=1) + rng.normal(0, 0.01, (900, 8))
    columns = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in columns)).repartition(2)
    model = N.Autoencoder(columns, hidden=24, code=2, epochs=40, batches=2, rate=0.02).fit(df, "id")
    own = model.score(df).agg(F.avg("mse")).first()[0]
    straight = M.reconstruction_errors(df, columns, rank=2).agg(F.avg("mse")).first()[0]
    assert own < 0.8 * straight and model.losses[-1] < model.losses[0]
    strange = model.score(spark.createDataFrame([(1, *[9.0 if c == "c3" else 0.0 for c in columns])], df.schema)).first()
    assert strange.mse > 5 * own and strange.drivers[0] == "c3"


def test_embeddings_tell_held_out_links(spark):
    rng = random.Random(6)
    group = {i: i % 5 for i in range(100)}
    edges = {tuple(sorted(rng.sample([a for a in group if group[a] == c], 2))) for c in range(5) for _ in range(150)} | {tuple(sorted(rng.sample(range(100), 2))) for _ in range(40)}
    edges = sorted(edges)
    rng.shuffle(edges)
    held, kept = edges[:100], edges[100:]
    nodes = N.node_features(spark.createDataFrame([(i, float(i % 7)) for i in group], "account long, degree double"), ["degree"])
    frame = spark.createDataFrame(kept, "u long, v long").repartition(2)
    model = N.PartnerEmbeddings(epochs=12, batches=2).fit(nodes, frame)
    z = {r.account: np.array(r.vector) for r in model.embed(nodes, frame).collect()}
    assert len(z) == 100
    score = lambda e: float(z[e[0]] @ z[e[1]])
    known = set(edges)
    false = [e for e in (tuple(sorted(rng.sample(range(100), 2))) for _ in range(400)) if e not in known][:200]
    auc = np.mean([score(a) > score(b) for a in held for b in false])
    assert auc > 0.7 and model.losses[-1] < model.losses[0]


def test_training_writes_no_row_a_pair_with_neighbourhoods(spark, monkeypatch):
    """Gradients by cells and slices are those of whole rows, and what is written of neighbourhoods has a row an account at most."""
    rng, n = np.random.default_rng(8), 60
    pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.4]
    nodes = N.node_features(spark.createDataFrame([(i, float(i % 7)) for i in range(n)], "account long, degree double"), ["degree"], marks=3)
    edges = spark.createDataFrame(pairs, "u long, v long")
    written, cut = [], N.cut

    def watched(df):
        out = cut(df)
        written.append(out)
        return out

    monkeypatch.setattr(N, "cut", watched)
    monkeypatch.setattr(N, "CELL", 60, raising=False)
    monkeypatch.setattr(N, "SLICE", 7, raising=False)
    model = N.PartnerEmbeddings(epochs=1, batches=2, hidden=5, size=4).fit(nodes, edges)
    assert all(f.count() <= n for f in written if any(c.startswith(("own", "others")) for c in f.columns))

    around = {r.account: r for r in N._neighbourhoods(nodes, N.sampled_partners(edges, partners=8, seed=42)).collect()}
    place = {(r.b, r.i): r.account for f in written if f.columns == ["account", "b", "i"] for r in f.collect()}
    cells = next(f for f in written if "ia" in f.columns)
    slices = next(f for f in written if "counts" in f.columns)
    assert cells.count() > 8 and slices.count() > 8
    rows = []
    for c in cells.collect():
        for i, j, y in zip(np.frombuffer(c.ia, np.int32), np.frombuffer(c.ib, np.int32), np.frombuffer(c.y, np.int8), strict=True):
            a, b = around[place[c.ba, i]], around[place[c.bb, j]]
            rows.append({"y": float(y), "own_a": a.own, "others_a": a.others, "own_b": b.own, "others_b": b.others})
    assert sum(r["y"] for r in rows) == len(pairs)
    weights = N.drawn_weights([(8, 5), (5,), (10, 4), (4,)], 3)
    want, got = N._link_gradient(weights, pd.DataFrame(rows)), N._link_gradients(slices, cells, weights)
    assert got[0] == pytest.approx(want[0])
    assert all(a == pytest.approx(b) for a, b in zip(got[1], want[1], strict=True))


def test_drawn_partners_and_numbers(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(5, 6), (6, 5), (7, 7)], "u long, v long")
    got = N.sampled_partners(edges, partners=8, seed=1).groupBy("account").count()
    assert {r.account: r["count"] for r in got.collect()} == {0: 8, **{i: 2 if i in (5, 6) else 1 for i in range(1, 300)}}
    ids = N.numbered(edges.select(F.col("u").alias("account")).union(edges.select("v")), 3).collect()
    assert sorted(r.i for r in ids) == list(range(len(ids))) and len(ids) == 300


def test_stratified_split_is_exact(spark):
    rows = [(i, i % 10 == 0 if i < 900 else None) for i in range(1000)]
    got = M.stratified_split(spark.createDataFrame(rows, "id long, label boolean"), "id", "label").collect()
    assert len(got) == 1000
    counts = {(label, part): sum(r.label == label and r.part == part for r in got) for label in (True, False, None) for part in range(3)}
    assert counts == {(True, 0): 54, (True, 1): 18, (True, 2): 18, (False, 0): 486, (False, 1): 162, (False, 2): 162, (None, 0): 60, (None, 1): 20, (None, 2): 20}


def test_models_see_rows_that_are_worked_out_once(spark):
    """Behind ml_supervised is one shuffle by sender, whose rows are written before three models read them."""
    from riskweave.plans import queries_risk as Q
    from riskweave.sources.tables import txn

    where = "/root/testdata/sf0.001"
    plan = Q.modelled(spark, where)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sender") == 1
    whole = Q.B.amounts(Q.B.velocity(txn(spark, where))).withColumn("label", (F.col("amount") % 7 < 1).cast("int")).select("tx_id", *Q.COLUMNS, "label")
    assert sorted(map(tuple, Q.modelled(spark, where).collect())) == sorted(map(tuple, whole.collect()))
    out = Q.ml_supervised(spark, where)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.tx_id for r in out.collect()} == {r.tx_id for r in M.hash_split(whole, "tx_id", "label").where("part = 2").collect()}


def test_rows_go_down_trees_as_branches_tell(spark):
    """Paths of all rows at once are those of going down branch by branch, where numbers stand on a cut or are missing as well."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(0, 5, (200, 3)), rng.normal(size=(200, 3)), [[np.nan, np.inf, -np.inf]]]).astype(float)

    def down(tree, row, depth=0):
        return depth + M._mean_path(tree[0]) if len(tree) == 1 else down(tree[2 if row[tree[0]] < tree[1] else 3], row, depth + 1)

    for depth in (1, 4, 8):
        tree = M._isolation_tree(x[:-1], rng, depth)
        assert M._depths(M._laid_out(tree), x, depth).tolist() == [down(tree, row) for row in x]
    assert M._depths(M._laid_out((1,)), x, 3).tolist() == [0.0] * len(x)


def test_known_graph_features_give_the_same_communities(spark):
    from riskweave.operators import graph as G

    rng = np.random.default_rng(6)
    t = spark.createDataFrame([(int(u), int(v), float(a), i) for i, (u, v, a) in enumerate(zip(rng.integers(0, 25, 80), rng.integers(0, 25, 80), rng.integers(1, 900, 80), strict=True))], "sender long, receiver long, amount double, us long")
    members = G.cut(G.label_propagation(G.adjacency(t)))
    plain = sorted(map(tuple, G.community_profiles(t, members).collect()))
    assert sorted(map(tuple, G.community_profiles(t, members, G.cut(G.graph_features(t, members))).collect())) == plain


def test_layers_come_from_one_matrix_that_is_split_before_it_is_wide(spark, monkeypatch):
    """fus_layers splits transfers, not the matrix, and finds triangles once."""
    from riskweave.operators import graph as G
    from riskweave.plans import queries_layers as Q

    split, found = [], []
    plain, met = M.stratified_split, G.triangles
    monkeypatch.setattr(M, "stratified_split", lambda df, *a: split.append(len(df.columns)) or plain(df, *a))
    monkeypatch.setattr(G, "triangles", lambda *a: found.append(1) or met(*a))
    alerts = Q.fus_layers(spark, "/root/testdata/sf0.001")
    assert len(split) == 1 and split[0] < 25 and len(found) == 1
    assert alerts.where("transaction_risk_score is null or anomaly_score is null or supervised_score is null").count() == 0
