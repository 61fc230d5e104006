"""Path, density, cycle and flow operators, features as of each transfer, linear windows and tree attributions against brute force."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import behaviour as B
from riskweave.operators import cycles as C
from riskweave.operators import flow as FL
from riskweave.operators import graph as G
from riskweave.operators import live_graph as L
from riskweave.operators import models as M
from riskweave.operators import tree_shap as TS
from riskweave.plans.registry import QUERIES


def edge_frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "u long, v long")


def brute_betweenness(nodes, edges):
    after = defaultdict(list)
    for u, v in edges:
        after[u].append(v)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, ways, order, before = {s: 0}, Counter({s: 1}), [], defaultdict(list)
        queue = deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in after[u]:
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
                if depth[v] == depth[u] + 1:
                    ways[v] += ways[u]
                    before[v].append(u)
        part = dict.fromkeys(nodes, 0.0)
        for v in reversed(order):
            for u in before[v]:
                part[u] += ways[u] / ways[v] * (1 + part[v])
            if v != s:
                total[v] += part[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_degrees_of_pairs_and_graph_features_by_brute_force(spark):
    """Loops, repeated transfers and pairs both ways, all told from pairs that are written once."""
    rng = random.Random(7)
    rows = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(1, 900)), i) for i in range(90)] + [(20, 20, 5.0, 95)]
    t = spark.createDataFrame(rows, "sender long, receiver long, amount double, us long")
    names = ("in_degree", "out_degree", "in_unique", "out_unique")
    assert {(r.account, *(r[c] for c in names)) for r in G.degrees_of(G.pairs(t)).collect()} == {(r.account, *(r[c] for c in names)) for r in G.degrees(t).collect()}
    edges = {(u, v) for u, v, *_ in rows if u != v}
    between = brute_betweenness(sorted({x for e in edges for x in e}), edges)
    labels = {r.account: r.community for r in G.label_propagation(edge_frame(spark, edges)).collect()}
    got = {r.account: r for r in G.graph_features(t).collect()}
    assert got.keys() == {x for u, v, *_ in rows for x in (u, v)}
    for a, r in got.items():
        assert r.two_cycles == sum((a, x) in edges and (x, a) in edges for x in range(21))
        assert r.three_cycles == sum((a, x) in edges and (x, y) in edges and (y, a) in edges for x in range(21) for y in range(21))
        assert r.community == labels.get(a, a) and r.betweenness == pytest.approx(between.get(a, 0.0), abs=1e-12)


def test_betweenness_of_200_accounts(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(196), rng.randrange(196)) for _ in range(700)} | {(0, i) for i in range(1, 60)} | {(i, i + 1) for i in range(195, 199)} | {(199, 0)}
    edges = {(u, v) for u, v in edges if u != v}
    nodes = sorted({x for e in edges for x in e})
    got = {r.account: r.betweenness for r in G.betweenness(edge_frame(spark, edges | {(5, 5)}), sources=300).collect()}
    want = brute_betweenness(nodes, edges)
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-12) for v in nodes)
    few = G.betweenness(edge_frame(spark, edges), sources=20).agg(F.sum("betweenness")).first()[0]
    assert 0 < few < 5 * sum(want.values())


def peeled(edges, eps):
    """Snapshots (accounts, transfers) of batch peeling, by the rule."""
    left, out = list(edges), []
    while left:
        degree = Counter(x for e in left for x in e)
        out.append((set(degree), len(left)))
        gone = {x for x, d in degree.items() if d <= (1 + eps) * 2 * len(left) / len(degree)}
        left = [e for e in left if not gone & set(e)]
    return out


def exact_peel(edges):
    """The densest by transfers an account among all steps of peeling one at a time."""
    left, best = list(edges), 0.0
    while left:
        degree = Counter(x for e in left for x in e)
        best = max(best, len(left) / len(degree))
        worst = min(degree, key=lambda x: (degree[x], x))
        left = [e for e in left if worst not in e]
    return best


@pytest.mark.parametrize("by", ["pairs", "accounts"])
def test_densest_parts(spark, by):
    rng = random.Random(6)
    rows = []
    for c, n, m in ((1, 30, 60), (2, 60, 400), (3, 2, 5), (4, 80, 90)):
        edges = [(1000 * c + rng.randrange(n), 1000 * c + rng.randrange(n)) for _ in range(m)]
        clique = [1000 * c + i for i in range(6)]
        edges += [(a, b) for a in clique for b in clique if a != b and c != 3] * 2
        rows += [(c, u, v) for u, v in edges if u != v]
    got = defaultdict(set)
    density = {}
    for r in G.densest(spark.createDataFrame(rows, "community long, u long, v long"), by=by).collect():
        got[r.community].add(r.account)
        density[r.community] = r.density
    for c in (1, 2, 3, 4):
        edges = [(u, v) for k, u, v in rows if k == c]
        measure = (lambda s: s[1] / (len(s[0]) * (len(s[0]) - 1))) if by == "pairs" else (lambda s: s[1] / len(s[0]))
        best = max(peeled(edges, 0.1), key=measure)
        assert got[c] == best[0] and density[c] == pytest.approx(measure(best))
        if by == "accounts":
            assert density[c] >= exact_peel(edges) / 2.2


def test_benford_of_the_densest_part(spark):
    """Round amounts inside a clique are told, where those of the whole community hide them; else the community counts."""
    rng = random.Random(3)
    rows, n = [], itertools.count()
    clique = range(8)
    for u in range(8, 300):
        rows += [(next(n), u, rng.randrange(300), float(int(10 ** rng.uniform(2, 6)))) for _ in range(3)]
    rows += [(next(n), a, b, 700.0) for a in clique for b in clique if a != b]
    rows += [(next(n), 1000, 1001, 500.0)] * 9
    txn = spark.createDataFrame(rows, "tx_id long, sender long, receiver long, amount double")
    members = spark.createDataFrame([(i, 0) for i in range(300)] + [(1000, 7), (1001, 7)], "account long, community long")
    got = {r.community: r for r in G.dense_benford(txn, members).collect()}
    assert got[0].benford_anomaly and got[0].densest_size == 8 and got[0].benford_chi2_densest > 100
    assert got[7].benford_anomaly and got[7].benford_chi2_densest == 0.0 and got[7].benford_chi2_community > 3.84


def test_representative_families():
    """For every set of others that some set avoids, a kept one does."""
    rng = random.Random(4)
    for size, others in ((1, 5), (2, 4), (3, 3)):
        for _ in range(30):
            family = list({frozenset(rng.sample(range(9), size)) for _ in range(rng.randrange(1, 60))})
            kept = C.representatives(family, others)
            assert set(kept) <= set(family) and len(kept) <= sum(others**i for i in range(size + 1)) + 1
            for y in itertools.combinations(range(9), others):
                assert any(not s & set(y) for s in family) == any(not s & set(y) for s in kept)


def longest_cycle(edges, bound=8):
    after, best = defaultdict(set), 0
    for u, v in edges:
        if u != v:
            after[u].add(v)

    def go(start, here, seen):
        nonlocal best
        if start in after[here]:
            best = max(best, len(seen))
        if len(seen) < bound and best < bound:
            for v in after[here]:
                if v > start and v not in seen:
                    go(start, v, seen | {v})

    for s in list(after):
        go(s, s, {s})
    return best if best > 1 else 0


def test_longest_cycles_equal_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(14):
        n, m = rng.choice(((6, 9), (12, 16), (20, 24), (9, 40)))
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        if c == 0:
            edges = {(i, (i + 1) % 9) for i in range(9)}  # too long
        if c == 1:
            edges = {(i, i + 1) for i in range(9)}
        if c == 2:  # ends of a bipartite graph: even cycles alone, and none over six
            edges = {(a, b) for a in range(3) for b in range(3, 9)} | {(b, a) for a in range(3) for b in range(3, 9)}
        rows += [(c, 100 * c + u, 100 * c + v) for u, v in edges]
        if longest_cycle(edges):
            want[c] = longest_cycle(edges)
    got = {r.community: r.max_cycle_length for r in C.longest_cycles(spark.createDataFrame(rows, "community long, u long, v long"), tries=1).collect()}
    assert got == want and want[2] == 6


def test_flow_communities_hold_the_walker(spark):
    """Directed rings joined by a few links: the walk stays in a ring, whereas labels run along the links."""
    rows, planted = [], {}
    for ring in range(4):
        a = [ring * 10 + i for i in range(8)]
        planted |= dict.fromkeys(a, a[0])
        rows += [(a[i], a[(i + 1) % 8], 10.0) for i in range(8)] + [(a[i], a[(i + 3) % 8], 4.0) for i in range(8)]
        rows.append((a[7], (ring + 1) % 4 * 10, 1.5))
    weighted = spark.createDataFrame(rows, "u long, v long, weight double")
    found, lengths = FL.flow_communities(weighted)
    got = {r.account: r.community for r in found.collect()}
    assert got == planted
    assert len(lengths) > 2 and all(b < a for a, b in itertools.pairwise(lengths))
    labels = {r.account: r.community for r in G.label_propagation(weighted.select("u", "v")).collect()}
    assert labels != planted


def transfers(rng, n, accounts, days=40):
    times = sorted(rng.randrange(days * 24) * 3_600_000_000 for _ in range(n))
    return [(i, t, rng.randrange(accounts), rng.randrange(accounts), round(rng.choice((5.0, 10**rng.uniform(1, 6))), 2)) for i, t in enumerate(times)]


TXN = "tx_id long, us long, sender long, receiver long, amount double"


def test_trailing_sums_are_those_of_the_frames(spark):
    rng = random.Random(9)
    rows = transfers(rng, 400, 4) + [(1000 + i, 0, 77, 1, 12.5) for i in range(5)]
    txn = spark.createDataFrame(rows, TXN)
    got = {r.tx_id: r for r in B.amounts(B.velocity(txn)).collect()}
    assert len(got) == len(rows)
    for i, t, s, _, x in rows:
        frame = lambda w, t=t, s=s: [r[4] for r in rows if r[2] == s and t - w <= r[1] <= t]
        week, month = frame(7 * B.DAY), frame(30 * B.DAY)
        assert got[i].tx_velocity_1h == len(frame(B.HOUR)) and got[i].tx_velocity_7d == len(week)
        assert got[i].avg_amount_7d == pytest.approx(np.mean(week)) and got[i].std_amount_7d == pytest.approx(np.std(week), abs=1e-6)
        assert got[i].avg_daily_volume_30d == pytest.approx(sum(month) / 30)
        spread = np.std(month) if len(set(month)) > 1 else 0.0
        assert got[i].amount_zscore == pytest.approx((x - np.mean(month)) / (spread or 1.0), abs=1e-6)
    assert all(got[1000 + i].std_amount_7d == 0.0 and got[1000 + i].amount_zscore == 0.0 for i in range(5))
    split = {r.tx_id: r.n for r in B.trailing_sums(txn, "sender", {"n": (F.lit(1), 7 * B.DAY)}, split=B.DAY // 3).collect()}
    assert split == {i: r.tx_velocity_7d for i, r in got.items()}
    assert B.velocity(txn.where("false")).count() == 0


def test_switches_are_those_between_neighbours_in_the_week(spark):
    rng = random.Random(10)
    rows = [(i, t + i, s, rng.choice("ab"), rng.randrange(3)) for i, t, s, _, _ in transfers(rng, 300, 3, 60)]
    got = {r.tx_id: r for r in B.switches(spark.createDataFrame(rows, "tx_id long, us long, sender long, country string, device long")).collect()}
    for i, t, s, _, _ in rows:
        frame = [r for r in rows if r[2] == s and t - 7 * B.DAY <= r[1] <= t]
        assert got[i].country_switch_count_7d == sum(a[3] != b[3] for a, b in itertools.pairwise(frame))
        assert got[i].device_change_count_7d == sum(a[4] != b[4] for a, b in itertools.pairwise(frame))


def test_windows_of_a_busy_sender_take_linear_time(spark):
    txn = spark.range(100_000).select(F.col("id").alias("tx_id"), (F.col("id") * 30_000_000).alias("us"), F.lit(1).cast("long").alias("sender"), (F.col("id") * 7919 % 500).alias("receiver"), (F.col("id") % 9973 + 1.0).alias("amount"))
    began = time.time()
    out = B.digits(B.amounts(B.velocity(txn)))
    last = out.where("tx_id = 99999").first()
    assert time.time() - began < 30
    assert last.tx_velocity_24h == 2881 and last.tx_velocity_7d == 20161
    month = [i % 9973 + 1.0 for i in range(99_999 - 86_400, 100_000)]
    assert last.amount_zscore == pytest.approx((99_999 % 9973 + 1 - np.mean(month)) / np.std(month), abs=1e-6)
    counts = Counter(i * 7919 % 500 for i in range(99_999 - 86_400, 100_000))
    assert last.receiver_entropy == pytest.approx(-sum(c / 86_401 * math.log2(c / 86_401) for c in counts.values()), abs=1e-6)


def test_features_as_of_each_transfer(spark):
    rng = random.Random(12)
    rows = transfers(rng, 160, 9)
    txn = spark.createDataFrame(rows, TXN)
    accounts = spark.createDataFrame([(0, 5, 3, 0.5), (1, 5, 3, 0.5)], "account long, community long, community_size long, pagerank double")
    got = {r.tx_id: r for r in L.live_vector(txn, accounts).collect()}
    hops = {r.tx_id: r for r in L.two_hop(txn, txn.where("tx_id % 20 = 0"), cap=25).collect()}
    assert len(got) == len(rows) and set(hops) == set(range(0, 160, 20))
    for i, t, s, v, _ in rows:
        past = [r for r in rows if r[1] <= t]
        r = got[i]
        assert (r.sender_in_degree, r.sender_out_degree) == (sum(p[3] == s for p in past), sum(p[2] == s for p in past))
        assert (r.sender_in_degree_unique, r.sender_out_degree_unique) == (len({p[2] for p in past if p[3] == s}), len({p[3] for p in past if p[2] == s}))
        assert (r.receiver_in_degree, r.receiver_out_degree) == (sum(p[3] == v for p in past), sum(p[2] == v for p in past))
        edges = {(p[2], p[3]) for p in past if p[2] != p[3]}
        assert r.sender_2hop_cycle_count == sum((s, b) in edges and (b, s) in edges for b in range(9))
        assert r.sender_3hop_cycle_count == sum(len({s, b, c}) == 3 and {(s, b), (b, c), (c, s)} <= edges for b in range(9) for c in range(9))
        assert r.sender_community_id == (5 if s < 2 else -1) and r.shared_community == (s < 2 and v < 2) and r.sender_pagerank == (0.5 if s < 2 else 0.0) and r.sender_betweenness == 0.0
        if i in hops:
            both = edges | {(b, a) for a, b in edges}
            one = {b for a, b in both if a == s}
            two = {b for a, b in both if a in one} - {s}
            assert (hops[i].accounts or []) == sorted(one | two)
            inside = [(p[1], p[0]) for p in past if {p[2], p[3]} <= one | two | {s}]
            assert [(e.us, e.edge) for e in hops[i].edges or []] == sorted(inside)[:25]
    assert set(L.LIVE_FIELDS) <= set(next(iter(got.values())).asDict())


def brute_shapley(leaves_game, m):
    out = np.zeros(m)
    for f in range(m):
        for k in range(m):
            for s in itertools.combinations([g for g in range(m) if g != f], k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                out[f] += w * (leaves_game(set(s) | {f}) - leaves_game(set(s)))
    return out


def test_tree_attributions_equal_shapley_values(spark):
    """Against all subsets of six features, by the definition on the trees themselves."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    columns = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, row), float(k)) for i, (row, k) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"{c} double" for c in columns) + ", label double")
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    data = M.assemble(df, columns).cache()
    for maker in (GBTClassifier(maxIter=4, maxDepth=4, seed=1), RandomForestClassifier(numTrees=3, maxDepth=4, seed=1)):
        model = maker.fit(data)
        rows = TS.tree_attributions(data.where("id < 6"), columns, model, top=6).orderBy("id").collect()
        trees, weights = model.trees, list(getattr(model, "treeWeights", [1.0] * 9))

        def read(node):
            if node.getClass().getSimpleName() == "LeafNode":
                return (node.impurityStats().count(), node.prediction())
            return (node.impurityStats().count(), node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild()))

        def value(node, row, known):
            if len(node) == 2:
                return node[1]
            _, f, cut, left, right = node
            if f in known:
                return value(left if row[f] <= cut else right, row, known)
            return (left[0] * value(left, row, known) + right[0] * value(right, row, known)) / (left[0] + right[0])

        roots = [read(t._java_obj.rootNode()) for t in trees]

        for i, r in enumerate(rows):
            game = lambda known, row=x[i]: sum(w * value(t, row, known) for t, w in zip(roots, weights, strict=False))
            got = {f.feature: f.value for f in r.top_features}
            assert [got[c] for c in columns] == pytest.approx(list(brute_shapley(game, 6)), abs=1e-9)
            assert r.margin == pytest.approx(game(set(range(6)))) and r.base_value == pytest.approx(game(set()))
            assert sum(got.values()) == pytest.approx(r.margin - r.base_value)
            assert [abs(f.value) for f in r.top_features] == sorted((abs(f.value) for f in r.top_features), reverse=True)


def test_profiles_and_paths(spark):
    """A ring, a chain and a dense part, with the paths that each gives."""
    from riskweave.operators import suspicious as X

    rows, n = [], itertools.count()
    add = lambda u, v, x: rows.append((next(n), next(n), u, v, x))
    for i in range(3):
        add(i, (i + 1) % 3, 100.0 + i)
    add(0, 1, 900.0)
    add(2, 3, 5.0)
    add(3, 2, 6.0)
    for i in range(10, 15):
        add(i, i + 1, 50.0)
    txn = spark.createDataFrame(rows, "tx_id long, us long, sender long, receiver long, amount double")
    members = spark.createDataFrame([(i, 0) for i in range(4)] + [(i, 10) for i in range(10, 16)], "account long, community long")
    profiles, held, paths = X.profiles_and_paths(txn, members)
    got = {r.community: r for r in profiles.collect()}
    assert (got[0].dominant_pattern, got[0].max_cycle_length, got[10].dominant_pattern, got[10].max_cycle_length) == ("circular", 3, "layering_chain", 0)
    assert held.count() == 10
    assert {(tuple(r.path), r.path_length, r.pattern_type, r.total_value) for r in paths.collect()} == {((2, 3, 2), 2, "round_trip", 11.0), ((0, 1, 2, 0), 3, "round_trip", 900.0 + 101.0 + 102.0), (tuple(range(10, 16)), 5, "layering_chain", 250.0)}
    assert all(len(r.path_edges) == r.path_length for r in paths.collect())
    ring = spark.createDataFrame([(1, a, b) for a in range(5) for b in range(5) if a != b], "community long, u long, v long")
    every = sorted((len(c), [*c, c[0]]) for k in (2, 3, 4, 5) for c in itertools.permutations(range(5), k) if c[0] == min(c))
    assert [(r.length, r.path) for r in X.short_cycles(ring, cap=30).orderBy("length", "path").collect()] == every[:30]


def test_betweenness_in_blocks_and_chunks(spark, monkeypatch):
    from riskweave.operators import shortest

    monkeypatch.setattr(shortest, "CELL", 60)
    monkeypatch.setattr(shortest, "ROOM", 8 * 40 * 15)
    monkeypatch.setattr(shortest, "PIECE", 100)
    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(200)}
    edges = {(u, v) for u, v in edges if u != v}
    got = {r.account: r.betweenness for r in G.betweenness(edge_frame(spark, edges)).collect()}
    want = brute_betweenness(sorted({x for e in edges for x in e}), edges)
    assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-12) for v in want)


def test_only_what_is_there_is_sent_and_what_is_wanted_is_added(monkeypatch):
    """Along nonzero numbers, along wanted places, or whole rows: the same sums; and a matrix with little in it travels as little."""
    import numpy as np

    from riskweave.operators import shortest

    monkeypatch.setattr(shortest, "PIECE", 50)
    rng = np.random.default_rng(3)
    end, start = np.sort(rng.integers(0, 40, 300)).astype(np.int32), rng.integers(0, 30, 300).astype(np.int32)
    for filled, asked in ((0.05, 1.0), (1.0, 0.05), (1.0, 1.0), (0.5, 0.6), (0.0, 1.0), (1.0, 0.0)):
        send, wanted = np.where(rng.random((30, 8)) < filled, rng.integers(1, 9, (30, 8)), 0).astype(float), rng.random((40, 8)) < asked
        wire = shortest._wired(send)
        assert (shortest._unwired(*wire, 30, 8) == send).all() and sum(map(len, wire)) < send.nbytes / 2
        want, got = np.zeros((40, 8)), np.zeros((40, 8))
        np.add.at(want, end, send[start])
        shortest._added(got, send, start, end, wanted)
        assert (got[wanted] == want[wanted]).all()
    shortest._added(got, send, start[:0], end[:0], wanted)
    many = rng.random((300, 300))
    assert (shortest._unwired(*shortest._wired(many), 300, 300) == many).all()


@pytest.mark.parametrize("cell", [20, 2_000_000])
def test_openings_by_definition(spark, monkeypatch, cell):
    """With loops, pairs both ways, a hub, and paths that return to where they were."""
    from riskweave.operators import openings as O

    monkeypatch.setattr(O, "CELL", cell)
    rng = random.Random(4)
    first = {(rng.randrange(14), rng.randrange(14)): rng.randrange(1000) for _ in range(60)} | {(0, i): rng.randrange(1000) for i in range(9)}
    got = {(r.r, r.s): (r.at1, r.at2, r.at3) for r in O.openings(spark.createDataFrame([(u, v, at) for (u, v), at in first.items()], "u long, v long, at long")).collect()}
    two, three = {}, {}
    for (a, b), x in first.items():
        for (c, e), y in first.items():
            if b == c:
                two[a, e] = min(two.get((a, e), 9999), max(x, y))
    for (a, b), x in first.items():
        for (c, e), y in two.items():
            if b == c:
                three[a, e] = min(three.get((a, e), 9999), max(x, y))
    for s, r in first:
        assert got.get((r, s), (None, None, None)) == (first.get((r, s)), two.get((r, s)), three.get((r, s)))


def test_wedges_are_lists(spark):
    """No step is joined with the steps beside it: of a plan over triangles, each row is one step with a list."""
    plan = G.triangles(edge_frame(spark, {(1, 2), (2, 3), (3, 1), (1, 4)}))._jdf.queryExecution().analyzed().toString()
    assert "array_intersect" in plan and "hb" not in plan


def test_rows_are_dealt_by_sender_once(spark):
    """All frames of a sender follow one shuffle; only shared devices take another."""
    at = "tx_id long, us long, ts timestamp, sender long, receiver long, amount double, channel string, country string, receiver_country string, international boolean, lat double, lon double, device int, ip int"
    plan = B.features(spark.createDataFrame([], at))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2
    narrow = L.sender_history(spark.createDataFrame([], at))._jdf.queryExecution().executedPlan().toString()
    assert narrow.count("Exchange hashpartitioning(") == 1


def test_lists_of_openings_are_shorts(spark, monkeypatch):
    """What travels of a path's far end is 16 bits at a time, and accounts and times of any size come back from it."""
    from riskweave.operators import openings as O

    widths, planes = set(), O._planes
    monkeypatch.setattr(O, "_planes", lambda x, n: widths.add(n) or planes(x, n))
    for a, b, c in ((5, 70_000, 2**31 + 7), (-(2**63), -3, 2**63 - 1)):
        first = {(a, b): 10, (b, c): -20, (c, a): 2**52 + 3, (a, c): 70_007, (c, c): 1}
        got = {(r.r, r.s): (r.at1, r.at2, r.at3) for r in O.openings(spark.createDataFrame([(u, v, at) for (u, v), at in first.items()], "u long, v long, at long")).collect()}
        assert got[b, a] == (None, 2**52 + 3, 2**52 + 3) and got[c, b] == (None, 2**52 + 3, 2**52 + 3)
        assert got[a, c] == (70_007, 10, 10) and got[c, a] == (2**52 + 3, 2**52 + 3, 2**52 + 3) and got[c, c] == (1, 1, 1)
    assert widths == {2, 4}


def test_dense_communities_need_no_families(spark, monkeypatch):
    """A search along few edges finds the longest cycle of a dense community; only the others are done with all half-paths."""
    rng = random.Random(7)
    dense = {(0, u, v) for u in range(400) for v in rng.sample(range(400), 20) if u != v}
    ring = {(1, 1000 + i, 1000 + (i + 1) % 5) for i in range(5)}
    given, lengths = [], C._lengths
    monkeypatch.setattr(C, "_lengths", lambda edges, *a, **k: given.append({r.community for r in edges.select("community").distinct().collect()}) or lengths(edges, *a, **k))
    got = {r.community: r.max_cycle_length for r in C.longest_cycles(spark.createDataFrame(sorted(dense | ring), "community long, u long, v long")).collect()}
    assert got == {0: 8, 1: 5} and given and all(x == {1} for x in given)


def test_core_is_written_step_by_step(spark, monkeypatch):
    """Each step reads the one before twice: in one plan, edges would be read as often as two to the number of steps."""
    joins, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: joins.append(df._jdf.queryExecution().analyzed().toString().count("Join ")) or cut(df))
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4), (1, 4, 5), (1, 9, 1)], "community long, u long, v long")
    assert sorted(tuple(r) for r in C._core(edges).collect()) == [(1, 1, 2), (1, 2, 3), (1, 3, 1)]
    assert max(joins) == 1


def _many_edges():
    """More accounts than 300, in a ring with chords, a branch that ends, and an account without a step out."""
    rng = random.Random(11)
    edges = {(i, (i + 1) % 330) for i in range(330)} | {(rng.randrange(330), rng.randrange(330)) for _ in range(500)} | {(5, 400), (400, 401), (500, 5)}
    return {(u, v) for u, v in edges if u != v}


def test_betweenness_query_goes_from_every_account(spark, tmp_path):
    """With more accounts than graph features draw (300), the query still equals brute force."""
    import datetime

    rng = random.Random(3)
    ids = rng.sample(range(5_000), 600)
    rows = [(e, datetime.datetime(2024, 1, 1, 0, 0, e % 60), rng.randrange(400), "web", 1.0, '{"k": 3}') for e in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    users = max(r[2] for r in rows) + 1
    edges = {(u, (u + e * 7919 + 13) % users) for e, _, u, *_ in rows}
    edges = {(u, v) for u, v in edges if u != v}
    nodes = {x for e in edges for x in e}
    assert len(nodes) > 300
    got = {r.account: r.betweenness for r in QUERIES["gr_betweenness"](spark, str(tmp_path)).collect()}
    want = brute_betweenness(sorted(nodes), edges)
    assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1.1e-8) for v in want)


def test_betweenness_in_tasks_and_in_turns(spark, monkeypatch):
    """Slices, several tasks and turns give brute force; drawn sources give the same either way; a turn leaves nothing behind."""
    import glob

    from riskweave.operators import brandes, shortest
    from riskweave.sources.tables import shared_folder

    edges = _many_edges()
    want = brute_betweenness(sorted({x for e in edges for x in e}), edges)
    near = lambda got, want: got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-12) for v in want)
    of = lambda **how: {r.account: r.betweenness for r in G.betweenness(edge_frame(spark, edges), **how).collect()}
    monkeypatch.setattr(brandes, "SLICE", 100)
    monkeypatch.setattr(brandes, "LEAST", 1_000)
    assert near(of(sources=None), want)
    few = of(sources=20)
    monkeypatch.setattr(brandes, "WHOLE", 0)
    monkeypatch.setattr(shortest, "CELL", 300)
    monkeypatch.setattr(shortest, "ROOM", 8 * 330 * 50)
    assert near(of(sources=20), few)
    monkeypatch.setattr(shortest, "TURN", 18 * len(want) * 120)
    before = set(glob.glob(f"{shared_folder(spark)}/graph-*"))
    assert near(of(sources=None), want)
    assert len(set(glob.glob(f"{shared_folder(spark)}/graph-*")) - before) <= 6
    assert G.betweenness(spark.createDataFrame([(1, 1)], "u long, v long"), sources=None).collect()[0].betweenness == 0.0
    assert not G.betweenness(spark.createDataFrame([], "u long, v long"), sources=None).collect()
