"""Keyed state: a warm start, a restart and injected events give what one replay gives."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from riskweave.streaming import keyed as K
from riskweave.streaming import stream as X

BASE = dt.datetime(2024, 1, 1)


def made(rng, n, first=0):
    times = sorted(rng.randrange(20_000) for _ in range(n))
    return [(first + i, BASE + dt.timedelta(seconds=first * 30 + t), rng.randrange(3), rng.choice(("click", "view", "buy")), float(rng.randrange(100)), "{}") for i, t in enumerate(times)]


def replayed(rows):
    """Features by the definition, one event after the other."""
    seen, out = {}, []
    for event, ts, user, kind, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        past = seen.setdefault(user, [])
        recent = sum((ts - t).total_seconds() <= 3600 for t, _ in past) + 1
        out.append((event, user, len(past) + 1, recent, (ts - past[-1][0]).total_seconds() if past else 0.0, kind not in {k for _, k in past}, (ts - past[0][0]).total_seconds() if past else 0.0))
        past.append((ts, kind))
    return sorted(out)


def files(spark, path, *parts):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(f"{path}/{i}")
    return [f"{path}/{i}" for i in range(len(parts))]


def run(spark, stream, out, checkpoint):
    X.run_available(stream, out, checkpoint)
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_warm_start_and_restart(spark, tmp_path):
    K.use_state_store(spark)
    rows = made(random.Random(1), 90)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    a, b, c = rows[:30], rows[30:60], rows[60:]
    home = str(tmp_path / "in")
    history, *_ = files(spark, home, a)
    (tmp_path / "live").mkdir()
    live = str(tmp_path / "live")
    events = lambda: X.event_stream(spark, live)
    known = K.prioritised(spark.read.schema(X.EVENT).parquet(history).withColumn("ts", K.F.col("ts").cast("timestamp")))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame(b, X.EVENT).repartition(1).write.mode("append").parquet(live)
    run(spark, K.account_features(K.prioritised(events()), known), out, checkpoint)
    spark.createDataFrame(c, X.EVENT).repartition(1).write.mode("append").parquet(live)
    got = run(spark, K.account_features(K.prioritised(events()), known), out, checkpoint)  # goes on from the checkpoint
    want = [r for r in replayed(rows) if r[0] not in {x[0] for x in a}]
    assert [(*r[:4], pytest.approx(r[4]), r[5], pytest.approx(r[6])) for r in got] == want
    last = {}
    for r in K.last_events(spark, checkpoint).collect():
        last.setdefault(r.user_id, []).append(r.event_id)
    for user in range(3):
        mine = [r[0] for r in rows if r[2] == user]
        assert sorted(last[user]) == sorted(mine[-20:])


def test_injected_events_pass_ahead(spark, tmp_path):
    K.use_state_store(spark)
    rows = [(i, BASE + dt.timedelta(minutes=i), 1, "view", 1.0, "{}") for i in range(5)]
    urgent = [(100, BASE + dt.timedelta(minutes=9), 1, "buy", 1.0, "{}")]
    regular, injected = files(spark, str(tmp_path / "in"), rows, urgent)
    stream = K.prioritised(X.event_stream(spark, regular), X.event_stream(spark, injected))
    got = {r[0]: r for r in run(spark, K.account_features(stream), str(tmp_path / "out"), str(tmp_path / "ck"))}
    assert got[100][2] == 1 and [got[i][2] for i in range(5)] == [2, 3, 4, 5, 6]


def test_memory_of_batch_and_stream_agree(spark, tmp_path):
    K.use_state_store(spark)
    rows = sorted(made(random.Random(3), 40), key=lambda r: (r[1], r[0]))
    where, later = files(spark, str(tmp_path / "in"), rows[:25], rows[25:])
    history = K.prioritised(spark.read.schema(X.EVENT).parquet(where).withColumn("ts", K.F.col("ts").cast("timestamp")))
    warm = run(spark, K.account_memory(K.prioritised(X.event_stream(spark, later)), history, size=6), str(tmp_path / "o1"), str(tmp_path / "c1"))
    whole = run(spark, K.account_memory(K.prioritised(X.event_stream(spark, str(tmp_path / "in") + "/*")), size=6), str(tmp_path / "o2"), str(tmp_path / "c2"))
    weights, held, want = K.memory_weights(6), {}, {}
    for event, ts, user, kind, value, _ in rows:
        vector, last = held.get(user, (np.zeros(6), None))
        us = int(pd.Timestamp(ts).value // 1000)
        after = K.remembered(vector, last, kind, us, value, weights)
        held[user], want[event] = (after, us), after
    assert {r[0] for r in warm} == {r[0] for r in rows[25:]} and len(whole) == 40
    for r in warm + whole:
        assert r[3] == pytest.approx(list(want[r[0]])) and 0 <= r[2] <= 1
    assert np.abs(K.time_code(0.0, 4)).tolist() == [1.0] * 4 and K.time_code(50.0, 4).tolist() != K.time_code(60.0, 4).tolist()


def test_velocity_of_files_in_no_order_of_time(spark, tmp_path):
    """A stored table whose later file holds earlier events: none is dropped behind the watermark."""
    from riskweave.plans.registry import QUERIES

    rng = random.Random(9)
    rows = [(i, BASE + dt.timedelta(seconds=rng.randrange(40_000)), rng.randrange(3), "click", 1.0, "{}") for i in range(120)]
    rows.sort(key=lambda r: r[1])
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for part in (rows[60:], rows[:60]):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.event_id, r.user_id, r.velocity_1h, r.gap_seconds) for r in QUERIES["str_velocity"](spark, str(tmp_path)).collect())
    assert got == [(event, user, recent, gap) for event, user, _, recent, gap, _, _ in replayed(rows)]


def test_types_are_asked_for_once_a_call():
    """A hundred events of two types cost as many trips to the store as two do."""

    class Held:
        def __init__(self):
            self.values, self.trips = {}, 0

        def exists(self):
            return False

        def put(self, value):
            pass

        update = put

        def containsKey(self, key):  # noqa: N802
            self.trips += 1
            return key in self.values

        def getValue(self, key):  # noqa: N802
            self.trips += 1
            return self.values[key]

        def updateValue(self, key, value):  # noqa: N802
            self.trips += 1
            self.values[key] = value

    features = K.AccountFeatures()
    features.recent, features.total, features.types, features.ring = (Held() for _ in range(4))
    events = pd.DataFrame([(i, BASE + dt.timedelta(seconds=i), 1, "ab"[i % 2], 1.0, 1) for i in range(100)], columns=list(K.EVENT_COLUMNS))
    out = features._taken(K._in_order(iter([events])))
    assert [r[5] for r in out] == [True, True] + [False] * 98
    assert features.types.values == {("a",): (50,), ("b",): (50,)} and features.types.trips == 4
