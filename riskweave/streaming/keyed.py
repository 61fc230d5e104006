"""State by account: features of each event, the last events for who joins late, and a memory vector that is told onwards.

State comes in named variables that Spark keeps, checkpoints and expires. History may
fill them before the first event (a warm start); injected events pass ahead of those
of the regular source in the batch that has both. Within a batch events of an account
are taken in order of priority, time and id, so that a replay gives the same rows.
The session needs the RocksDB state store (use_state_store).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
RING = 20
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def prioritised(regular: DataFrame, injected: DataFrame | None = None) -> DataFrame:
    """Both sources as one stream (of the columns of regular), with priority 0 for what was injected and 1 for the rest."""
    out = regular.withColumn("priority", F.lit(1))
    return out if injected is None else injected.select(*regular.columns).withColumn("priority", F.lit(0)).union(out)


def _in_order(frames: Iterator[pd.DataFrame]) -> list:
    rows = [row for frame in frames for row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda r: (r.priority, r.ts, r.event_id))


class AccountFeatures(StatefulProcessor):
    """Variables: recent (times within the hour), total (events, first and last time), types (event types met, with how often), ring (the last RING events)."""

    def __init__(self, ttl_days: int | None = None):
        self.ttl = ttl_days * 86_400_000 if ttl_days else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        expires = {"ttlDurationMs": self.ttl} if self.ttl else {}
        self.recent = handle.getListState("recent", "us long", **expires)
        self.total = handle.getValueState("total", "n long, first long, last long", **expires)
        self.types = handle.getMapState("types", "event_type string", "n long", **expires)
        self.ring = handle.getListState("ring", "event_id long, us long, event_type string, value double", **expires)

    def _taken(self, rows: list) -> list[tuple]:
        """Features of each row; the variables go on from what they are."""
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        n, first, last = self.total.get() if self.total.exists() else (0, None, None)
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        # Each type met is asked for and written once a call, not once a row: each is a trip to the store.
        met = {}
        for kind in {r.event_type for r in rows}:
            met[kind] = self.types.getValue((kind,))[0] if self.types.containsKey((kind,)) else 0
        out = []
        for r in rows:
            us = int(pd.Timestamp(r.ts).value // 1000)
            new = not met[r.event_type]
            met[r.event_type] += 1
            recent = [t for t in recent if t >= us - HOUR] + [us]
            gap = max(0.0, (us - last) / 1e6) if last is not None else 0.0
            n, first, last = n + 1, us if first is None else min(first, us), us if last is None else max(last, us)
            ring = (ring + [(r.event_id, us, r.event_type, r.value)])[-RING:]
            out.append((r.event_id, r.user_id, n, len(recent), gap, new, (last - first) / 1e6))
        if rows:
            self.recent.put([(t,) for t in recent])
            self.total.update((n, first, last))
            self.ring.put(ring)
            for kind, times in met.items():
                self.types.updateValue((kind,), (times,))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame(self._taken(_in_order(rows)), columns=["event_id", "user_id", "n_events", "velocity_1h", "gap_seconds", "new_type", "age_seconds"])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._taken(_in_order(iter([initialState])))

    def close(self) -> None:
        pass


FEATURES = "event_id long, user_id long, n_events long, velocity_1h long, gap_seconds double, new_type boolean, age_seconds double"
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "priority")


def account_features(stream: DataFrame, history: DataFrame | None = None, *, ttl_days: int | None = None) -> DataFrame:
    """FEATURES of each event of a prioritised stream; history (batch, the same columns) is what the accounts did before."""
    known = history.select(*EVENT_COLUMNS).groupBy("user_id") if history is not None else None
    return stream.select(*EVENT_COLUMNS).groupBy("user_id").transformWithStateInPandas(AccountFeatures(ttl_days), FEATURES, "append", "processingTime" if ttl_days else "none", initialState=known)


def last_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """user_id and the last RING events of each account, out of the state of a stream: what a late listener is given first."""
    held = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return held.select(F.col("key.user_id").alias("user_id"), "list_element.*")


# Temporal memory


def time_code(seconds: float, size: int) -> np.ndarray:
    """Cosines of a time span at spread-out rates."""
    return np.cos(seconds * 10.0 ** (-np.arange(size) * 9 / max(1, size - 1) / 1.0))


def memory_weights(size: int, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights of the gated update, drawn from a seed: inputs are the partner's message, its time code and the amount."""
    rng = np.random.Generator(np.random.PCG64(seed))
    width = 2 * size + 1
    return {g: rng.normal(0, 1 / math.sqrt(width), (width + size, size)) for g in ("reset", "keep", "new")}


def gated(memory: np.ndarray, message: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """One step of a gated recurrent unit."""
    squash = lambda x: 1 / (1 + np.exp(-x))
    both = np.concatenate([message, memory])
    reset, keep = squash(both @ weights["reset"]), squash(both @ weights["keep"])
    new = np.tanh(np.concatenate([message, reset * memory]) @ weights["new"])
    return keep * memory + (1 - keep) * new


def remembered(memory: np.ndarray, last: int | None, event_type: str, us: int, value: float, weights: dict[str, np.ndarray]) -> np.ndarray:
    """An account's memory after an event: its kind (a vector by hash), the time since the one before, and its size."""
    size = len(memory)
    kind = np.random.Generator(np.random.PCG64(sum(ord(c) * 257**i for i, c in enumerate(event_type)) % 2**32)).normal(0, 1, size)
    code = time_code(0.0 if last is None else max(0, us - last) / 1e6, size)
    return gated(memory, np.concatenate([kind, code, [math.log1p(max(0.0, value)) / 10]]), weights)


class AccountMemory(StatefulProcessor):
    """Variable memory: the account's vector and the time of its last event."""

    def __init__(self, size: int = 16, seed: int = 42):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "vector array<double>, last long")
        self.weights = memory_weights(self.size, self.seed)

    def _told(self, rows: list) -> list[tuple]:
        held = self.memory.get() if self.memory.exists() else None
        vector, last = (np.array(held[0]), held[1]) if held is not None else (np.zeros(self.size), None)
        out = []
        for r in rows:
            us = int(pd.Timestamp(r.ts).value // 1000)
            after = remembered(vector, last, r.event_type, us, r.value, self.weights)
            norm = float(np.linalg.norm(vector) * np.linalg.norm(after))
            drift = float(np.clip((1 - vector @ after / norm) / 2, 0, 1)) if norm > 0 else 1.0
            vector, last = after, us if last is None else max(last, us)
            out.append((r.event_id, r.user_id, drift, vector.tolist()))
        if rows:
            self.memory.update((vector.tolist(), last))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame(self._told(_in_order(rows)), columns=["event_id", "user_id", "drift", "memory"])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self._told(_in_order(iter([initialState])))

    def close(self) -> None:
        pass


MEMORY = "event_id long, user_id long, drift double, memory array<double>"


def account_memory(stream: DataFrame, history: DataFrame | None = None, *, size: int = 16, seed: int = 42) -> DataFrame:
    """event_id, user_id, drift (half the cosine distance that the event moved the account's memory, 1 for its first) and memory."""
    known = history.select(*EVENT_COLUMNS).groupBy("user_id") if history is not None else None
    return stream.select(*EVENT_COLUMNS).groupBy("user_id").transformWithStateInPandas(AccountMemory(size, seed), MEMORY, "append", "none", initialState=known)
