"""Shortest-path dependencies of each source by itself, in tasks that hold the whole graph.

A task gets the graph as lists of partners, 8 bytes an edge for both directions, and
its share of the sources. One source needs a few numbers an account, which the next
one uses again, so a task's memory grows with the edges and not with the sources. Each
step of depth looks along edges from where they begin or from where they end,
whichever are fewer. Graphs of more edges than a task holds go by operators/shortest.py.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.operators.graph import cut

#: Edges that a task holds at most: 8 bytes each, twice while they are put in one list.
WHOLE = 40_000_000
#: Edges of a packed slice, of edges times sources what a task should have at least and at most, and tasks at most (or four a core).
SLICE = 1_000_000
LEAST = 100_000_000
MOST = 2_000_000_000
TASKS = 64


def by_hash(nodes: DataFrame) -> DataFrame:
    """account, i: numbers from 0 in order of hash, counted in 256 parts."""
    parts = nodes.select("account", F.xxhash64("account").alias("_h")).withColumn("_p", F.shiftright("_h", 56))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n")).select(F.col("_p").alias("_q"), (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_ahead"))  # 256 rows
    inside = F.row_number().over(W.partitionBy("_p").orderBy("_h", "account")) - 1
    return parts.withColumn("_i", inside).join(F.broadcast(sizes), F.col("_p") == F.col("_q")).select("account", (F.col("_i") + F.col("_ahead")).cast("int").alias("i"))


def _lists(rows: pa.Table, kind: int, n: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each account's list begins (and the last ends), and the lists one after another."""
    counts, found = np.zeros(n + 1, np.int64), {}
    for k, s, held, to in zip(*(rows[c] for c in ("kind", "s", "counts", "to")), strict=True):
        if k.as_py() == kind:
            found[s.as_py()] = np.frombuffer(to.as_buffer(), np.int32)
            part = np.frombuffer(held.as_buffer(), np.int32)
            counts[s.as_py() * per + 1 : s.as_py() * per + 1 + len(part)] = part
    return np.cumsum(counts), np.concatenate([found[s] for s in sorted(found)]) if found else np.zeros(0, np.int32)


def _along(begin: np.ndarray, to: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of rows one after another, and how long each is."""
    n = begin[rows + 1] - begin[rows]
    upto = np.cumsum(n)
    return to[np.repeat(begin[rows] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)], n


def _pulled(begin: np.ndarray, to: np.ndarray, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each of rows the sum of what is held at the ends of its list."""
    at, n = _along(begin, to, rows)
    out, some = np.zeros(len(rows)), n > 0
    if len(at):
        out[some] = np.add.reduceat(held[at], (np.cumsum(n) - n)[some])
    return out


def _pushed(begin: np.ndarray, to: np.ndarray, rows: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each account the sum of what is held at those rows in whose list it stands."""
    at, n = _along(begin, to, rows)
    return np.bincount(at, weights=np.repeat(held[rows], n), minlength=len(held))


def add_dependencies(total: np.ndarray, source: int, ahead: tuple[np.ndarray, np.ndarray], back: tuple[np.ndarray, np.ndarray], room: np.ndarray) -> None:
    """Add to total what shortest paths from source depend on each account. ahead, back: lists of partners along and against edges, of lengths that room[0] and room[1] hold; room[2:5] are used."""
    out, into, paths, held, part = room
    paths[:], part[:] = 0.0, 0.0
    paths[source] = 1.0
    levels, unseen = [np.array([source])], None
    while True:
        here = levels[-1]
        unseen = np.flatnonzero(paths == 0) if unseen is None else unseen[paths[unseen] == 0]
        if not len(unseen):
            break
        if out[here].sum() <= into[unseen].sum():
            ways = _pushed(*ahead, here, paths)[unseen]
        else:
            held[here] = paths[here]
            ways = _pulled(*back, unseen, held)
            held[here] = 0.0
        new = ways > 0
        if not new.any():
            break
        levels.append(unseen[new])
        paths[levels[-1]] = ways[new]
    for here, behind in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        held[behind] = (1 + part[behind]) / paths[behind]
        met = _pulled(*ahead, here, held) if out[here].sum() <= into[behind].sum() else _pushed(*back, behind, held)[here]
        held[behind] = 0.0
        part[here] = paths[here] * met
        total[here] += part[here]


def dependencies(steps: DataFrame, nodes: DataFrame, sources: int, edges: int) -> DataFrame:
    """account, part: the sum over the first sources (by hash) of what shortest paths from them depend on an account; steps are distinct u, v without loops, as many as edges says."""
    spark = steps.sparkSession
    placed = cut(by_hash(nodes))
    n = placed.count()
    per = max(1, math.ceil(n / max(1, math.ceil(edges / SLICE))))
    at = lambda x: placed.select(F.col("account").alias(x), F.col("i").alias(f"i{x}"))
    ends = F.array(F.struct(F.lit(0).alias("kind"), F.col("iu").alias("at"), F.col("iv").alias("to")), F.struct(F.lit(1).alias("kind"), F.col("iv").alias("at"), F.col("iu").alias("to")))
    both = steps.join(at("u"), "u").join(at("v"), "v").select(F.inline(ends)).withColumn("s", F.floor(F.col("at") / per).cast("int"))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        kind, s = (k.as_py() for k in key)
        begin, to = rows["at"].to_numpy(), rows["to"].to_numpy()
        order = np.argsort(begin.astype(np.int64) * n + to)
        counts = np.bincount(begin - s * per, minlength=min(per, n - s * per)).astype(np.int32)
        return pa.table({"kind": pa.array([kind], pa.int32()), "s": pa.array([s], pa.int32()), "counts": [counts.tobytes()], "to": [to[order].astype(np.int32).tobytes()]})

    lists = cut(both.groupBy("kind", "s").applyInArrow(packed, "kind int, s int, counts binary, to binary"))
    sources = min(sources, n)
    cores, work = spark.sparkContext.defaultParallelism, edges * sources
    tasks = max(1, min(sources, max(TASKS, 4 * cores), max(math.ceil(work / MOST), min(cores, math.ceil(work / LEAST)))))
    # Keys that lie in a partition each.
    keys = spark.range(64 * tasks).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    keys = [r["id"] for r in keys] + list(range(64 * tasks, 65 * tasks - len(keys)))
    turn = {key: i for i, key in enumerate(keys)}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        mine = turn[key[0].as_py()]
        ahead, back = (_lists(rows, kind, n, per) for kind in (0, 1))
        del rows
        total, room = np.zeros(n), [np.diff(ahead[0]), np.diff(back[0]), *np.zeros((3, n))]
        for source in range(mine, sources, tasks):
            add_dependencies(total, source, ahead, back, room)
        some = np.flatnonzero(total)
        return pa.table({"i": pa.array(some.astype(np.int32)), "part": pa.array(total[some])})

    dealt = lists.withColumn("key", F.explode(F.array(*[F.lit(k).cast("long") for k in keys]))).repartition(tasks, "key")
    sums = dealt.groupBy("key").applyInArrow(run, "i int, part double").groupBy("i").agg(F.sum("part").alias("part"))
    return placed.join(sums, "i", "left").select("account", F.coalesce("part", F.lit(0.0)).alias("part"))
