"""Shortest-path dependencies from many sources at once, in blocks of accounts and chunks of sources.

Accounts are dealt into blocks by hash, and edges into cells of two blocks. What an
account holds of a chunk of sources is a row of a matrix (a block's accounts by the
chunk's sources), so an edge passes on a row of numbers, and what comes to a block is
added up before anything is shuffled. A task holds one block's matrix, the matrices
that come to it and their cells; chunks are so narrow that this stays near ROOM bytes
however many accounts there are; sources go in turns. Work grows with sources times edges at most: most of
the numbers of a level are 0, or go to places of another level, and are passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.operators.brandes import by_hash
from riskweave.operators.graph import cut

#: Edges of a cell, bytes that come to one task, and numbers added at a time.
CELL = 800_000
ROOM = 32 * 2**20
PIECE = 1_000_000
#: Bytes of the matrices of all blocks and of those sources that are gone through at a time.
TURN = 4 * 2**30
STATE = "b int, c int, dist binary, paths binary, part binary, at binary, kinds binary, codes binary, n long, left long"


def _wired(send: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A matrix to be sent: places of what isn't 0 (none: all stand there), and its numbers, as codes of 16 bits where there are few different ones."""
    flat = send.ravel()
    at = np.flatnonzero(flat).astype(np.int32)
    few = 2 * len(at) < len(flat)
    held = flat[at] if few else flat
    kinds, codes = np.unique(held, return_inverse=True)
    if len(kinds) > 2**16:
        kinds, codes = held, np.zeros(0)
    return at.tobytes() if few else b"", kinds.tobytes(), codes.astype(np.uint16).tobytes()


def _unwired(at: bytes, kinds: bytes, codes: bytes, rows: int, width: int) -> np.ndarray:
    held = np.frombuffer(kinds, float)
    held = held[np.frombuffer(codes, np.uint16)] if codes else held
    if not at and len(held):
        return held.reshape(rows, width)
    out = np.zeros(rows * width)
    out[np.frombuffer(at, np.int32)] = held
    return out.reshape(rows, width)


def _listed(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row how many columns are marked and from where on they stand in the list that is returned third."""
    n = marked.sum(axis=1)
    return n, np.cumsum(n) - n, np.nonzero(marked)[1]


def _added(out: np.ndarray, send: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> None:
    """Add to row end[i] of out row start[i] of send, in those places at least that are wanted; end is in order.

    Where few numbers aren't 0, or few places are wanted, those alone are looked at.
    """
    live = send != 0
    keep = live.any(axis=1)[start] & wanted.any(axis=1)[end]
    start, end = start[keep], end[keep]
    if not len(end):
        return
    pushed, pulled, whole = live.sum(axis=1)[start].sum(), wanted.sum(axis=1)[end].sum(), len(start) * send.shape[1]
    if 4 * min(pushed, pulled) < whole:
        by, marked = (start, live) if pushed < pulled else (end, wanted)
        n, first, columns = _listed(marked)
        upto = np.cumsum(n[by])
        flat, width = out.reshape(-1), send.shape[1]
        i = 0
        while i < len(by):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PIECE, "right")))
            some = n[by[i:j]]
            edge = np.repeat(np.arange(i, j), some)
            column = columns[np.arange(len(edge)) + np.repeat(first[by[i:j]] - np.cumsum(some) + some, some)]
            np.add.at(flat, end[edge].astype(np.int64) * width + column, send[start[edge], column])
            i = j
        return
    first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    for i, j in zip(first, np.r_[first[1:], len(end)], strict=True):
        for k in range(i, j, max(1, PIECE // send.shape[1])):
            out[end[i]] += send[start[k : min(j, k + max(1, PIECE // send.shape[1]))]].sum(axis=0)


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A cell's edges in order of their end, as two binaries."""
    rows = rows.sort_values(["end", "start"])
    return pd.DataFrame({"from_b": [key[0]], "b": [key[1]], "start": [rows["start"].to_numpy(np.int32).tobytes()], "end": [rows["end"].to_numpy(np.int32).tobytes()]})


def _noted(df: DataFrame, written: list[DataFrame]) -> DataFrame:
    written.append(cut(df))
    return written[-1]


def _cells(edges: DataFrame, written: list[DataFrame]) -> DataFrame:
    """edges (from_b, start, b, end) by pair of blocks."""
    return _noted(edges.groupBy("from_b", "b").applyInPandas(_packed, "from_b int, b int, start binary, end binary"), written)


def _row(b: int, c: int, dist: np.ndarray, paths: np.ndarray, part: np.ndarray, send: np.ndarray, n: int) -> pd.DataFrame:
    at, kinds, codes = _wired(send)
    return pd.DataFrame({"b": [b], "c": [c], "dist": [dist.tobytes()], "paths": [paths.tobytes()], "part": [part.tobytes()], "at": [at], "kinds": [kinds], "codes": [codes], "n": [n], "left": [int((dist < 0).sum())]})


def _stepped(state: DataFrame, cells: DataFrame, sizes: dict[int, int], widths: dict[int, int], at_level: int, taken, written: list[DataFrame]) -> DataFrame:
    """state after each block has taken in what others sent along cells; of what comes, places whose dist is at_level are wanted; taken(dist, paths, part, met) gives part, send and how many numbers are new, and may change what it is given."""
    parcels = state.where("n > 0").select(F.col("b").alias("from_b"), F.col("c").alias("for_c"), *[F.col(x).alias(f"sent_{x}") for x in ("at", "kinds", "codes")]).join(cells.withColumnRenamed("b", "for_b"), "from_b").select("for_b", "for_c", "from_b", "sent_at", "sent_kinds", "sent_codes", "start", "end")

    def run(key, mine: pd.DataFrame, parcels: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({k.split()[0]: [] for k in STATE.split(", ")})
        width = widths[int(mine["c"].iloc[0])]
        number = lambda c, kind: np.frombuffer(mine[c].iloc[0], kind).reshape(-1, width).copy()
        dist, paths, part = number("dist", np.int16), number("paths", float), number("part", float)
        met, wanted = np.zeros_like(paths), dist == at_level
        if wanted.any():
            for p in parcels.itertuples(index=False):
                _added(met, _unwired(p.sent_at, p.sent_kinds, p.sent_codes, sizes[p.from_b], width), np.frombuffer(p.start, np.int32), np.frombuffer(p.end, np.int32), wanted)
        part, send, n = taken(dist, paths, part, met)
        return _row(int(mine["b"].iloc[0]), int(mine["c"].iloc[0]), dist, paths, part, send, n)

    return _noted(state.groupBy("b", "c").cogroup(parcels.groupBy("for_b", "for_c")).applyInPandas(run, STATE), written)


def _outward(level: int):
    """Rows met for the first time are `level` steps away, by as many paths as came."""

    def taken(dist, paths, part, met):
        new = (dist < 0) & (met > 0)
        dist[new], paths[new] = level, met[new]
        return part, np.where(new, met, 0.0), int(new.sum())

    return taken


def _homeward(level: int):
    """Rows `level` steps away take their share of what lies behind them, and send theirs."""

    def taken(dist, paths, part, met):
        here = dist == level
        part[here] = (paths * met)[here]
        return part, np.where(here, (1 + part) / np.where(here, paths, 1.0), 0.0), int(here.sum())

    return taken


def dependencies(steps: DataFrame, nodes: DataFrame, sources: DataFrame, edges: int, written: list[DataFrame]) -> DataFrame:
    """account, part: the sum over sources (account) of what shortest paths from them depend on an account; steps are distinct u, v without loops, as many as edges says. written gets what is written on the way."""
    spark = steps.sparkSession
    blocks = max(1, math.ceil(math.sqrt(edges / CELL)))
    block = F.pmod(F.xxhash64("account"), F.lit(blocks)).cast("int")
    place = (F.row_number().over(W.partitionBy("b").orderBy("account")) - 1).cast("int")
    placed = _noted(nodes.select("account", block.alias("b")).withColumn("i", place), written)
    sizes = {r["b"]: r["n"] for r in placed.groupBy("b").agg(F.count("*").alias("n")).collect()}  # a row a block
    drawn = [(r["b"], r["i"]) for r in placed.join(F.broadcast(sources), "account").orderBy("account").select("b", "i").collect()]  # the sources alone
    width = max(1, min(len(drawn), ROOM // 8 // max(1, sum(sizes.values()))))
    chunks = {c: drawn[at : at + width] for c, at in enumerate(range(0, len(drawn), width))}
    widths = {c: len(x) for c, x in chunks.items()}

    def begun(batches):
        for batch in batches:
            for b, c in zip(batch["b"], batch["c"], strict=True):
                paths = np.zeros((sizes[b], widths[c]))
                for k, (at, i) in enumerate(chunks[c]):
                    if at == b:
                        paths[i, k] = 1.0
                dist = np.where(paths > 0, 0, -1).astype(np.int16)
                yield _row(b, c, dist, paths, np.zeros_like(paths), paths, int(paths.sum()))

    grid = spark.createDataFrame([(b, c) for b in sizes for c in chunks], "b int, c int").repartition(max(1, min(len(sizes) * len(chunks), 64)))
    state = _noted(grid.mapInPandas(begun, STATE), written)
    at = lambda x, names: placed.select(F.col("account").alias(x), F.col("b").alias(names[0]), F.col("i").alias(names[1]))
    both = _noted(steps.join(at("u", ("bu", "iu")), "u").join(at("v", ("bv", "iv")), "v").select("bu", "iu", "bv", "iv"), written)
    there, back = _cells(both.toDF("from_b", "start", "b", "end"), written), _cells(both.select("bv", "iv", "bu", "iu").toDF("from_b", "start", "b", "end"), written)
    level = 0
    while True:
        further = _stepped(state, there, sizes, widths, -1, _outward(level + 1), written)
        new, left = further.agg(F.sum("n"), F.sum("left")).first()
        if not new:
            break
        state, level = further, level + 1
        if not left:
            break
    # The deepest rows have nothing behind them: what state sent on last was met by none.
    state = _stepped(state.withColumn("n", F.lit(0).cast("long")), back, sizes, widths, level, _homeward(level), written) if level else state
    for here in range(level - 1, 0, -1):
        state = _stepped(state, back, sizes, widths, here, _homeward(here), written)

    def summed(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                total = np.where(np.frombuffer(row.dist, np.int16).reshape(-1, widths[row.c]) > 0, np.frombuffer(row.part, float).reshape(-1, widths[row.c]), 0.0).sum(axis=1)
                yield pd.DataFrame({"b": np.full(len(total), row.b, np.int32), "i": np.arange(len(total), dtype=np.int32), "part": total})

    sums = state.select("b", "c", "dist", "part").mapInPandas(summed, "b int, i int, part double").groupBy("b", "i").agg(F.sum("part").alias("part"))
    return placed.join(sums, ["b", "i"]).select("account", "part")


def in_turns(steps: DataFrame, nodes: DataFrame, sources: int, edges: int) -> DataFrame:
    """account, part of the first sources (by hash); so many go at a time that their matrices take TURN bytes, and what a turn has written goes with its end."""
    spark = steps.sparkSession
    placed = cut(by_hash(nodes))
    n = placed.count()
    each = max(1, TURN // (18 * max(1, n)))
    found = []
    for at in range(0, max(1, min(sources, n)), each):
        written: list[DataFrame] = []
        some = placed.where(F.col("i").between(at, min(at + each, sources) - 1)).select("account")
        found.append(cut(dependencies(steps, nodes, some, edges, written)))
        for folder in {f.rsplit("/", 1)[0] for df in written for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if len(found) == 16:
            found = [cut(_total(found))]
    return _total(found)


def _total(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("account").agg(F.sum("part").alias("part"))
