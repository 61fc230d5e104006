"""Small neural networks trained by Spark: an autoencoder, and embeddings of accounts from their partners.

Weights are on the driver alone (some ten thousand numbers). Each step sends them to
the tasks, which run over the rows of one mini-batch, told by hash, and send back one
sum of gradients a partition; where there are many partitions their sums are added up
in a second stage. Rows lie in a table that is written once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.operators.graph import cut

Weights = list[np.ndarray]
#: Sums of gradients that the driver takes in one step; more partitions are added up by tasks first.
WIDE = 32


def drawn_weights(shapes: list[tuple[int, ...]], seed: int) -> Weights:
    """Normal matrices scaled by their inputs, and zero vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [rng.normal(0, math.sqrt(2 / s[0]), s) if len(s) > 1 else np.zeros(s) for s in shapes]


class Adam:
    def __init__(self, weights: Weights, rate: float):
        self.rate, self.turn = rate, 0
        self.m, self.v = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def step(self, weights: Weights, gradients: Weights) -> Weights:
        self.turn += 1
        out = []
        for i, (w, g) in enumerate(zip(weights, gradients, strict=True)):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            out.append(w - self.rate * (self.m[i] / (1 - 0.9**self.turn)) / (np.sqrt(self.v[i] / (1 - 0.999**self.turn)) + 1e-8))
        return out


def summed_gradients(rows: DataFrame, weights: Weights, gradient: Callable[[Weights, pd.DataFrame], tuple[float, Weights]]) -> tuple[float, int, Weights]:
    """Loss, rows and gradients summed over all rows; gradient gives those of a batch."""

    def run(batches):
        total, loss, n = None, 0.0, 0
        for batch in batches:
            if len(batch):
                part, grads = gradient(weights, batch)
                flat = np.concatenate([g.ravel() for g in grads])
                total, loss, n = flat if total is None else total + flat, loss + part, n + len(batch)
        if total is not None:
            yield pd.DataFrame({"loss": [loss], "n": [n], "g": [total]})

    def added(batches):
        total, loss, n = None, 0.0, 0
        for batch in batches:
            for row in batch.itertuples():
                total, loss, n = np.array(row.g) if total is None else total + row.g, loss + row.loss, n + row.n
        if total is not None:
            yield pd.DataFrame({"loss": [loss], "n": [n], "g": [total]})

    schema = "loss double, n long, g array<double>"
    sums = rows.mapInPandas(run, schema)
    if rows.sparkSession.sparkContext.defaultParallelism > WIDE or len(rows.inputFiles()) > WIDE:
        sums = sums.repartition(WIDE // 2).mapInPandas(added, schema)
    met = sums.collect()
    if not met:
        return 0.0, 0, [np.zeros_like(w) for w in weights]
    flat, out, at = sum(np.array(r["g"]) for r in met), [], 0
    for w in weights:
        out.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return sum(r["loss"] for r in met), sum(r["n"] for r in met), out


def stepped(step: Callable[[int, Weights], tuple[float, int, Weights]], weights: Weights, *, epochs: int, batches: int, rate: float) -> tuple[Weights, list[float]]:
    """Weights after epochs over mini-batches, of which step(batch, weights) gives loss, rows and sums of gradients, and the mean loss of each epoch."""
    adam, losses = Adam(weights, rate), []
    for _ in range(epochs):
        loss, n = 0.0, 0
        for b in range(batches):
            one, m, grads = step(b, weights)
            if m:
                weights = adam.step(weights, [g / m for g in grads])
                loss, n = loss + one, n + m
        losses.append(loss / max(1, n))
    return weights, losses


def dealt(key: str, batches: int, seed: int) -> Column:
    """The mini-batch of a row, by hash of key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches))


def trained(rows: DataFrame, weights: Weights, gradient, *, key: str, epochs: int, batches: int, rate: float, seed: int) -> tuple[Weights, list[float]]:
    """Weights after epochs over mini-batches of rows (by hash of key), and the mean loss of each epoch."""
    held = cut(rows.withColumn("_batch", dealt(key, batches, seed)))
    return stepped(lambda b, weights: summed_gradients(held.where(F.col("_batch") == b), weights, gradient), weights, epochs=epochs, batches=batches, rate=rate)


# Autoencoder


def _through(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """Activations of the layers; all but the code and the last are rectified."""
    acts, layers = [x], len(weights) // 2
    for i in range(layers):
        z = acts[-1] @ weights[2 * i] + weights[2 * i + 1]
        acts.append(z if i in (layers // 2 - 1, layers - 1) else np.maximum(z, 0))
    return acts


def _autoencoder_gradient(weights: Weights, batch: pd.DataFrame) -> tuple[float, Weights]:
    acts = _through(weights, np.array(batch["x"].tolist(), float))
    layers, out = len(weights) // 2, [None] * len(weights)
    diff = acts[-1] - acts[0]
    loss, d = float((diff**2).mean(axis=1).sum()), 2 * diff / diff.shape[1]
    for i in reversed(range(layers)):
        if i not in (layers // 2 - 1, layers - 1):
            d = d * (acts[i + 1] > 0)
        out[2 * i], out[2 * i + 1] = acts[i].T @ d, d.sum(axis=0)
        d = d @ weights[2 * i].T
    return loss, out


class Autoencoder:
    """Columns to hidden to code and back, by mini-batch Adam on squared error; columns are to be standardised. Nulls count as 0."""

    def __init__(self, columns: list[str], *, hidden: int = 32, code: int = 16, epochs: int = 50, batches: int = 4, rate: float = 1e-3, seed: int = 42):
        self.columns, self.hidden, self.code = columns, hidden, code
        self.training = {"epochs": epochs, "batches": batches, "rate": rate, "seed": seed}

    def _vector(self) -> Column:
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])

    def fit(self, df: DataFrame, key: str) -> Autoencoder:
        n = len(self.columns)
        sizes = [n, self.hidden, self.code, self.hidden, n]
        shapes = [s for a, b in zip(sizes, sizes[1:], strict=False) for s in ((a, b), (b,))]
        rows = df.select(F.col(key).alias("_key"), self._vector().alias("x"))
        self.weights, self.losses = trained(rows, drawn_weights(shapes, self.training["seed"]), _autoencoder_gradient, key="_key", **self.training)
        return self

    def score(self, df: DataFrame, drivers: int = 3) -> DataFrame:
        """df with mse and drivers: a row's mean squared error and the columns it is largest at."""
        weights, columns = self.weights, self.columns

        @F.pandas_udf("struct<mse:double,drivers:array<string>>")
        def errors(x: pd.Series) -> pd.DataFrame:
            data = np.array(x.tolist(), float).reshape(len(x), len(columns))
            loss = (_through(weights, data)[-1] - data) ** 2
            worst = np.argsort(-loss, axis=1, kind="stable")[:, :drivers]
            return pd.DataFrame({"mse": loss.mean(axis=1), "drivers": [[columns[i] for i in row] for row in worst]})

        return df.withColumn("_e", errors(self._vector())).select(*df.columns, F.col("_e.mse").alias("mse"), F.col("_e.drivers").alias("drivers"))


# Embeddings of accounts


def node_features(features: DataFrame, columns: list[str], *, marks: int = 16, seed: int = 42) -> DataFrame:
    """account, x: columns standardised over accounts (nulls are 0; a constant column stays 0), and `marks` numbers drawn by the account's hash, by which partners tell it apart."""
    stats = features.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns])
    scaled = [F.coalesce((F.col(c).cast("double") - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(F.lit(1.0)), F.lit(0.0)) for c in columns]
    drawn = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "account"), F.lit(2_000_003)) / 1_000_001.5 - 1 for i in range(marks)]
    return features.join(F.broadcast(stats)).select("account", F.array(*scaled, *drawn).alias("x"))  # stats is one row


def sampled_partners(edges: DataFrame, *, partners: int, seed: int) -> DataFrame:
    """account, partner: up to so many partners of each account, either way, the first by hash. A hub's partners are ranked in shares first."""
    both = edges.where(F.col("u") != F.col("v")).select(F.col("u").alias("account"), F.col("v").alias("partner"))
    both = both.union(both.select("partner", "account")).distinct().withColumn("_h", F.xxhash64(F.lit(seed), "account", "partner"))
    share = W.partitionBy("account", F.pmod(F.col("_h"), F.lit(64))).orderBy("_h", "partner")
    few = both.withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= partners)
    rank = F.row_number().over(W.partitionBy("account").orderBy("_h", "partner"))
    return few.withColumn("_r", rank).where(F.col("_r") <= partners).select("account", "partner")


def _neighbourhoods(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """account, own and others: an account's features beside the mean of its partners', and the same of its drawn partners."""
    first = nodes.first()
    width = len(first["x"]) if first else 0
    beside = near.join(nodes.select(F.col("account").alias("partner"), "x"), "partner")
    means = beside.groupBy("account").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).cast("array<double>").alias("mean"))
    own = cut(nodes.join(means, "account", "left").select("account", F.concat("x", F.coalesce("mean", F.array_repeat(F.lit(0.0), width))).alias("own")))
    others = near.join(own.select(F.col("account").alias("partner"), F.col("own").alias("other")), "partner").groupBy("account").agg(F.collect_list("other").alias("others"))
    return cut(own.join(others, "account", "left").select("account", "own", F.coalesce("others", F.array().cast("array<array<double>>")).alias("others")))


def _flat(others: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Partners' rows in one table, and how many each account has."""
    flat = np.array([y for x in others for y in x], float).reshape(-1, width)
    return flat, np.array([len(x) for x in others], np.int32)


def _encoded(weights: Weights, own: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """z and what is needed to go back: hidden layers of accounts and of their partners (in one table, with whose they are), and the second layer's inputs."""
    w1, b1, w2, b2 = weights
    of = np.repeat(np.arange(len(own)), counts)
    h, g = np.maximum(own @ w1 + b1, 0), np.maximum(flat @ w1 + b1, 0)
    n = np.maximum(counts, 1)[:, None]
    mean = _gathered(of, g, len(own)) / n
    c = np.concatenate([h, mean], axis=1)
    return c @ w2 + b2, c, h, g, of, n


def _gathered(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values that go to each row of a matrix."""
    return np.stack([np.bincount(at, weights=values[:, k], minlength=size) for k in range(values.shape[1])], axis=1) if len(at) else np.zeros((size, values.shape[1]))


# Pairs of accounts lie in cells of two blocks, by their places there; a block's vectors are one
# matrix, which goes to its cells, and sums of gradients come back in slices of accounts.

#: Pairs of a mini-batch in a cell, accounts of a slice, bytes of a block's vectors, pairs that are looked at together.
CELL = 1_000_000
SLICE = 4096
ROOM = 64 * 2**20
PIECE = 200_000


def _packed_slice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("i")
    own = np.array(rows["own"].tolist(), float)
    flat, counts = _flat(rows["others"], own.shape[1])
    return pd.DataFrame({"b": [key[0]], "s": [key[1]], "own": [own.tobytes()], "others": [flat.tobytes()], "counts": [counts.tobytes()]})


def _packed_cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ia", "ib"])
    packed = {c: [rows[c].to_numpy(np.int32).tobytes()] for c in ("ia", "ib")}
    return pd.DataFrame({"_batch": [key[0]], "ba": [key[1]], "bb": [key[2]], **packed, "y": [rows["y"].to_numpy(np.int8).tobytes()], "n": [len(rows)]})


def _unpacked(row, width: int) -> tuple[np.ndarray, ...]:
    number = lambda x: np.frombuffer(x, float).reshape(-1, width)
    return number(row.own), number(row.others), np.frombuffer(row.counts, np.int32)


def _cell_gradient(za: np.ndarray, zb: np.ndarray, ia: np.ndarray, ib: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss of links (y) between accounts at ia and ib, and its gradients by their vectors."""
    loss, da, db = 0.0, np.zeros_like(za), np.zeros_like(zb)
    for at in range(0, len(y), PIECE):
        i, j, t = ia[at : at + PIECE], ib[at : at + PIECE], y[at : at + PIECE].astype(float)
        a, b = za[i], zb[j]
        p = 1 / (1 + np.exp(-np.clip((a * b).sum(axis=1), -30, 30)))
        loss += float(-(t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12)).sum())
        d = (p - t)[:, None]
        da += _gathered(i, d * b, len(da))
        db += _gathered(j, d * a, len(db))
    return loss, da, db


def _back(weights: Weights, own: np.ndarray, flat: np.ndarray, counts: np.ndarray, encoded: tuple, dz: np.ndarray) -> Weights:
    """Gradients of the weights, where dz are those of accounts' vectors."""
    w1, _, w2, _ = weights
    _, c, h, g, of, n = encoded
    dc = dz @ w2.T
    dh, dg = dc[:, : w1.shape[1]] * (h > 0), (dc[:, w1.shape[1] :] / n)[of] * (g > 0)
    return [own.T @ dh + flat.T @ dg, dh.sum(axis=0) + dg.sum(axis=0), c.T @ dz, dz.sum(axis=0)]


def _link_gradient(weights: Weights, batch: pd.DataFrame) -> tuple[float, Weights]:
    """Logistic loss of links (y) between encoded accounts a and b, each pair with its accounts' neighbourhoods beside it, and its gradients."""
    sides = []
    for s in "ab":
        own = np.array(batch[f"own_{s}"].tolist(), float)
        held = own, *_flat(batch[f"others_{s}"], own.shape[1])
        sides.append((held, _encoded(weights, *held)))
    at = np.arange(len(batch))
    loss, *dz = _cell_gradient(sides[0][1][0], sides[1][1][0], at, at, batch["y"].to_numpy())
    parts = [_back(weights, *held, encoded, d) for (held, encoded), d in zip(sides, dz, strict=True)]
    return loss, [a + b for a, b in zip(*parts, strict=True)]


def _link_gradients(slices: DataFrame, cells: DataFrame, weights: Weights) -> tuple[float, Weights]:
    """Loss and gradients summed over the pairs of cells. Each account is encoded once and gone back through once, however many pairs it has."""
    width, size = weights[0].shape[0], weights[3].size

    def vectors(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"b": [row.b], "s": [row.s], "z": [_encoded(weights, *_unpacked(row, width))[0].tobytes()]})

    def joined(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [key[0]], "z": [b"".join(rows.sort_values("s")["z"])]})

    blocks = cut(slices.mapInPandas(vectors, "b int, s int, z binary").groupBy("b").applyInPandas(joined, "b int, z binary"))
    side = lambda x: blocks.select(F.col("b").alias(f"b{x}"), F.col("z").alias(f"z{x}")).hint("merge")

    def compared(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                za, zb = (np.frombuffer(z, float).reshape(-1, size) for z in (row.za, row.zb))
                loss, *both = _cell_gradient(za, zb, np.frombuffer(row.ia, np.int32), np.frombuffer(row.ib, np.int32), np.frombuffer(row.y, np.int8))
                for b, d in zip((row.ba, row.bb), both, strict=True):
                    for s in range(math.ceil(len(d) / SLICE)):
                        yield pd.DataFrame({"b": [b], "s": [s], "d": [d[s * SLICE : (s + 1) * SLICE].tobytes()], "loss": [loss]})
                        loss = 0.0

    def added(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [key[0]], "s": [key[1]], "d": [sum(np.frombuffer(d, float) for d in rows["d"]).tobytes()], "loss": [rows["loss"].sum()]})

    met = cells.join(side("a"), "ba").join(side("b"), "bb").mapInPandas(compared, "b int, s int, d binary, loss double")
    met = met.groupBy("b", "s").applyInPandas(added, "b int, s int, d binary, loss double")

    def gradient(weights: Weights, batch: pd.DataFrame) -> tuple[float, Weights]:
        out = [np.zeros_like(w) for w in weights]
        for row in batch.itertuples(index=False):
            held = _unpacked(row, width)
            for o, d in zip(out, _back(weights, *held, _encoded(weights, *held), np.frombuffer(row.d, float).reshape(-1, size)), strict=True):
                o += d
        return float(batch["loss"].sum()), out

    loss, _, grads = summed_gradients(slices.join(met.hint("merge"), ["b", "s"]), weights, gradient)
    return loss, grads


class PartnerEmbeddings:
    """Embeddings of accounts in two layers of partners' means, trained to tell links from pairs drawn by hash.

    A layer takes an account's own values and the mean of (drawn) partners'; the link
    score of two accounts is the product of their vectors. Joins lay each account's two
    rings of partners into one row, once; a training step encodes each account, looks at
    pairs by their accounts' places in blocks, and goes back through each account.
    """

    def __init__(self, *, hidden: int = 32, size: int = 16, partners: int = 8, epochs: int = 12, batches: int = 2, rate: float = 0.01, seed: int = 42):
        self.hidden, self.size, self.partners, self.seed = hidden, size, partners, seed
        self.training = {"epochs": epochs, "batches": batches, "rate": rate, "seed": seed}
        self._last = None

    def fit(self, nodes: DataFrame, edges: DataFrame) -> PartnerEmbeddings:
        """nodes: account, x; edges: u, v."""
        pairs = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        pairs = cut(pairs.withColumn("_key", F.xxhash64("a", "b")))
        around = self._around(nodes, edges)
        # The other end of a pair that is no link: accounts are numbered by hash, and each pair takes one by its own hash.
        ids = numbered(nodes.select("account"), self.seed)
        n = ids.count()
        false = pairs.select("a", F.pmod(F.xxhash64(F.lit(self.seed), "_key"), F.lit(max(1, n))).alias("i"), "_key").join(ids.select("i", F.col("account").alias("b")), "i")
        false = false.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "_key").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        labelled = pairs.withColumn("y", F.lit(1)).unionByName(false.withColumn("y", F.lit(0)))
        epochs, batches, rate, seed = (self.training[k] for k in ("epochs", "batches", "rate", "seed"))
        blocks = max(1, math.ceil(math.sqrt(2 * pairs.count() / batches / CELL)), math.ceil(n * self.size * 8 / ROOM))
        # Numbers are in order of hash: each `blocks`-th is of one block.
        placed = cut(ids.select("account", F.pmod("i", F.lit(blocks)).cast("int").alias("b"), F.floor(F.col("i") / blocks).cast("int").alias("i")))
        end = lambda s: placed.select(F.col("account").alias(s), F.col("b").alias(f"b{s}"), F.col("i").alias(f"i{s}"))
        cells = labelled.withColumn("_batch", dealt("_key", batches, seed)).join(end("a"), "a").join(end("b"), "b").select("_batch", "ba", "bb", "ia", "ib", "y")
        cells = cut(cells.groupBy("_batch", "ba", "bb").applyInPandas(_packed_cell, "_batch long, ba int, bb int, ia binary, ib binary, y binary, n long"))
        sizes = {r["_batch"]: r["n"] for r in cells.groupBy("_batch").agg(F.sum("n").alias("n")).collect()}  # a row a mini-batch
        slices = around.join(placed, "account").withColumn("s", F.floor(F.col("i") / SLICE).cast("int"))
        slices = cut(slices.groupBy("b", "s").applyInPandas(_packed_slice, "b int, s int, own binary, others binary, counts binary"))
        width = len(nodes.first()["x"]) * 2

        def step(batch: int, weights: Weights) -> tuple[float, int, Weights]:
            if not sizes.get(batch):
                return 0.0, 0, weights
            loss, grads = _link_gradients(slices, cells.where(F.col("_batch") == batch), weights)
            return loss, sizes[batch], grads

        weights = drawn_weights([(width, self.hidden), (self.hidden,), (2 * self.hidden, self.size), (self.size,)], self.seed)
        self.weights, self.losses = stepped(step, weights, epochs=epochs, batches=batches, rate=rate)
        return self

    def _around(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Neighbourhoods of nodes; those of the frames that were asked for last are kept."""
        if self._last is None or self._last[0] is not nodes or self._last[1] is not edges:
            self._last = nodes, edges, _neighbourhoods(nodes, cut(sampled_partners(edges, partners=self.partners, seed=self.seed)))
        return self._last[2]

    def embed(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """account, vector."""
        weights, around = self.weights, self._around(nodes, edges)

        def run(batches):
            for batch in batches:
                own = np.array(batch["own"].tolist(), float).reshape(len(batch), -1)
                z = _encoded(weights, own, *_flat(batch["others"], own.shape[1]))[0] if len(batch) else np.empty((0, 1))
                yield pd.DataFrame({"account": batch["account"], "vector": list(z)})

        return around.mapInPandas(run, "account long, vector array<double>")


def numbered(accounts: DataFrame, seed: int) -> DataFrame:
    """account, i: numbers from 0 in order of hash, counted in 256 parts."""
    parts = accounts.distinct().withColumn("_h", F.xxhash64(F.lit(seed), "account")).withColumn("_p", F.pmod(F.col("_h"), F.lit(256)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n")).select(F.col("_p").alias("_q"), (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_ahead"))  # 256 rows
    inside = F.row_number().over(W.partitionBy("_p").orderBy("_h", "account")) - 1
    return cut(parts.withColumn("_i", inside).join(F.broadcast(sizes), F.col("_p") == F.col("_q")).select("account", (F.col("_i") + F.col("_ahead")).alias("i")))
