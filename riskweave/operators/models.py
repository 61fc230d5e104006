"""Models: boosted trees, forests, isolation forest, neighbours, reconstruction, embeddings.

Training of the tree models is MLlib's. Isolation trees and neighbour distances
are fitted on bounded samples (parameters) and scored in Arrow batches.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.functions import scalars as S

#: Rows that are compared with the neighbours' sample, and that go down a tree, at a time: so few that they stay in a core's cache.
ROWS, STEP = 64, 1024


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """df with a vector of the columns in order; what is missing or null is 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v_{c}") if c in df.columns else F.lit(0.0).alias(f"_v_{c}") for c in columns]
    return VectorAssembler(inputCols=[f"_v_{c}" for c in columns], outputCol=out).transform(df.select("*", *filled)).drop(*[f"_v_{c}" for c in columns])


def hash_split(df: DataFrame, key: str, label: str, shares: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 42) -> DataFrame:
    """df with part (0, 1, ..): a split that keeps the share of labels up to chance and is the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), key, label), F.lit(1_000_000)) / 1e6
    part, upto = F.lit(len(shares) - 1), 0.0
    chain = None
    for i, share in enumerate(shares[:-1]):
        upto += share
        chain = F.when(u < upto, i) if chain is None else chain.when(u < upto, i)
    return df.withColumn("part", part if chain is None else chain.otherwise(part))


def stratified_split(df: DataFrame, key: str, label: str, shares: tuple[float, ...] = (0.6, 0.2, 0.2)) -> DataFrame:
    """df with part (0, 1, ..): of each label the same shares to the nearest row, in order of the key's md5; null is a label too.

    Rows are counted in 4096 parts of a label, so that no task sorts all of it. Equal
    keys may fall apart.
    """
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    dealt = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    inside = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)) - 1
    sizes = dealt.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    by = W.partitionBy("_l")
    sizes = sizes.select("_l", "_c", (F.sum("_n").over(by.orderBy("_c")) - F.col("_n")).alias("_ahead"), F.sum("_n").over(by).alias("_all"))
    met = dealt.withColumn("_i", inside).join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c"))).withColumn("_at", F.col("_i") + F.col("_ahead"))
    part, upto = F.lit(0), 0.0
    for share in shares[:-1]:
        upto += share
        part = part + (F.col("_at") >= F.floor(F.col("_all") * upto + 0.5)).cast("int")
    return met.select(*df.columns, part.alias("part"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: positives weigh as much together as negatives."""
    sums = df.agg(F.sum((F.col(label) == 0).cast("long")).alias("_neg"), F.sum((F.col(label) == 1).cast("long")).alias("_pos"))
    weight = F.when(F.col(label) == 1, F.col("_neg") / F.greatest(F.lit(1), F.col("_pos"))).otherwise(F.lit(1.0))
    return df.join(F.broadcast(sums)).withColumn("weight", weight).drop("_neg", "_pos")  # sums is one row


class SupervisedScorer:
    """Two boosters and a forest, calibrated on a held-out part by isotonic regression."""

    def __init__(self, columns: list[str], *, rounds: int = 20, trees: int = 40, seed: int = 42):
        self.columns, self.rounds, self.trees, self.seed = columns, rounds, trees, seed

    def fit(self, train: DataFrame, held: DataFrame) -> SupervisedScorer:
        data = class_weight(assemble(train, self.columns)).persist()
        held = assemble(held, self.columns)
        common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "seed": self.seed}
        makers = (GBTClassifier(maxIter=self.rounds, maxDepth=6, stepSize=0.1, **common), GBTClassifier(maxIter=self.rounds, maxDepth=5, stepSize=0.2, subsamplingRate=0.8, **common), RandomForestClassifier(numTrees=self.trees, maxDepth=12, minInstancesPerNode=5, **common))

        def fitted(maker):
            model = maker.fit(data)
            raw = model.transform(held).select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("p"))
            return model, IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)

        # Side by side: a booster is a chain of short jobs, between which cores would wait.
        with ThreadPoolExecutor(len(makers)) as pool:
            self.models = list(pool.map(fitted, makers))
        data.unpersist()
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """df with supervised_score (0 to 100) and agreement of the three (0 to 1)."""
        out = assemble(df, self.columns)
        for i, (model, calibrated) in enumerate(self.models):
            out = model.transform(out).withColumn("_p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
            out = calibrated.setFeaturesCol("_p").setPredictionCol(f"p{i}").transform(out).drop("_p")
        parts = [F.col(f"p{i}") for i in range(len(self.models))]
        return out.select(*df.columns, (100 * sum(parts[1:], parts[0]) / len(parts)).alias("supervised_score"), (1 - (F.greatest(*parts) - F.least(*parts))).alias("agreement"))

    def importance(self) -> list[tuple[str, float]]:
        """Mean importance of the columns over the models, greatest first."""
        mean = sum(m.featureImportances.toArray() for m, _ in self.models) / len(self.models)
        return sorted(zip(self.columns, map(float, mean), strict=True), key=lambda x: (-x[1], x[0]))


def attributions(df: DataFrame, importance: list[tuple[str, float]], top: int = 15) -> DataFrame:
    """df (with z_<column>) with top_features: importance times standardised value, by size. Cheaper than tree_shap's, and cruder."""
    parts = F.array(*[F.struct((-F.abs(F.col(f"z_{c}") * w)).alias("order"), F.lit(c).alias("feature"), (F.col(f"z_{c}") * w).alias("value")) for c, w in importance])
    return df.withColumn("top_features", F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: F.struct(x["feature"], x["value"])))


def _isolation_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth == 0 or not len(wide):
        return (len(x),)
    c = int(rng.choice(wide))
    cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    left = x[:, c] < cut
    return (c, cut, _isolation_tree(x[left], rng, depth - 1), _isolation_tree(x[~left], rng, depth - 1))


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _laid_out(tree: tuple) -> tuple[np.ndarray, ...]:
    """A tree as a table of nodes: column, cut, the place of the left branch (the right one is next; a leaf's is its own), whether it branches, and the path's length at a leaf."""
    rows, todo = [None], [(tree, 0, 0)]
    while todo:
        node, at, depth = todo.pop()
        if len(node) == 1:
            rows[at] = (0, 0.0, at, 0, depth + _mean_path(node[0]))
        else:
            rows[at] = (node[0], node[1], len(rows), 1, 0.0)
            todo += [(node[2], len(rows), depth + 1), (node[3], len(rows) + 1, depth + 1)]
            rows += [None, None]
    return tuple(np.array(c) for c in zip(*rows, strict=True))


def _depths(tree: tuple[np.ndarray, ...], x: np.ndarray, depth: int) -> np.ndarray:
    """How long the paths of rows are in a tree of that depth: all rows go down a step at a time."""
    column, edge, branch, inner, length = tree
    flat, begin, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = branch.take(at) + inner.take(at) * ~(flat.take(begin + column.take(at)) < edge.take(at))
    return length.take(at)


def _sampled(df: DataFrame, columns: list[str], key: str, rows: int) -> np.ndarray:
    drawn = df.orderBy(F.xxhash64(key), key).limit(rows).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return drawn.toPandas().to_numpy(np.float64).reshape(-1, len(columns))  # rows bounds it


def isolation_scores(df: DataFrame, columns: list[str], key: str, *, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """key, isolation: 0 to 1, nearer 1 for what few cuts set apart."""
    rng = np.random.Generator(np.random.PCG64(seed))
    drawn = _sampled(df, columns, key, sample * 16)
    depth = int(np.ceil(np.log2(sample)))
    forest = [_laid_out(_isolation_tree(drawn[rng.permutation(len(drawn))[:sample]], rng, depth)) for _ in range(trees)]
    norm = max(_mean_path(min(sample, len(drawn))), 1e-9)

    def run(batches):
        for batch in batches:
            x = np.ascontiguousarray(batch[columns].fillna(0).to_numpy(np.float64))
            some = [sum(_depths(t, x[i : i + STEP], depth) for t in forest) for i in range(0, len(x), STEP)]
            yield pd.DataFrame({"key": batch["key"], "isolation": 2 ** (-np.concatenate(some or [np.zeros(0)]) / trees / norm)})

    return df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(run, f"key {dict(df.dtypes)[key]}, isolation double").withColumnRenamed("key", key)


def local_outlier_scores(df: DataFrame, columns: list[str], key: str, *, k: int = 30, sample: int = 2_000) -> DataFrame:
    """key, outlier: local reachability of k neighbours in a bounded sample against one's own; over 1 is sparser."""
    base = _sampled(df, columns, key, sample)
    k = max(1, min(k, len(base) - 1))

    squares, twice = (base * base).sum(1)[None], 2 * base.T

    def near(x: np.ndarray, skip: bool) -> tuple[np.ndarray, np.ndarray]:
        d = x @ twice
        np.subtract(squares, d, out=d)
        d += (x * x).sum(1)[:, None]
        np.maximum(d, 0, out=d)
        if skip:
            np.fill_diagonal(d, np.inf)
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        return at, np.sqrt(np.take_along_axis(d, at, 1))

    at, d = near(base, True)
    reach_k = d.max(axis=1)
    density = 1 / (np.maximum(d, reach_k[at]).mean(axis=1) + 1e-10)

    def run(batches):
        for batch in batches:
            x, out = batch[columns].fillna(0).to_numpy(np.float64), np.empty(len(batch))
            for i in range(0, len(x), ROWS):
                at, d = near(x[i : i + ROWS], False)
                own = 1 / (np.maximum(d, reach_k[at]).mean(axis=1) + 1e-10)
                out[i : i + ROWS] = density[at].mean(axis=1) / own
            yield pd.DataFrame({"key": batch["key"], "outlier": out})

    return df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(run, f"key {dict(df.dtypes)[key]}, outlier double").withColumnRenamed("key", key)


def reconstruction_errors(df: DataFrame, columns: list[str], *, rank: int = 8, drivers: int = 3) -> DataFrame:
    """df (columns standardised) with mse and drivers: error of a linear autoencoder and the columns it is worst at."""
    data = assemble(df, columns)
    basis = PCA(k=min(rank, len(columns)), inputCol="features", outputCol="code").fit(data).pc.toArray()
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    through = basis @ basis.T
    losses = [F.pow(F.col("_x")[i] - S.dot(F.col("_x"), F.array(*[F.lit(float(w)) for w in through[i]])), 2) for i in range(len(columns))]
    out = df.withColumn("_x", values).withColumn("_loss", F.array(*losses))
    named = F.array(*[F.struct((-F.col("_loss")[i]).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    mse = F.aggregate("_loss", F.lit(0.0), lambda s, x: s + x) / len(columns)
    return out.select(*df.columns, mse.alias("mse"), F.slice(F.array_sort(named), 1, drivers)["name"].alias("drivers"))


def anomaly_score(isolation: Column, outlier: Column, mse: Column, base: Column) -> Column:
    """Mean of three sub-scores, recalibrated, 0 to 100."""
    parts = (S.decision_to_score(0.5 - isolation), S.decision_to_score((1.5 - outlier) / 2), S.reconstruction_to_score(mse, base))
    return S.recalibrate(sum(parts[1:], parts[0]) / 3)


def walk_embeddings(edges: DataFrame, *, walks: int = 10, length: int = 15, size: int = 64, seed: int = 42) -> DataFrame:
    """account, vector: Word2Vec over uniform random walks along edges, drawn by hash and joined step by step."""
    out = edges.groupBy(F.col("u").alias("at")).agg(F.array_sort(F.collect_set("v")).alias("next"))
    paths = edges.select(F.col("u").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("path", F.array("start"))
    for step in range(length - 1):
        drawn = F.element_at("next", (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "start", "walk"), F.size("next")) + 1).cast("int"))
        paths = paths.join(out, F.element_at("path", -1) == F.col("at"), "left").select("start", "walk", F.when(F.col("next").isNotNull(), F.concat("path", F.array(drawn))).otherwise(F.col("path")).alias("path"))
    text = paths.select(F.transform("path", lambda x: x.cast("string")).alias("words"))
    vectors = Word2Vec(vectorSize=size, minCount=0, seed=seed, inputCol="words", outputCol="v").fit(text).getVectors()
    return vectors.select(F.col("word").cast("long").alias("account"), vector_to_array("vector").alias("vector"))


def embedding_score(drift_sender: Column, drift_receiver: Column, link: Column) -> Column:
    """0 to 100 from two drifts and the surprise of the link (fixed weights)."""
    return 100 * (0.4 * drift_sender + 0.3 * drift_receiver + 0.3 * link)


def embedding_remarks(df: DataFrame) -> DataFrame:
    """df with remarks on drift_sender, drift_receiver and link over their limits."""
    said = F.array_compact(
        F.array(
            F.when(F.col("drift_sender") > 0.30, F.format_string("sender moved %.2f", "drift_sender")),
            F.when(F.col("drift_receiver") > 0.30, F.format_string("receiver moved %.2f", "drift_receiver")),
            F.when(F.col("link") > 0.60, F.format_string("unlikely link (%.2f)", "link")),
        )
    )
    return df.withColumn("remarks", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("nothing unusual"))))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_code: place of the value in order; -1 for null."""
    codes = df.select(F.col(column).alias("_value")).where(F.col("_value").isNotNull()).distinct()
    codes = codes.withColumn("_code", F.row_number().over(W.orderBy("_value")) - 1)  # one row a value
    return df.join(codes, F.col(column) == F.col("_value"), "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(-1))).drop("_value", "_code")
