"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are described by style features. A
small network is fitted by minimising the non-negative unbiased risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the logistic loss, whose minimiser estimates the posterior. Where the
bracket falls under zero, its gradient is reversed, so that the network doesn't
profit from overfitting. The class prior is estimated from positives and
unlabelled text alone: networks that tell the two apart rank held-back folds of
both, and the least ratio of the shares of unlabelled and of positive rows above
a rank (with a margin for chance) is the share of positives among the unlabelled.

Scale: fitting takes at most max_positives trusted and max_unlabelled unlabelled
rows, in order of a hash of doc_id; a cut by that hash, from the number of rows,
keeps what is sorted for it to about twice as many. Both bounds are parameters,
and both samples come to the driver as Arrow tables of FEATURES doubles a row.
Scoring is one pass over the texts in Arrow batches, without shuffle or join.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import table
from riskweave.llm.wordhash import texts

FEATURES = (
    "log_words", "word_length", "symbol_share", "mark_share", "upper_share", "digit_share", "adjacent_share", "distinct_share",
    "dup_line_share", "log_line_words", "stop_share", "short_share", "single_share", "high_share", "bar_share", "top_share",
)
HIDDEN = 16
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4: rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def style(text: bytes | None) -> list[float]:
    """The features of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    flat = b"".join(words)
    size = len(flat)
    share = lambda drop: (size - len(flat.translate(None, drop))) / (size + 60)  # noqa: E731  a few characters say little
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = list(map(len, words))
    return [
        math.log1p(n), size / n, share(b"#*$%&<>@^~"), share(b"!?"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"),
        sum(map(eq, words, words[1:])) / (n + 5), len(counts) / n ** 0.9, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), share(b".,;"),
        sum(x <= 3 for x in lengths) / n, lengths.count(1) / n, share(bytes(range(128, 256))), share(b"|"), max(counts.values()) / n,
    ]


def features(rows: list[bytes | None]) -> np.ndarray:
    return np.array([style(text) for text in rows], np.float64).reshape(-1, len(FEATURES))


def drawn_ids(ids: DataFrame, n: int) -> DataFrame:
    """The first n of the distinct ids (d_id) in order of a hash, or all if there are fewer."""
    ids = ids.where(F.col("d_id").isNotNull()).distinct()
    cut = min(2**63 - 1, int(2.0**63 * (2 * n + 1000) / max(1, ids.count())))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(1), "d_id"), 1)
    return ids.withColumn("at", at).where(F.col("at") <= cut).orderBy("at", "d_id").limit(n).select("d_id")


def drawn_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """The features of the rows of docs (doc_id, text) whose doc_ids are among ids, a bounded number; equal texts count once."""

    def run(batches):
        for batch in batches:
            x = features(texts(batch))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["x"])

    rows = docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("d_id"), "left_semi").select("text").mapInArrow(run, "x array<double>")
    return np.unique(np.array(rows.toArrow().column("x").combine_chunks().flatten(), np.float64).reshape(-1, len(FEATURES)), axis=0)


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> dict:
    """Weights of tanh network fitted by full-batch Adam on the non-negative risk."""
    both = np.concatenate((pos, unl))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    clip = lambda x: np.clip((x - mean) / scale, -6, 6)
    x = np.concatenate((clip(pos), clip(unl)))
    n = len(pos)
    rng = np.random.Generator(np.random.PCG64(seed))
    w = {"w1": rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        h = np.tanh(x @ w["w1"] + w["b1"])
        f = h @ w["w2"] + w["b2"][0]
        fp, fu = f[:n], f[n:]
        rest = _loss(-fu).mean() - prior * _loss(-fp).mean()
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        # d loss(z)/dz = -(1 - s); d loss(-z)/dz = s.
        sign = 1.0 if rest >= 0 else -1.0
        gp = sign * -prior * sp / n + (-prior * (1 - sp) / n if sign > 0 else 0)
        gu = sign * su / len(fu)
        g = np.concatenate((gp, gu))
        back = np.outer(g, w["w2"]) * (1 - h * h)
        grads = {"w1": x.T @ back + decay * w["w1"], "b1": back.sum(axis=0), "w2": h.T @ g + decay * w["w2"], "b2": np.array([g.sum()])}
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: a.tolist() for k, a in w.items()} | {"mean": mean.tolist(), "scale": scale.tolist()}


def posterior(model: dict, x: np.ndarray) -> np.ndarray:
    """The network's probability of a positive for rows of features."""
    h = np.clip((x - np.array(model["mean"])) / np.array(model["scale"]), -6, 6)
    return 1 / (1 + np.exp(-(np.tanh(h @ np.array(model["w1"]) + model["b1"]) @ np.array(model["w2"]) + model["b2"][0])))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, *, folds: int = 5, max_rows: int = 5_000, sure: float = 0.1) -> float:
    """The share of positives in unl, from pos and unl alone (at most max_rows of each, at random but the same every time).

    Networks fitted to tell pos from unl rank the fold that each has not seen.
    Above a rank t lie shares p(t) and u(t) of them; as u(t) is at least
    prior * p(t), each ratio bounds the prior from above, and the t with the
    least upper confidence bound is taken.
    """
    rng = np.random.Generator(np.random.PCG64(5))
    pos, unl = (x[rng.permutation(len(x))[:max_rows]] for x in (pos, unl))
    if min(len(pos), len(unl)) < 4 * folds:
        return 0.5
    ranked: list[list[np.ndarray]] = [[], []]
    for fold in range(folds):
        kept = [x[np.arange(len(x)) % folds != fold] for x in (pos, unl)]
        model = fit_nnpu(*kept, 0.5, steps=150, decay=0.02)
        for side, x in zip(ranked, (pos, unl), strict=True):
            side.append(posterior(model, x[np.arange(len(x)) % folds == fold]))
    p, u = (np.sort(np.concatenate(x)) for x in ranked)
    ranks = np.unique(np.concatenate((p, u)))
    up, uu = (1 - np.searchsorted(x, ranks, "left") / len(x) for x in (p, u))
    margin = math.sqrt(math.log(4 / sure) / 2) * (1 / math.sqrt(len(p)) + 1 / math.sqrt(len(u)))
    up, uu = up[up > 2 * margin], uu[up > 2 * margin]
    if not len(up):
        return 0.5
    best = np.argmin((uu + margin) / up)
    # A bound from above, and the risk bears a prior that is too low better than one too high: one standard error is taken off.
    share = uu[best] - math.sqrt(uu[best] * (1 - uu[best]) / len(u))
    return float(np.clip(share / up[best], 0.01, 0.99))


def fit_quality(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, max_positives: int = 20_000, max_unlabelled: int = 20_000) -> dict:
    """The fitted network, or {"constant": prior} without positives.

    labels has doc_id, quality; trusted positives are the doc_ids with quality 1
    that aren't held out. Other labels are never looked at.
    """
    trusted = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("d_id"))
    docs = docs.select("doc_id", "text")
    pos = drawn_features(docs, drawn_ids(trusted, max_positives))
    unl = drawn_features(docs, drawn_ids(docs.select(F.col("doc_id").cast("long").alias("d_id")), max_unlabelled))
    if not len(pos) or not len(unl):
        return {"constant": 0.5 if prior is None else float(prior)}
    return fit_nnpu(pos, unl, estimate_prior(pos, unl) if prior is None else prior)


def score_texts(model: dict, rows: list[bytes | None]) -> np.ndarray:
    return np.full(len(rows), model["constant"]) if "constant" in model else posterior(model, features(rows))


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **fit) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    For labels and fit see fit_quality. A score is of the text alone, so equal
    texts have equal scores.

    Null and empty texts have all features 0 and are scored so. Texts of any
    length are described whole. Null doc_ids are scored, not learned from.
    Repeated rows are scored each. Without positives, or with an empty table, all
    scores are the prior (0.5 where none is given). Other columns are ignored,
    whatever their names.
    """
    model = fit_quality(docs, labels, **fit)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(model, texts(batch)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score threshold or more; judged row by row, without a join."""
    model = fit_quality(docs, labels, **fit)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, texts(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_pu_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
