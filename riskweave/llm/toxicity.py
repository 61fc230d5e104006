"""Toxicity of deobfuscated text.

Disguised tokens (leetspeak, letters of other scripts, letters spaced or dotted
out, drawn-out repetition) are read as the output of a noisy channel: each
character spans a lattice of the letters it may stand for, or of nothing, and
Viterbi search finds the most likely word under a character trigram model.
Words, plain and restored, and their beginnings (by how many distinct words of
the text have them) are weighed by a logistic model of log-odds.

Scale: the character model comes from the counts of all words of all documents
(a grouped count combined in the batch and before the shuffle; it grows with the
corpus), reduced to the trigrams of the MAX_LETTERS commonest letters, which
bounds what the driver and the tasks hold. The weights are learned from at most
max_rows labelled texts of either label, in order of a hash of doc_id, weighted
to the totals of their labels; features are those whose share of toxic texts
can't be chance, of which max_rows bounds the number. Only their numbers come to
the driver, not the texts. Scoring is one pass in Arrow batches without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import broadcast_if, materialise, table
from riskweave.llm.pu_quality import held_out
from riskweave.llm.wordhash import texts

#: Letters that the character model knows; others stay as they are.
MAX_LETTERS = 96
FLUSH = 200_000
CACHE = 300_000
#: Features of a kind (words; beginnings by how many words have them) that the model may owe to chance.
CHANCE = 1.0
#: Lengths of word beginnings, and of how many distinct words of a text at most they are counted.
BEGINNINGS, TIMES = (4, 5, 6, 7), 5
#: Strength of the penalty on the squares of weights.
PENALTY = 0.1
# The letters that common look-alikes stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "¡": "i", "µ": "u", "×": "x", "&": "a", "%": "o", "#": "h",
}
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "ß": "b",
}
#: Tokens longer than this aren't remembered, only read.
LONG = 40
#: Log probabilities of the channel: a letter as it is, a look-alike, a gap, one more of a letter.
KEPT, SWAPPED, GAP, AGAIN = -0.05, -0.5, -0.2, -0.9
EDGES = ".,;:!?\"'()[]{}<>*#%&|~«»„“”¿¡…-_"
LETTER = re.compile(r"[^\W\d_]")
MARK = re.compile(r"[\d@$!|+(<{€£¥¡µ×&%#.\-_*~'·,/\\]")
DRAWN = re.compile(r"([^\W\d_])\1\1")
LATIN = re.compile(r"[a-z]")
FOREIGN = re.compile(f"[{''.join(c for c in HOMOGLYPHS if c not in 'łøß')}\uff41-\uff5a]")
SPACED = re.compile(r"(?<!\S)(?:[^\s.,;:][ ]{1,3}){2,}[^\s.,;:](?!\S)")
STRETCHED = ".,;:!?\"'*#%&|$@~-"


class CharModel:
    """Interpolated character trigrams; log p(c | a, b) over letters, 0 standing for a word's edge."""

    def __init__(self, trigrams: list[tuple[str, int]]):
        letters: dict[str, int] = {}
        for gram, n in trigrams:
            letters[gram[2]] = letters.get(gram[2], 0) + n
        chosen = sorted((c for c in letters if c != "^"), key=lambda c: (-letters[c], c))[:MAX_LETTERS]
        self.ids = {c: i + 1 for i, c in enumerate(chosen)} | {"^": 0}
        size = len(chosen) + 1
        counts = np.zeros((size, size, size))
        for gram, n in trigrams:
            at = [self.ids.get(c) for c in gram]
            if None not in at:
                counts[tuple(at)] += n
        one = counts.sum(axis=(0, 1)) + 1
        two = counts.sum(axis=0) + 5 * one / one.sum()
        two /= two.sum(axis=1, keepdims=True)
        three = counts + 5 * two[None]
        self.logp = np.log(three / three.sum(axis=2, keepdims=True)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each character of a lower-cased token may stand for, with log probabilities."""
    out, before = [], ""
    for c in token:
        if c.isalpha():
            options = [(c, KEPT)]
            plain = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKD", c)[0]
            if plain != c:
                options.append((plain, SWAPPED))
            if c == before:
                options.append(("", AGAIN))
        elif c in LOOKALIKES:
            options = [(x, SWAPPED) for x in LOOKALIKES[c]] + ([("", GAP + SWAPPED)] if c in "!&%#" else [])
        else:
            options = [("", GAP)]
        out.append(options)
        before = c
    return out


def restore(token: str, model: CharModel, words: bool = False) -> str:
    """The most likely word behind a token: Viterbi over pairs of letters.

    With words, each blank of the token may also end a word, and words come out
    between blanks. Paths are chains of letters and the pairs at a place are
    those of its lattice, so time grows with the length.
    """
    ids, logp = model.ids, model.logp
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for at, options in enumerate(lattice(token)):
        ends = words and token[at] == " "
        ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, out) in states.items():
            for c, cost in options:
                if not c:
                    key, now, chain = (a, b), score + cost, out
                elif (i := ids.get(c)) is None:
                    key, now, chain = (b, 0), score + cost - 12.0, (out, c)
                else:
                    key, now, chain = (b, i), score + cost + float(logp[a, b, i]), (out, c)
                if key not in ahead or now > ahead[key][0]:
                    ahead[key] = now, chain
            if ends and (now := score + GAP + float(logp[a, b, 0])) > ahead.get((0, 0), (-math.inf,))[0]:
                ahead[0, 0] = now, (out, " ")
        states = ahead
    _, chain = max(((score + float(logp[a, b, 0]), out) for (a, b), (score, out) in states.items()), key=lambda x: x[0])
    letters = []
    while chain:
        chain, c = chain
        letters.append(c)
    return "".join(reversed(letters))


def bare(token: str) -> str:
    """A lower-cased token without what punctuation puts around it."""
    return unstretched(token).strip(EDGES)


def unstretched(token: str) -> str:
    """The token without the marks at its end, where there are two or more."""
    short = token.rstrip(STRETCHED)
    return short if len(token) - len(short) > 1 else token


def disguised(token: str) -> bool:
    if len(token) < 3 or LETTER.search(token) is None:
        return False
    return MARK.search(token) is not None or DRAWN.search(token) is not None or (not token.isascii() and FOREIGN.search(token) is not None and LATIN.search(token) is not None)


def read_token(token: str, model: CharModel) -> str:
    """A token's words between blanks: as it stands, and restored with and without the marks at its end; of letters spaced out, as one word and as several."""
    if " " in token:
        joined = re.sub(" +", "_", token)
        return f"{bare(joined)} {restore(joined, model)} {restore(token, model, words=True)}" if disguised(joined) else bare(joined)
    word, plain = bare(token), token.strip(".,;:?\"'()[]")
    forms = {plain, unstretched(plain)}
    return " ".join([word, *(restore(x, model) for x in sorted(forms) if disguised(x))])


class TokenReader(dict):
    """The words of a token, kept for the tokens met lately."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = tuple(read_token(token, self.model).split(" "))
        if len(token) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[token] = words
        return words


def readings(text: str | None, reader: TokenReader) -> tuple[set[str], int]:
    """Distinct words of a text, with the restored words of disguised tokens and of spaced-out letters; and its number of distinct tokens."""
    text = (text or "").lower()
    tokens = set(text.split())
    n = len(tokens)
    if SPACED.search(text):
        tokens.update(SPACED.findall(text))
    return set(chain.from_iterable(map(reader.__getitem__, tokens))), n


def char_trigrams(docs: DataFrame) -> DataFrame:
    """gram (three characters, ^ for a word's edges) and n, over all words of letters in docs."""

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update((text or "").lower().split())
                if len(counts) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    words = docs.select(F.col("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    clean = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    words = words.select(clean.alias("word"), "n").where(F.col("word").rlike(r"^\p{L}+$")).select(F.concat(F.lit("^^"), "word", F.lit("^")).alias("w"), "n")
    grams = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 2)).alias("at"))
    return grams.groupBy(F.substr("w", "at", F.lit(3)).alias("gram")).agg(F.sum("n").alias("n"))


def fit_char_model(docs: DataFrame) -> CharModel:
    """The model of docs; only trigrams of the commonest letters come to the driver, (MAX_LETTERS + 1)^3 at most."""
    grams = materialise(char_trigrams(docs), "trigrams")
    letters = grams.where(F.substr("gram", F.lit(3), F.lit(1)) != "^").groupBy(F.substr("gram", F.lit(3), F.lit(1)).alias("c")).agg(F.sum("n").alias("n"))
    common = [r["c"] for r in letters.orderBy(F.desc("n"), "c").limit(MAX_LETTERS).collect()]
    inside = F.lit(True)
    for i in (1, 2, 3):
        inside = inside & F.substr("gram", F.lit(i), F.lit(1)).isin([*common, "^"])
    return CharModel(sorted((r["gram"], r["n"]) for r in grams.where(inside).collect()))


def features_of(words) -> set[str]:
    """The words, and their beginnings of BEGINNINGS letters with the numbers, up to TIMES, that distinct words reach."""
    times: dict[str, int] = {}
    for w in words:
        for k in BEGINNINGS:
            if len(w) > k:
                times[w[:k]] = times.get(w[:k], 0) + 1
    return set(words) | {f"{b}~{i}" for b, n in times.items() for i in range(1, min(n, TIMES) + 1)}


class ToxicModel:
    """Log-odds of features, and of the share of disguised tokens and the length of a text."""

    def __init__(self, weights: dict[str, float], bias: float, dense: tuple[float, float] = (0.0, 0.0)):
        self.weights, self.bias, self.dense = weights, bias, dense
        self.roots = {f[: BEGINNINGS[0]] for f in weights if "~" in f}

    def score(self, words: set[str], length: int) -> float:
        """Probability that a text with these readings, of so many distinct tokens, is toxic."""
        weights, roots, start = self.weights, self.roots, BEGINNINGS[0]
        z = self.bias + sum(map(float.__mul__, self.dense, dense_features(words, length)))
        z += sum(map(weights.__getitem__, sorted(weights.keys() & words)))
        near = [w for w in words if w[:start] in roots]
        if near:
            z += sum(map(weights.__getitem__, sorted(weights.keys() & {f for f in features_of(near) if "~" in f})))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def dense_features(words, length: int) -> tuple[float, float]:
    """How much of a text is given away by decoding, and its length."""
    return float(max(0, len(words) - length)) / (length + 10), math.log1p(length) / 10


def fit_weights(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, toxic: np.ndarray, weight: np.ndarray, n_features: int, *, steps: int = 400) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the logistic model: full-batch Adam on the weighted loss with PENALTY; (rows, cols) are the features that texts have."""
    theta = np.zeros(n_features + dense.shape[1] + 1)
    rate = (weight * toxic).sum() / weight.sum()
    theta[-1] = math.log(rate / (1 - rate)) if 0 < rate < 1 else -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    keep = np.ones_like(theta) * PENALTY
    keep[-1] = 0
    for step in range(1, steps + 1):
        z = np.bincount(rows, theta[cols], len(toxic)) + dense @ theta[n_features:-1] + theta[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        g = np.concatenate((np.bincount(cols, off[rows], n_features), off @ dense, [off.sum()])) + keep * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], float(theta[-1]), theta[n_features:-1]


def learn(docs: DataFrame, marked: DataFrame, model: CharModel, all_toxic: int, all_clean: int) -> ToxicModel:
    """The weights of features, from the texts of marked (l_id, toxic), which were drawn by label from all_toxic and all_clean.

    Equal texts count once, as toxic if any of them is. Chance is judged among
    the texts drawn, as weighted counts would count a text for several; weights
    are fitted with each text standing for those of its label.
    """
    prior = (all_toxic + 1) / (all_toxic + all_clean + 2)
    nothing = ToxicModel({}, math.log(prior / (1 - prior)))
    if not all_toxic:
        return nothing

    def read(batches):
        reader = TokenReader(model)
        for batch in batches:
            found = [readings(text, reader) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([sorted(w) for w, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.int64())], ["toxic", "words", "n"])

    def count(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for words, toxic in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for feature in features_of(words):
                    counts.setdefault(feature, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "clean", "toxic"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if(marked, marked.count(), 1_000_000), F.col("doc_id") == F.col("l_id"))
    held = held.groupBy("text").agg(F.max("toxic").alias("toxic")).mapInArrow(read, "toxic int, words array<string>, n long")
    held = materialise(held, "toxic-readings")
    totals = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return nothing
    sums = held.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = materialise(sums.where(F.col("toxic") > 1), "toxic-features")
    rate = toxic / (toxic + clean)
    sums = sums.withColumn("kind", F.regexp_extract("feature", f"~([1-{TIMES}])$", 1))
    met: dict[str, dict[int, int]] = {}
    for r in sums.groupBy("kind", "toxic").agg(F.count("*").alias("n")).collect():
        met.setdefault(r["kind"], {})[r["toxic"]] = r["n"]
    tests = {k: _testable(x, rate) for k, x in met.items()}
    enough = F.lit(False)
    for k, (least, _) in tests.items():
        enough = enough | ((F.col("kind") == k) & (F.col("toxic") >= least))
    rows = sums.where(enough & (F.col("toxic") > (F.col("toxic") + F.col("clean")) * min(1.0, 2 * rate))).collect()
    ids = {f: i for i, f in enumerate(sorted(r["feature"] for r in rows if _by_chance(r["toxic"], r["clean"], rate) * tests[r["kind"]][1] < CHANCE))}

    def numbered(batches):
        for batch in batches:
            words, n = batch.column("words").to_pylist(), batch.column("n").to_pylist()
            found = [sorted(ids[f] for f in features_of(w) if f in ids) for w in words]
            dense = [list(dense_features(w, k)) for w, k in zip(words, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64()))], ["toxic", "ids", "dense"])

    # At most 2 * max_rows rows of numbers, in an order of their own so that sums are the same every time.
    drawn = sorted(held.mapInArrow(numbered, "toxic int, ids array<int>, dense array<double>").collect())
    y = np.array([r["toxic"] for r in drawn], np.float64)
    weight = np.where(y == 1, max(all_toxic, toxic) / toxic, max(all_clean, clean) / max(1, clean))
    at = np.repeat(np.arange(len(drawn)), [len(r["ids"]) for r in drawn])
    cols = np.array([i for r in drawn for i in r["ids"]], np.int64)
    w, bias, dense = fit_weights(at, cols, np.array([r["dense"] for r in drawn]), y, weight * len(y) / weight.sum(), len(ids))
    return ToxicModel({f: float(w[i]) for f, i in ids.items()}, bias, tuple(float(x) for x in dense))


def _testable(met: dict[int, int], rate: float) -> tuple[int, int]:
    """The least count of toxic texts that could not be chance if no clean text had the feature, and how many features reach it.

    met: number of features by count of toxic texts.
    """
    least, tested = max(met, default=0) + 1, 0
    for n in sorted(met, reverse=True):
        if rate**n * (tested + met[n]) >= CHANCE:
            break
        least, tested = n, tested + met[n]
    return least, tested


def _by_chance(toxic: int, clean: int, rate: float) -> float:
    """About how likely a feature met toxic + clean times is met so often in toxic texts if it has nothing to do with it."""
    n = toxic + clean
    choose = math.lgamma(n + 1) - math.lgamma(toxic + 1) - math.lgamma(clean + 1)
    return math.exp(min(0.0, choose + toxic * math.log(rate) + clean * math.log1p(-min(rate, 1 - 1e-9))))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = 15_000, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    labels has doc_id, toxic; held out doc_ids aren't learned from. The score is
    the probability that the logistic model gives to a text's readings.

    Null and empty texts have no words. Texts and tokens of any length are read
    whole. Null doc_ids and labels aren't learned from; of several labels of a
    doc_id, or of equal texts, toxic holds. Repeated rows are scored each, and
    equal texts alike. Without toxic labels all scores are small. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    model = fit_char_model(docs)
    marked = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("l_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("l_id")))
    marked = marked.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    drawn = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64(F.lit(2), "l_id"), "l_id").limit(max_rows) for t in (0, 1)]
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic = learn(docs, materialise(drawn[0].unionByName(drawn[1]), "toxic-sample"), model, totals.get(1, 0), totals.get(0, 0))

    def run(batches):
        reader = TokenReader(model)
        for batch in batches:
            scores = [toxic.score(*readings(text, reader)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, F.lit(1)).otherwise(F.lit(0)).alias("predicted"))


def op6_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
