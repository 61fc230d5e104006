"""Repeated passages by sparse suffix arrays.

Of all suffixes of all documents, those stay that begin at content-selected
positions: the minimisers of k-word hashes in windows of `window` of them. A
passage of min_words words holds a minimiser in its first `window` words wherever
it stands, so its copies keep the same suffix, of which at least depth =
min_words - window + 1 words are in the passage. Suffixes are sorted by their
words, taken in blocks: the hash of the first depth words, then of the BLOCKS
that follow. So those with the most in common lie together, and each is compared
with its neighbours of other documents before and behind it. Matches are extended
left and right, word by word on both texts (by hashes of 32 bits, so that an end
lies a word too far with a chance of 2^-32), and count from min_words words on.

Scale: a twelfth of all positions become rows of 32 bytes, which are sorted by
range of blocks, document and position: nothing is grouped by a passage, so one
in a third of all documents is spread over many tasks. Where a key crosses from
one partition into the next, the edge rows are compared afterwards (two rows a
partition). As each suffix meets two neighbours, a group of copies makes at most
twice as many comparisons as it has members. Words are fetched for documents with
matches alone and cut to MARGIN around the matches; a match that reaches further
is extended again with a wider margin, until it ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import BLANK_GAP, BLANKS, ascii_lower, broadcast_if, materialise, small_batches, table
from riskweave.llm.wordhash import WordHashes, blank_words, factors, grams, mix, texts

BROADCAST_ROWS = 1_000_000
MIN_WORDS, K, WINDOW = 51, 8, 24
#: Numbers of words in the blocks after the first, by which suffixes with the same beginning are sorted: up to min_words.
#: What lies further on isn't looked at, so that copies meet the same neighbours with all their suffixes, in order of doc_id.
BLOCKS = (8, 8, 8)
#: Words on either side of matched suffixes that are fetched at first; a match that reaches further is fetched again.
MARGIN = 64
ORDER = ("key", *(f"r{i}" for i in range(len(BLOCKS))), "doc_id", "at")
ENTRY = "key long, " + "".join(f"r{i} int, " for i in range(len(BLOCKS))) + "doc_id long, at int"
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, for hashes of any stretch of words from running sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up), 1024)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def stretches(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost least value in each window of g."""
    if len(g) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def suffixes(docs: DataFrame, *, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW) -> DataFrame:
    """The sparse suffix array's entries, unsorted: key (hash of the first depth words), r0.. (of the blocks behind), doc_id, at (word position)."""
    depth = min_words - window + 1
    if k > depth:
        raise ValueError("k must not be over min_words - window + 1")

    def run(batches):
        words, by, powers = WordHashes(), factors(k, 31), Powers()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                h = words.of(blank_words(text))
                n = len(h)
                if n < min_words:
                    continue
                at = minimisers(grams(h, k, by), window)
                at = at[at + depth <= n]
                powers.reach(n)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers.up[:n], dtype=np.uint64)))
                end = at + depth
                row = [powers.stretches(sums, at, end).view(np.int64)]
                for size in BLOCKS:
                    start, end = end, np.minimum(end + size, n)
                    row.append((powers.stretches(sums, start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                parts.append([*row, np.full(len(at), doc, np.int64), at.astype(np.int32)])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], list(ORDER))

    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENTRY)


PAIR = "a long, a_at long, b long, b_at long, " + ENTRY + ", head boolean"


def _neighbours(batches):
    """In sorted order, each suffix with the nearest ones before and behind it that have its key and another document; then the partition's edges."""
    names = list(ORDER)
    held = before = first = last = None  # held: the rows of the last run of a key and document; before: the row ahead of them
    none = {f.name: f for f in pa.schema([("key", pa.int64()), *[(f"r{i}", pa.int32()) for i in range(len(BLOCKS))], ("doc_id", pa.int64()), ("at", pa.int32()), ("head", pa.bool_())])}

    def pairs(x, y):
        """Pairs of rows (key, doc, at) as a batch, the smaller document first."""
        turn = x[1] > y[1]
        a, a_at, b, b_at = (np.where(turn, p, q) for p, q in ((y[1], x[1]), (y[2], x[2]), (x[1], y[1]), (x[2], y[2])))
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (a, a_at, b, b_at)] + [pa.nulls(len(a), f.type) for f in none.values()], ["a", "a_at", "b", "b_at", *none])

    def closed(rows, start, stop):
        """Pairs of the rows from start to stop, whose runs have ended; what lies ahead and behind counts as a neighbour alone."""
        key, doc = rows[0], rows[1]
        n = len(key)
        opens = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        run = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], n)
        out = []
        for other in (begin[run] - 1, end[run]):
            ok = (other >= 0) & (other < n) & (np.arange(n) >= start) & (np.arange(n) < stop)
            mine = np.flatnonzero(ok)
            mine = mine[key[other[mine]] == key[mine]]
            if len(mine):
                out.append(pairs([c[mine] for c in rows], [c[other[mine]] for c in rows]))
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        if first is None:
            first = batch.slice(0, 1)
        last = batch.slice(batch.num_rows - 1)
        rows = [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "at")]
        lead = 0
        if held is not None:
            rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
            lead = before
        key, doc = rows[0], rows[1]
        # The last run stays open until another begins; with it stays the row ahead of it.
        turns = np.flatnonzero((key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
        if len(turns) <= lead:
            held, before = rows, lead
            continue
        cut = int(turns[-1]) + 1
        # Runs before the cut have their neighbour behind them in sight: the row at the cut.
        yield from closed([c[: cut + 1] for c in rows], lead, cut)
        held, before = [c[cut - 1 :] for c in rows], 1
    if held is not None:
        yield from closed(held, before, len(held[0]))
        edges = pa.Table.from_batches([first.select(names), last.select(names)]).combine_chunks().to_batches()[0]
        empty = pa.nulls(2, pa.int64())
        yield pa.RecordBatch.from_arrays([empty] * 4 + [edges.column(c) for c in names] + [pa.array([True, False])], ["a", "a_at", "b", "b_at", *names, "head"])


def matched_suffixes(entries: DataFrame) -> DataFrame:
    """a, a_at, b, b_at: neighbours in the sorted array with equal key, of different documents (a < b)."""
    n = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = entries.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    met = materialise(ordered.mapInArrow(_neighbours, PAIR), "neighbours")
    # Edge rows alone, two a partition: a head follows the tail of the partition before it.
    order = W.orderBy(*ORDER, F.col("head").cast("int"))
    edges = met.where(F.col("head").isNotNull()).select("*", *[F.lag(c).over(order).alias(f"before_{c}") for c in ("key", "doc_id", "at")])
    edges = edges.where(F.col("head") & (F.col("before_key") == F.col("key")) & (F.col("before_doc_id") != F.col("doc_id")))
    turn = F.col("before_doc_id") > F.col("doc_id")
    pick = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y)).cast("long")
    edges = edges.select(pick("doc_id", "before_doc_id").alias("a"), pick("at", "before_at").alias("a_at"), pick("before_doc_id", "doc_id").alias("b"), pick("before_at", "at").alias("b_at"))
    return met.where(F.col("head").isNull()).select("a", "a_at", "b", "b_at").unionByName(edges)


def hashed_words(text: Column) -> Column:
    """Hashes, of 32 bits, of the blank words of a text with A-Z lower-cased."""
    bare = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(bare, BLANK_GAP), lambda x: F.hash(x)))


def equal_runs(x: pa.ListArray, y: pa.ListArray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of places where x and y, lists of equal lengths (which ends sums up), are equal: row, start, end in the row."""
    same = pc.equal(x, y).to_numpy(zero_copy_only=False).astype(np.bool_)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if not len(same):
        return (np.empty(0, np.int64),) * 3
    breaks = np.concatenate(([True], row[1:] != row[:-1]))
    starts = np.flatnonzero(same & (breaks | ~np.concatenate(([False], same[:-1]))))
    stops = np.flatnonzero(same & np.concatenate((breaks[1:] | ~same[1:], [True]))) + 1
    base = (ends - np.diff(ends, prepend=0))[row[starts]]
    return row[starts], starts - base, stops - base


def extended(met: DataFrame, held: DataFrame, margin: int, min_words: int, depth: int) -> DataFrame:
    """Maximal equal runs around the matched suffixes of each diagonal (a, b, shift, low, high).

    Columns a, b, shift, low, high, start, end (in b), open: whether the run
    reaches the margin and both texts go on.
    """

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            low, high, at, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "at", "more"))
            row, start, end = equal_runs(x.flatten(), y.flatten(), np.cumsum(x.value_lengths().to_numpy()).astype(np.int64))
            length = x.value_lengths().to_numpy()[row]
            begin, stop = at[row] + start, at[row] + end
            mine = (begin < high[row] + depth) & (stop > low[row])
            starts_open = (start == 0) & batch.column("earlier").to_numpy(zero_copy_only=False)[row]
            open_ = mine & (starts_open | ((end == length) & more[row]))
            keep = open_ | (end - start >= min_words)
            row = row[keep]
            columns = [batch.column(c).take(pa.array(row)) for c in ("a", "b", "shift", "low", "high")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(begin[keep].astype(np.int64)), pa.array(stop[keep].astype(np.int64)), pa.array(open_[keep])], ["a", "b", "shift", "low", "high", "start", "end", "open"])

    # Of both documents, the words from margin before the first matched suffix to margin after the last; `at` is the first of them in b.
    first = F.greatest(F.col("low") - margin, F.col("shift"), F.lit(0)).cast("int")
    ends = met.select("a", "b", "shift", "low", "high", first.alias("at"), (F.col("high") + depth + margin).cast("int").alias("to"))
    y = F.slice("words", F.col("at") + 1, F.col("to") - F.col("at"))
    sided = ends.join(held.select(F.col("doc_id").alias("b"), "words"), "b").select("a", "b", "shift", "low", "high", "at", "to", y.alias("y"), (F.size("words") > F.col("to")).alias("b_more"))
    x = F.slice("words", (F.col("at") - F.col("shift") + 1).cast("int"), F.size("y"))
    sided = sided.join(held.select(F.col("doc_id").alias("a"), "words"), "a").select("a", "b", "shift", "low", "high", "at", x.alias("x"), "y", (F.col("b_more") & (F.size("words") > F.col("to") - F.col("shift"))).alias("more"))
    earlier = (F.col("at") > 0) & (F.col("at") > F.col("shift"))
    # Where one text ends earlier, both are cut to the shorter.
    sided = sided.select("a", "b", "shift", "low", "high", F.col("at").cast("long").alias("at"), "x", F.slice("y", F.lit(1), F.size("x")).alias("y"), "more", earlier.alias("earlier"))
    with small_batches(met.sparkSession):
        return materialise(sided.mapInArrow(run, "a long, b long, shift long, low long, high long, start long, end long, open boolean"), "runs")


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW) -> DataFrame:
    """Passages of at least min_words words that stand in other documents too.

    Returns one row per document and maximal span: doc_id, first_word, last_word
    (positions from 0, inclusive), n_words, partner_id (the least document met in
    the span), first_copy (no document met in it is smaller). Each span is met
    with at least one other document that has its words; not all pairs are listed.

    Words are blank words with A-Z lower-cased. Null doc_ids and texts, and texts
    of fewer words, have no spans. Rows that repeat a doc_id are one document and
    don't repeat each other; spans refer to any of its texts. Suffixes alike in
    all blocks (ties) are in order of document and position. Texts of any length
    are treated whole. Empty tables give empty results; other columns are ignored,
    whatever their names.
    """
    depth = min_words - window + 1
    entries = materialise(suffixes(docs, min_words=min_words, k=k, window=window), "suffix-entries")
    met = matched_suffixes(entries).groupBy("a", "b", (F.col("b_at") - F.col("a_at")).alias("shift")).agg(F.min("b_at").alias("low"), F.max("b_at").alias("high"))
    met = materialise(met, "diagonals")
    ids = materialise(met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct(), "matched-ids")
    ids = broadcast_if(ids, ids.count(), BROADCAST_ROWS)
    held = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("doc_id", hashed_words(F.col("text")).alias("words")), "matched-words")

    margin, found = max(MARGIN, min_words), []
    while True:
        runs = extended(met, held, margin, min_words, depth)
        found.append(runs.where(~F.col("open")))
        met = runs.where("open").select("a", "b", "shift", "low", "high").distinct()
        if met.isEmpty():
            break
        margin *= 8
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    one, other = F.struct(F.col("b").alias("doc_id"), "start", "end", F.col("a").alias("partner")), F.struct(F.col("a").alias("doc_id"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"), F.col("b").alias("partner"))
    sides = F.explode(F.array(one, other))
    spans = spans.select(sides.alias("s")).select("s.*").distinct()
    by = W.partitionBy("doc_id").orderBy("start", "end", "partner")
    apart = F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    merged = spans.withColumn("span", F.sum(apart.cast("int")).over(by)).groupBy("doc_id", "span").agg(F.min("start").alias("first_word"), (F.max("end") - 1).alias("last_word"), F.min("partner").alias("partner_id"))
    return merged.select("doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), "partner_id", (F.col("partner_id") > F.col("doc_id")).alias("first_copy"))


def op5_suffix_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
