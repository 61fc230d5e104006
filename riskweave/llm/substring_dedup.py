"""Repeated stretches of words by a compacted De Bruijn graph.

An edge of the graph is a window of `window` words; it leads from its first
window - 1 words to its last. A window that also starts in a document with a
smaller doc_id is repeated, and the words it covers are removed.

1. Edges. Successive windows whose least anchor (a gram of `anchor` words) is the
   same gram are a path of edges without a branch inside it: one row with the
   anchor's hash, the path's hash and its coordinates (document, word). A fifth as
   many rows as windows are sorted by anchor and path.
2. Equal paths lie side by side: all but those of the least document are repeated
   as a whole. Where an anchor has several paths (where documents come to branch),
   the windows of the paths that are left are sorted as edges of their own, and
   the least document of each is its source.
3. Compaction. Edges that follow each other in the document and in the source
   share a node and become one path; a path ends where its source branches off.
4. Verification. Paths meet their sources' coordinates in a join: an independent
   hash of all words between the two coordinates must agree. If one doesn't, all
   is done again with other hashes, so hashes decide how long it takes, not what
   is removed.

Scale: nothing is grouped by a window or an anchor. Rows are sorted by range of
all their columns, so one that a third of all documents have is spread over many
tasks, and each batch is judged by itself: a run that begins in an earlier batch
merely sends a few more rows on to the sort of windows, where each partition
leaves two rows to tell its first document by. Lists by document are within its
number of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import broadcast_if, materialise, small_batches, table
from riskweave.llm.suffix_dedup import Powers
from riskweave.llm.wordhash import texts

WINDOW, ANCHOR = 13, 4
BROADCAST_ROWS = 1_000_000
#: Rows of hashes that are judged at once.
BATCH = 100_000
PLACE = "doc_id long, rev long, at int"
EDGE = f"anchor long, path long, {PLACE}, n int"
REPEAT = f"{PLACE}, n int, s_doc long, s_rev long, s_at int"
ROUNDS = 8
#: Distance of the seeds of second hashes.
CHECK = 1000
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Low bits of an anchor's rank that hold its position.
PLACES = np.uint64(24)


class TextHashes:
    """64-bit hashes of the blank words of a text, other ones for each seed; computed over all its bytes at once."""

    def __init__(self, seed: int):
        self.of_byte = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = Powers()

    def of(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        blank = np.ones(len(raw) + 2, np.bool_)
        blank[1:-1] = BLANK[raw]
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = turns[::2], turns[1::2]
        self.powers.reach(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.of_byte[raw] * self.powers.up[: len(raw)], out=sums[1:])
        return self.powers.stretches(sums, start, end)


def running_sums(h: np.ndarray, powers: Powers) -> np.ndarray:
    powers.reach(len(h))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers.up[: len(h)], dtype=np.uint64)))


def _batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    of = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def least_anchors(g: np.ndarray, size: int) -> np.ndarray:
    """Position of the least anchor in each window of `size` of them, the leftmost of equal ones (by 40 bits)."""
    most = 1 << 23
    if len(g) > 2 * most:  # the windows from most on by themselves
        return np.concatenate((least_anchors(g[: most + size - 1], size), least_anchors(g[most:], size) + most))
    low = (np.uint64(1) << PLACES) - np.uint64(1)
    ranks = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    done = 1
    while done < size:  # the least of done anchors from each on, and of up to twice as many
        step = min(done, size - done)
        ranks = np.minimum(ranks[: len(ranks) - step], ranks[step:])
        done += step
    return (ranks & low).astype(np.int64)


def edge_paths(rows: DataFrame, *, window: int, anchor: int, seed: int) -> DataFrame:
    """One row (EDGE) for each stretch of n windows with one least anchor; at: the first window's word."""

    def run(batches):
        hashes, powers = TextHashes(seed), Powers()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for doc, rev, text in zip(batch.column("doc_id").to_pylist(), batch.column("rev").to_pylist(), texts(batch), strict=True):
                h = hashes.of(text)
                if len(h) < window:
                    continue
                sums = running_sums(h, powers)
                first = np.arange(len(h) - anchor + 1)
                g = powers.stretches(sums, first, first + anchor)
                least = least_anchors(g, window - anchor + 1)
                at = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
                n = np.diff(at, append=len(least))
                path = powers_of(powers, sums, at, at + n + window - 1)
                parts.append([g[least[at]].view(np.int64), path, np.full(len(at), doc), np.full(len(at), rev), at.astype(np.int32), n.astype(np.int32)])
            if parts:
                yield _batch(EDGE, [np.concatenate(x) for x in zip(*parts, strict=True)])

    return rows.mapInArrow(run, EDGE)


def powers_of(powers: Powers, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Signed hashes of the words from start to end."""
    return powers.stretches(sums, start, end).view(np.int64)


def _sources(batches):
    """In sorted order: REPEAT rows of paths that stand in a smaller document, and (without a source) those whose windows must be looked at."""
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, path, doc, rev, at, n = (c.to_numpy() for c in batch.columns)
        opens = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        paths = opens | np.concatenate(([True], path[1:] != path[:-1]))
        first = np.maximum.accumulate(np.where(paths, np.arange(len(doc)), 0))
        again = doc != doc[first]
        begins = np.flatnonzero(opens)
        run = np.cumsum(opens) - 1
        branches = (np.add.reduceat(paths.astype(np.int64), begins) > 1) & (np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins))
        branches[[0, -1]] = True  # these may go on in another batch
        left = ~again & branches[run]
        keep = again | left
        none = left[keep]
        source = [pa.array(c[first][keep], kind, mask=none) for c, kind in ((doc, pa.int64()), (rev, pa.int64()), (at, pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, rev, at, n)] + source, [f.split()[0] for f in REPEAT.split(", ")])


WINDOWED = f"h long, g int, {PLACE}"
MET = f"kind int, h long, g int, {REPEAT}"


def edge_windows(rows: DataFrame, left: DataFrame, *, window: int, seed: int) -> DataFrame:
    """The windows (WINDOWED: two hashes and a place) of the stretches in left."""

    def run(batches):
        hashes, check, powers = TextHashes(seed), TextHashes(seed + CHECK), Powers()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for doc, rev, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("rev").to_pylist(), texts(batch), batch.column("spans").to_pylist(), strict=True):
                h, other = hashes.of(text), check.of(text)
                at = np.unique(np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in spans]))
                second = (powers.stretches(running_sums(other, powers), at, at + window) >> np.uint64(32)).astype(np.uint32)
                parts.append([powers_of(powers, running_sums(h, powers), at, at + window), second.view(np.int32), np.full(len(at), doc), np.full(len(at), rev), at.astype(np.int32)])
            if parts:
                yield _batch(WINDOWED, [np.concatenate(x) for x in zip(*parts, strict=True)])

    spans = left.groupBy("doc_id", "rev").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    spans = materialise(spans, "branching-paths")
    ids = broadcast_if(spans.select("doc_id", "rev"), spans.count(), BROADCAST_ROWS)
    return rows.join(ids, ["doc_id", "rev"], "left_semi").join(spans, ["doc_id", "rev"]).mapInArrow(run, WINDOWED)


def _first_documents(batches):
    """In sorted order, MET rows: kind 0, windows with a smaller document; 1, windows of the partition's first run that may have one in an earlier partition; 2, the first row of its last run."""
    held, lead = None, True  # held: the first row of the last run so far; lead: whether that is the partition's first run
    names = [f.split()[0] for f in MET.split(", ")]

    def rows(kind, key, place, source=None):
        size = len(place[0])
        none = [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32())]
        columns = [pa.array(np.full(size, kind, np.int32)), pa.array(key[0]), pa.array(key[1]), *map(pa.array, place), pa.array(np.ones(size, np.int32))]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(c) for c in source] if source else none), names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        h, g = columns[:2]
        goes_on = held is not None and held[0][0] == h[0] and held[1][0] == g[0]
        opens = np.concatenate(([not goes_on], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        if goes_on:
            columns = [np.concatenate((a, b)) for a, b in zip(held, columns, strict=True)]
            opens = np.concatenate(([True], opens))
        first = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
        again = columns[2] != columns[2][first]
        open_ = (first == 0) & ~again & (lead and (held is None or goes_on))
        if goes_on:  # the held row has been given out already
            again[0] = open_[0] = False
        for kind, which in ((0, again), (1, open_)):
            if which.any():
                yield rows(kind, [c[which] for c in columns[:2]], [c[which] for c in columns[2:]], [c[first][which] for c in columns[2:]] if not kind else None)
        last = int(first[-1])
        lead = lead and last == 0 and (held is None or goes_on)
        held = [c[last : last + 1] for c in columns]
    if held is not None:
        yield rows(2, held[:2], held[2:])


def repeated_windows(edges: DataFrame) -> DataFrame:
    """REPEAT rows (n = 1) of the windows that also start in a document with a smaller doc_id, with a place there."""
    spark = edges.sparkSession
    order = [f.split()[0] for f in WINDOWED.split(", ")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with small_batches(spark, BATCH):
        met = materialise(edges.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first_documents, MET), "windows-met")
    columns = [f.split()[0] for f in REPEAT.split(", ")]
    # One row a partition.
    firsts = met.where("kind = 2").groupBy("h", "g").agg(F.min(F.struct("doc_id", "rev", "at")).alias("first"))
    late = met.where("kind = 1").select("h", "g", "doc_id", "rev", "at", "n").join(F.broadcast(firsts), ["h", "g"]).where(F.col("first.doc_id") < F.col("doc_id"))
    late = late.select("doc_id", "rev", "at", "n", F.col("first.doc_id").alias("s_doc"), F.col("first.rev").alias("s_rev"), F.col("first.at").alias("s_at"))
    return met.where("kind = 0").select(*columns).unionByName(late)


def compacted(repeats: DataFrame, window: int) -> DataFrame:
    """Paths: doc_id, rev, start, words, s_doc, s_rev, s_start: repeats that follow each other in the document and in one source."""
    by = W.partitionBy("doc_id", "rev").orderBy("at")
    before = lambda c: F.lag(c).over(by)
    follows = (before(F.col("at") + F.col("n")) == F.col("at")) & (before("s_doc") == F.col("s_doc")) & (before("s_rev") == F.col("s_rev")) & (before(F.col("s_at") + F.col("n")) == F.col("s_at"))
    pieces = repeats.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("_path", F.sum("_new").over(by))
    paths = pieces.groupBy("doc_id", "rev", "_path").agg(F.min("at").alias("start"), (F.sum("n") + window - 1).cast("int").alias("words"), F.min("s_doc").alias("s_doc"), F.min("s_rev").alias("s_rev"), F.min("s_at").alias("s_start"))
    return paths.drop("_path")


OUT = "row boolean, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,n_words:long,source_id:long,source_start:long>>, s_doc long, s_rev long, s_start int, words int, hash long, place int"


def _cleaned(rows: DataFrame, paths: DataFrame, *, seed: int, keep_texts: bool) -> DataFrame:
    """OUT: a row for each of rows; for each path its words' hash; and for each place that a path starts or ends at in its source the running sum there."""

    def run(batches):
        hashes, powers = TextHashes(seed), Powers()
        kinds = pa.schema([("row", pa.bool_()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "n_words", "source_id", "source_start")])))])
        kinds = pa.schema([*kinds, ("s_doc", pa.int64()), ("s_rev", pa.int64()), ("s_start", pa.int32()), ("words", pa.int32()), ("hash", pa.int64()), ("place", pa.int32())])
        for batch in batches:
            out: list[dict] = []
            for doc, rev, text, paths, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rev")), texts(batch), *(batch.column(c).to_pylist() for c in ("paths", "places")), strict=True):
                words = text.split() if text else []
                gone = np.zeros(len(words) + 1, np.int64)
                if paths or places:
                    sums = running_sums(hashes.of(text), powers)
                if paths:
                    start = np.array([p["start"] for p in paths])
                    end = start + [p["words"] for p in paths]
                    np.add.at(gone, start, 1)
                    np.add.at(gone, end, -1)
                    own = ((sums[end] - sums[start]) * powers.down[start]).view(np.int64).tolist()
                    out += [{c: p[c] for c in ("s_doc", "s_rev", "s_start", "words")} | {"hash": x} for p, x in zip(paths, own, strict=True)]
                if places:
                    out += [{"s_doc": doc, "s_rev": rev, "place": p, "hash": x} for p, x in zip(places, sums[places].view(np.int64).tolist(), strict=True)]
                drop = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, x in zip(words, drop, strict=True) if not x] if paths else words)
                spans = [{"start": p["start"], "n_words": p["words"], "source_id": p["s_doc"], "source_start": p["s_start"]} for p in sorted(paths or (), key=lambda p: p["start"])]
                out.append({"row": True, "doc_id": doc, "n_words": len(words), "n_removed": int(drop.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if keep_texts else None, "spans": spans})
            yield pa.RecordBatch.from_pylist(out, kinds)

    ends = paths.select(F.col("s_doc").alias("doc_id"), F.col("s_rev").alias("rev"), F.explode(F.array("s_start", F.col("s_start") + F.col("words"))).alias("place")).distinct()
    asked = paths.select("doc_id", "rev", F.struct("start", "words", "s_doc", "s_rev", "s_start").alias("path"), F.lit(None).cast("int").alias("place"))
    asked = asked.unionByName(ends.select("doc_id", "rev", F.lit(None).cast(asked.schema["path"].dataType).alias("path"), "place"))
    asked = materialise(asked.groupBy("doc_id", "rev").agg(F.collect_list("path").alias("paths"), F.collect_list("place").alias("places")), "paths-of-documents")
    size = asked.count()
    if size <= BROADCAST_ROWS:  # the documents without a path needn't be shuffled
        ids = F.broadcast(asked.select("doc_id", "rev"))
        met = rows.join(ids, ["doc_id", "rev"], "left_semi").join(asked, ["doc_id", "rev"])
        plain = rows.join(ids, ["doc_id", "rev"], "left_anti")
        met = met.unionByName(plain.select("*", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("paths", "places")]))
    else:
        met = rows.join(asked, ["doc_id", "rev"], "left")
    with small_batches(rows.sparkSession, 1000):
        return materialise(met.select("doc_id", "rev", "text", "paths", "places").mapInArrow(run, OUT), "cleaned")


def _disagree(out: DataFrame) -> bool:
    """Whether the words of a path aren't those of its source."""

    def differ(batches):
        powers = Powers()
        for batch in batches:
            start, own, low, high = (batch.column(c).to_numpy() for c in ("s_start", "hash", "low", "high"))
            if len(start):
                powers.reach(int(start.max()))
            theirs = (high.view(np.uint64) - low.view(np.uint64)) * powers.down[start]
            bad = theirs != own.view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(start[bad])], ["s_start"])

    claims = out.where(F.col("words").isNotNull()).select("s_doc", "s_rev", "s_start", "words", "hash").distinct()
    places = out.where(F.col("place").isNotNull()).select("s_doc", "s_rev", "place", "hash").distinct()
    at = lambda name, c: places.select("s_doc", "s_rev", F.col("place").alias(c), F.col("hash").alias(name))
    sums = claims.join(at("low", "s_start"), ["s_doc", "s_rev", "s_start"]).withColumn("_end", F.col("s_start") + F.col("words")).join(at("high", "_end"), ["s_doc", "s_rev", "_end"])
    return not sums.select("s_start", "hash", "low", "high").mapInArrow(differ, "s_start int").isEmpty()


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and rev, 0 but where a doc_id repeats: there a hash of the text. And the rows that are compared: each doc_id and rev once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = materialise(rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    size = twice.count()
    there = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    if not size:
        rows = rows.withColumn("rev", F.lit(0).cast("long"))
        return rows, rows.where(there)
    flag = broadcast_if(twice.withColumn("_twice", F.lit(True)), size, BROADCAST_ROWS)
    rows = rows.join(flag, "doc_id", "left").withColumn("rev", F.when(F.col("_twice"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))
    once = rows.where(there & F.col("_twice").isNull()).unionByName(rows.where(there & F.col("_twice")).dropDuplicates(["doc_id", "rev"]))
    return rows.drop("_twice"), once.drop("_twice")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, keep_texts: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space), spans.

    A word goes if a window of `window` words that covers it also starts in a
    document with a smaller doc_id; windows are judged on the texts as given. spans
    are the paths that were verified: start, n_words, source_id, source_start; they
    may overlap, and a source may lie in a passage that is removed itself. Without
    keep_texts kept is null.

    Words are blank words, unchanged. Null and empty texts have none; texts of fewer
    words than a window keep theirs. Rows with a null doc_id are neither compared nor
    changed. Rows that repeat a doc_id are judged each by its own text and not against
    each other. Of equal passages (ties) the least doc_id keeps its own; repetitions
    within one document stay. Texts of any length are treated whole. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    if not 0 < anchor < window:
        raise ValueError("anchor must be under window")
    spark = docs.sparkSession
    rows, once = told_apart(docs)
    order = ["anchor", "path", "doc_id", "rev", "at"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for seed in range(0, 2 * ROUNDS, 2):
        edges = materialise(edge_paths(once, window=window, anchor=anchor, seed=seed), "edge-paths")  # finding the ranges reads it too
        edges = edges.repartitionByRange(n, *order).sortWithinPartitions(*order)
        with small_batches(spark, BATCH):
            met = materialise(edges.mapInArrow(_sources, REPEAT), "paths-met")
        windows = materialise(edge_windows(once, met.where("s_doc is null"), window=window, seed=seed), "windows")
        repeats = met.where("s_doc is not null").unionByName(repeated_windows(windows))
        paths = materialise(compacted(repeats, window), "paths")
        out = _cleaned(rows, paths, seed=seed + 1, keep_texts=keep_texts)
        if not _disagree(out):
            return out.where("row").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans")
    raise RuntimeError("remove_repeats: paths differ from their sources under all hashes")


def op12_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), keep_texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  g AS (SELECT row, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
  f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g), r AS (SELECT row, i FROM g JOIN f USING (g) WHERE doc_id > least),
  w AS (SELECT row, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
  c AS (SELECT w.*, coalesce(max((r.i IS NOT NULL)::INT) OVER (PARTITION BY w.row ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN r ON r.row = w.row AND r.i = w.i),
  k AS (SELECT row, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY row)
  SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)"""
