"""Near-duplicates by MinHash with banding, verification and components.

A document's set of word shingles is summed up by the minima of many universal
hash functions; minima are joined to bands, and documents that agree in a band
are candidates. Candidates are confirmed on their full sets, and links are closed
to components by alternating large-star and small-star.

Scale: texts are read once for sketches; documents with the same set are one
representative from then on, so groups of exact copies cost one row. In a bucket
each member is first compared with the bucket's least document, which settles
groups of near copies with as many comparisons as members. Then components are
built, and only documents in buckets that still hold several components go on,
to an exact prefix filter between different components. So no candidate of the
banding is dropped, and a group that has come together makes no pairs. Sets are
fetched for candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import broadcast_if, materialise, table
from riskweave.llm.components import components
from riskweave.llm.wordhash import WordHashes, blank_words, factors, grams, mix, texts

BANDS, ROWS = 48, 7
BROADCAST_ROWS = 2_000_000
BLOCK = 256


def shingle_sets(rows: list[bytes | None], k: int, words: WordHashes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    by = factors(k + 1, 11)
    for text in rows:
        h = words.of(blank_words(text))
        if len(h) >= k:
            yield np.unique(grams(h, k, by))
        elif len(h):
            yield mix((h * by[: len(h)]).sum(dtype=np.uint64, keepdims=True) + by[k] * np.uint64(len(h)))
        else:
            yield h


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = room[:, : len(shingles[at : at + BLOCK])]
        np.multiply(a[:, None], shingles[None, at : at + BLOCK], out=part)
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketch(docs: DataFrame, *, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, print (128-bit digest of the set), bands (array of hashes), for each row."""

    def run(batches):
        words = WordHashes()
        a, b = factors(bands * rows, 21), factors(bands * rows, 22)
        room, join = np.empty((bands * rows, BLOCK), np.uint64), factors(rows, 23)
        for batch in batches:
            counts, prints, keys = [], [], []
            for shingles in shingle_sets(texts(batch), k, words):
                counts.append(len(shingles))
                prints.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                least = _minima(shingles, a, b, room).reshape(bands, rows) if len(shingles) else np.empty((0, rows), np.uint64)
                keys.append(mix((least * join).sum(axis=1, dtype=np.uint64)).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), held], ["doc_id", "n_shingles", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id and set (its shingle hashes as bytes) of the wanted ids."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(texts(batch), k, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"])

    ids = materialise(wanted, "wanted")
    ids = broadcast_if(ids, ids.count(), BROADCAST_ROWS)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return materialise(held.mapInArrow(run, "doc_id long, set binary"), "sets")


def confirm(docs: DataFrame, pairs: DataFrame, *, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of which 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sets = _sets(docs, pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), k)
    sided = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("x")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("y")), "v")
    return materialise(sided.select("u", "v", "x", "y").mapInArrow(run, "u long, v long").distinct(), "links")


def _shingle_rows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, shingle: the sets of the wanted ids, a row a shingle."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = list(shingle_sets(texts(batch), k, words))
            if sets:
                ids = np.repeat(batch.column("doc_id").to_numpy(), list(map(len, sets)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], ["doc_id", "shingle"])

    ids = broadcast_if(wanted, wanted.count(), BROADCAST_ROWS)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return materialise(held.mapInArrow(run, "doc_id long, shingle long").distinct(), "shingles")


def prefix_pairs(docs: DataFrame, classed: DataFrame, *, k: int, percent: int) -> DataFrame:
    """u, v of different classes that may reach percent: an exact filter on the sets of classed (rep, class).

    Shingles are ordered by how many of these documents have them. Two sets that
    reach percent share a shingle among the rarest n - ceil(percent * n) + 1 of
    each, and from the first one they share on both have enough left. A document
    whose rarest shingles are its own meets no one. For each shingle the largest
    class is one side only, so that a class doesn't meet itself.
    """
    classed = materialise(classed.withColumnRenamed("rep", "doc_id"), "classed")
    rows = _shingle_rows(docs, classed.select("doc_id"), k)
    often = rows.groupBy(F.col("shingle").alias("s")).agg(F.count("*").alias("df"))
    by = W.partitionBy("doc_id")
    ranked = rows.join(often, F.col("shingle") == F.col("s")).select("doc_id", "shingle", "df", F.row_number().over(by.orderBy("df", "shingle")).alias("i"), F.count("*").over(by).alias("n"))
    front = ranked.where((F.col("df") > 1) & (F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).join(classed, "doc_id").select("doc_id", "shingle", "i", "n", "class")
    front = materialise(front, "prefixes")
    sizes = front.groupBy("shingle", "class").agg(F.count("*").alias("in_class"))
    main = sizes.groupBy(F.col("shingle").alias("m_shingle")).agg(F.max(F.struct("in_class", "class")).alias("main"), F.count("*").alias("classes")).where(F.col("classes") > 1).select("m_shingle", F.col("main.class").alias("main"))
    fewer = front.join(main, F.col("shingle") == F.col("m_shingle")).where(F.col("class") != F.col("main"))
    x, y = (df.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "i", "n", "class")]) for df, side in ((fewer, "x"), (front, "y")))
    alike = (F.col("n_x") * 100 >= F.col("n_y") * percent) & (F.col("n_y") * 100 >= F.col("n_x") * percent)
    left = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y")) + 1
    enough = left * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    met = x.join(y, "shingle").where((F.col("class_x") != F.col("class_y")) & alike & enough)
    return met.select(F.least("doc_id_x", "doc_id_y").alias("u"), F.greatest("doc_id_x", "doc_id_y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    docs has doc_id (an integer) and text. Words are blank words with A-Z
    lower-cased, shingles k words. component_id is the least doc_id reachable over
    links of at least percent; kept is true for that document.

    Null and empty texts, and texts without words, have an empty set, link with
    nothing and are kept. A null doc_id cannot be linked: component_id is null and
    the row is kept. Rows that repeat a doc_id are one document, linked by any of
    their texts. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sketches = materialise(sketch(docs, k=k, bands=bands, rows=rows), "sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same = materialise(named.groupBy(F.col("print").alias("p")).agg(F.min("doc_id").alias("rep")), "same-sets")
    of = named.select("doc_id", "print", "n_shingles", "bands").join(same, (F.col("print") == F.col("p")) & (F.col("doc_id") == F.col("rep"))).select("rep", "n_shingles", F.posexplode("bands").alias("band", "h"))
    members = of.select(F.xxhash64("band", "h").alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = members.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where(F.col("least") < F.col("most")).select(F.col("key").alias("b_key"), "least")
    members = materialise(members.join(shared, F.col("key") == F.col("b_key")).select("key", "rep", "n", "least").distinct(), "members")

    alike = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    sizes = members.where(F.col("rep") == F.col("least")).select(F.col("rep").alias("l_rep"), F.col("n").alias("l_n")).distinct()
    first = members.where(F.col("rep") != F.col("least")).select(F.col("least").alias("u"), F.col("rep").alias("v"), "n").distinct()
    first = materialise(first.join(sizes, F.col("u") == F.col("l_rep")).where(alike("n", "l_n")).select("u", "v"), "pairs")
    links = confirm(docs, first, k=k, percent=percent)

    # Each document is tied to the representative of its set.
    copies = named.select("doc_id", "print").distinct().join(same, F.col("print") == F.col("p")).where(F.col("doc_id") != F.col("rep")).select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    classes = components(links).withColumnRenamed("node", "c_node")
    placed = materialise(members.join(classes, F.col("rep") == F.col("c_node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("class")), "placed")
    mixed = placed.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("other")).where(F.col("one") < F.col("other")).select(F.col("key").alias("m_key"))
    open_ = materialise(placed.join(mixed, F.col("key") == F.col("m_key")).select("key", "rep", "n", "class"), "open")
    pairs = prefix_pairs(docs, open_.select("rep", "class").distinct(), k=k, percent=percent)
    pairs = materialise(pairs.join(first, ["u", "v"], "left_anti"), "more-pairs")
    links = links.unionByName(confirm(docs, pairs, k=k, percent=percent)) if not pairs.isEmpty() else links
    classes = components(links.unionByName(copies)).withColumnRenamed("node", "c_node")

    ends = sketches.select("doc_id", "n_shingles").join(classes, F.col("doc_id") == F.col("c_node"), "left")
    component = F.coalesce("component", "doc_id")
    return ends.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(greatest(1, len(w) - 3)), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS s FROM docs
), sized AS (
  SELECT doc_id, len(s) AS n, s FROM sets
), flat AS (
  SELECT doc_id, n, unnest(s) AS g FROM sized
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(node, seen) AS (
  SELECT u, v FROM ways UNION SELECT r.node, b.v FROM reach r JOIN ways b ON r.seen = b.u
), least AS (SELECT node, min(seen) AS m FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sized LEFT JOIN least ON doc_id = node
"""
