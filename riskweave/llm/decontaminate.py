"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into windows of consecutive words. The length of each test
term's posting list is counted over all training documents, and the rarest terms
of each window become its anchors. The index stores the postings of the anchors:
document, position, and the words around it as far as a window reaches, as
written table. An exact phrase starts from the list of the rarest anchor and
intersects it with the lists of the window's other terms at their offsets, the
second rarest first; as a posting carries its neighbours, the other lists are met
in the posting itself. A proximity match has at least min_share of the window's
distinct terms within reach of one of its anchors, in any order; a window of n
terms has n - ceil(min_share * n) + 1 anchors, so that one of them is there
whichever terms are missing.

Scale: documents are read twice, for counts and for postings, in stages without
shuffle of words: positions come from a number sequence, counts are combined
before the shuffle, and postings go from the scan to the table. The rarest terms
keep lists short, and no list is ever grouped by its term. The test side is
broadcast while it is within BROADCAST_BYTES, else joined by shuffle. From the
search on, rows are dealt by document row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import broadcast_if, letters_words, materialise, positions, table

BROADCAST_BYTES = 64_000_000
WINDOW = 10
#: Share of a window's distinct terms that a proximity match has at least.
MIN_SHARE = 0.8


def test_windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Windows of `length` words of each item; of a shorter one, all its words.

    Columns item_id, window (words). Items without words have none. Repeated
    items and windows that recur in an item are kept once.
    """
    items = benchmark.select(F.col("item_id"), letters_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - length + 1)))
    return items.select("item_id", "words", starts.alias("at")).select("item_id", F.slice("words", F.col("at"), length).alias("window")).distinct()


def posting_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Length of the posting list of each term (h: hash of the term) over all docs."""
    at = docs.select(letters_words(F.col("text")).alias("words")).select("words", positions(F.col("words")).alias("p")).where(F.col("p") >= 0)
    return at.select(F.xxhash64(F.get("words", F.col("p"))).alias("h")).join(broadcast_if(terms, 16 * n_terms, BROADCAST_BYTES), "h").groupBy("h").agg(F.count("*").alias("postings"))


def anchored_windows(docs: DataFrame, windows: DataFrame, n_terms: int, min_share: float = MIN_SHARE) -> DataFrame:
    """windows with their distinct terms, rarest first: anchors (hashes of the rarest ones), offset of the first, and second with its offset."""
    terms = materialise(windows.select(F.explode("window").alias("term")).distinct().select(F.xxhash64("term").alias("h")).distinct(), "terms")
    counts = materialise(posting_counts(docs, terms, n_terms), "posting-counts")
    counted = windows.select("item_id", "window", F.explode(F.array_distinct("window")).alias("term")).withColumn("h", F.xxhash64("term")).join(broadcast_if(counts, 24 * n_terms, BROADCAST_BYTES), "h", "left")
    by = counted.groupBy("item_id", "window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "term"))).alias("terms"))
    n = F.size("terms")
    term = lambda i: F.coalesce(F.get("terms", F.lit(i))["term"], F.get("terms", F.lit(0))["term"])
    offset = lambda i: F.array_position("window", term(i)).cast("int") - 1
    anchors = F.transform(F.slice("terms", F.lit(1), n - F.ceil(n * F.lit(min_share)).cast("int") + 1), lambda t: F.xxhash64(t["term"]))
    return by.select("item_id", "window", n.alias("n_terms"), anchors.alias("anchors"), offset(0).alias("offset"), term(1).alias("second"), offset(1).alias("second_offset"))


def build_index(docs: DataFrame, anchors: DataFrame, n_bytes: int) -> DataFrame:
    """Postings of the anchor terms, and one row (p = -1, h null) per document.

    Columns row, doc_id, n_words, p, h, lead (words before p in near), near (the
    words around p, as many on either side as the longest window of the anchor
    has besides it).
    """
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), letters_words(F.col("text")).alias("words"))
    at = read.select("row", "doc_id", "words", positions(F.col("words")).alias("p"))
    key = F.when(F.col("p") < 0, F.lit(-1).cast("long")).otherwise(F.xxhash64(F.get("words", F.col("p"))))
    header = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("h"), F.lit(0).alias("reach"))
    wanted = anchors.select(F.explode("anchors").alias("h"), (F.size("window") - 1).alias("reach")).union(header).groupBy("h").agg(F.max("reach").alias("reach"))
    kept = at.withColumn("key", key).join(broadcast_if(wanted, n_bytes, BROADCAST_BYTES), F.col("key") == F.col("h"))
    lead = F.least(F.col("p"), F.col("reach"))
    near = F.slice("words", F.col("p") - lead + 1, lead + F.col("reach") + 1)
    listed = F.col("p") >= 0
    return materialise(kept.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "p", F.when(listed, F.col("h")).alias("h"), F.when(listed, lead).alias("lead"), F.when(listed, near).alias("near")), "postings")


def exact_phrases(index: DataFrame, anchors: DataFrame, n_bytes: int) -> DataFrame:
    """row, doc_id, item_id, first, length: places where a window's words stand in a row."""
    at = F.col("lead") - F.col("offset")
    second = F.get("near", at + F.col("second_offset")) == F.col("second")
    phrase = F.slice("near", at + 1, F.size("window")) == F.col("window")
    found = index.where(F.col("h").isNotNull())
    met = found.join(broadcast_if(anchors, n_bytes, BROADCAST_BYTES), F.col("h") == F.get("anchors", F.lit(0))).where((at >= 0) & second).where(phrase)
    return met.select("row", "doc_id", "item_id", (F.col("p") - F.col("offset")).alias("first"), F.size("window").alias("length"))


def near_phrases(index: DataFrame, anchors: DataFrame, n_bytes: int, *, min_share: float = MIN_SHARE) -> DataFrame:
    """row, doc_id, item_id, p, share: anchors with at least min_share of the window's distinct terms around, in any order.

    min_share is not less than that of the anchored windows.
    """
    reach = F.size("window") - 1
    around = F.slice("near", F.greatest(F.lit(1), F.col("lead") - reach + 1), F.least(F.col("lead"), reach) + reach + 1)
    share = F.size(F.array_intersect(around, "window")) / F.col("n_terms")
    found = index.where(F.col("h").isNotNull()).withColumnRenamed("h", "posting")
    each = anchors.select("item_id", "window", "n_terms", F.explode("anchors").alias("h"))
    met = found.join(broadcast_if(each, 3 * n_bytes, BROADCAST_BYTES), F.col("posting") == F.col("h"))
    return met.withColumn("share", share).where(F.col("share") >= min_share).select("row", "doc_id", "item_id", "p", "share")


def indexed(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame, int]:
    """The index of docs for a benchmark, its anchored windows, and about how many bytes these take."""
    windows = materialise(test_windows(benchmark, length), "windows")
    n, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "window")) + 16 * F.size("window") + 100), F.lit(0))).collect()[0]
    anchors = materialise(anchored_windows(docs, windows, n * length), "anchors")
    return build_index(docs, anchors, n_bytes), anchors, n_bytes


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items (exactly met), near_items (met exactly or nearly); items are sorted ids as strings.

    Null or empty text: no words, no hits. Null item texts and items without
    words have no windows. Texts of any length are searched whole. Repeated
    documents, null doc_ids and ties: each input row is searched by itself; docs
    should be read from files or materialised, as row numbers come from the scan.
    Terms alike in number are taken in order of their letters. An empty benchmark
    hits nothing. Other columns are ignored, whatever their names.
    """
    index, anchors, n_bytes = indexed(docs, benchmark, length)
    hits, close = exact_phrases(index, anchors, n_bytes), near_phrases(index, anchors, n_bytes)
    heads = index.where(F.col("h").isNull()).select("row", "doc_id", "n_words")
    none = lambda kind: F.lit(None).cast(kind)
    head = [none(docs.schema["doc_id"].dataType).alias("doc_id"), none("long").alias("n_words")]
    item = F.col("item_id").cast("string")
    both = heads.select("row", "doc_id", "n_words", none("string").alias("item"), none("string").alias("close"), F.lit(0).alias("first"), F.lit(0).alias("length"))
    both = both.unionByName(hits.select("row", *head, item.alias("item"), item.alias("close"), "first", "length"))
    both = both.unionByName(close.select("row", *head, none("string").alias("item"), item.alias("close"), F.lit(0).alias("first"), F.lit(0).alias("length")))
    both = both.repartition("row")
    # Words in the union of the hit intervals: what each adds beyond the furthest end before it.
    before = W.partitionBy("row").orderBy("first", "length", "item").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("first") + F.col("length")
    reached = F.max(end).over(before)
    added = F.greatest(F.lit(0), end - F.greatest(F.col("first"), F.coalesce(reached, F.lit(0))))
    return (
        both.withColumn("added", added)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("added").cast("long").alias("n_hit"),
            F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set("close")).alias("near_items"),
        )
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "near_items")
    )


def op3_decontaminate(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_sha256"))


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), items AS (
  SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, words[s + 1 : s + 10] AS w FROM (SELECT item_id, words, unnest(range(greatest(1, len(words) - 9))) AS s FROM items WHERE len(words) > 0)
), lengths AS (SELECT DISTINCT len(w) AS m FROM windows),
spots AS (
  SELECT r, p, m, words[p + 1 : p + m] AS w FROM (SELECT r, words, m, unnest(range(len(words) - m + 1)) AS p FROM docs, lengths WHERE len(words) >= m)
), hits AS (
  SELECT r, p, m, item_id FROM spots JOIN windows USING (w)
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY r
), counts AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM docs) GROUP BY word
), terms AS (
  SELECT item_id, w, word, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(n, 0), word) AS nth, count(*) OVER (PARTITION BY item_id, w) AS n_terms
  FROM (SELECT DISTINCT item_id, w, unnest(w) AS word FROM windows) LEFT JOIN counts USING (word)
), anchors AS (SELECT * FROM terms WHERE nth <= n_terms - ceil(n_terms * 0.8::DOUBLE) + 1),
near AS (
  SELECT r, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS near_ids, count(DISTINCT item_id) AS n_near
  FROM (SELECT r, p, words, words[p + 1] AS word FROM (SELECT r, words, unnest(range(len(words))) AS p FROM docs)) JOIN anchors USING (word)
  WHERE len(list_distinct(list_intersect(words[greatest(1, p + 2 - len(w)) : p + len(w)], w))) >= n_terms * 0.8::DOUBLE GROUP BY r
), covered AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS x FROM hits) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items, sha256(coalesce(near_ids, '')) AS near_sha256
FROM docs LEFT JOIN found USING (r) LEFT JOIN covered USING (r) LEFT JOIN near USING (r)
"""
