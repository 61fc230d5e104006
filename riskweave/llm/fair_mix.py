"""Mixing sources to target weights by weighted fair queueing.

Each document of a source is put into a shuffled, reproducible order; its
virtual finish time is the source's running size up to and with it, divided by
the source's target. A further pass over the same order (an epoch) follows the
first. All copies of all sources then form one queue by finish time, and the
queue is cut where the total budget is used up, so that every source has been
served in proportion to its target.

Scale: a source may hold most rows, so no window is by source alone. Running
sums go over two levels, about sqrt(rows) hash ranges and the rows inside one.
The global order isn't built either: a histogram of the queue by range of
finish time finds the range in which the budget ends, and that range alone is
sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import blank_word_count, materialise

SEED = "mix-1"
FIRST_ID = -(2**63)


def fair_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Targets of sources, from (source, source_size).

    Sources in code point order, null last, take the weights in turn and divide
    share * total. A target stops at epochs * source_size; what is over goes to
    the others by weight, until none is above. The level of that water-filling
    is the largest of the levels reached when the sources with the smallest
    limit per weight are filled first.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.select("source", "source_size", rank.alias("rank")).withColumn("weight", F.element_at(turn, (F.col("rank") - 1) % len(weights) + 1)).withColumn("limit", F.col("source_size") * epochs)
    fill = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    budget = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return levels.select("source", "source_size", "rank", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_to_targets(docs: DataFrame, *, size: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """How much of each document the mix takes.

    docs needs doc_id, source and text (or the columns of size). Returns one row
    per input row: doc_id, size, source_size, target, copies, taken, and source
    where it is named in keep.

    Null text or text without words: size 0, never taken. Null source: a source
    of its own, last in order. Null doc_id: a document like others, first among
    ties. Rows alike in doc_id and size are interchangeable: each may be taken,
    and which of them is last doesn't change the result. An empty table gives an
    empty result. Other columns are ignored.
    """
    size = blank_word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialise(docs.select(F.col("doc_id"), F.col("source"), size.cast("long").alias("size"), key.alias("key")), "mix-sizes")
    n = max(1, 4 * math.isqrt(sized.count()))

    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / 2.0**32)
    sized = sized.withColumn("bucket", bucket)
    targets = fair_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, epochs=epochs)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "rank", "target")

    first = F.coalesce(F.col("doc_id"), F.lit(FIRST_ID))
    inside = W.partitionBy("source", "bucket").orderBy("key", first, "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        sized.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select("doc_id", "size", "key", "source_size", "target", "rank", "upto", *keep)
    )
    placed = materialise(placed, "mix-queue")

    served = (F.col("size") > 0) & (F.col("target") > 0)
    finish = F.try_divide(F.col("upto") + F.col("epoch") * F.col("source_size"), F.col("target"))
    queue = placed.where(served).withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(epochs)]))).withColumn("finish", finish)
    # Finish times from 0 to infinity onto n ranges, in order.
    ranged = lambda t: F.floor(t / (t + 1) * n)
    queue = queue.withColumn("range", ranged(F.col("finish")))
    upto = F.sum("in_range").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("in_range").over(W.partitionBy())
    budget = total / F.lit(float(epochs)) * F.lit(float(share))
    last = queue.groupBy("range").agg(F.sum("size").alias("in_range")).select("range", "in_range", upto.alias("upto"), budget.alias("budget"))
    last = last.where(F.col("upto") > F.col("budget")).orderBy("range").limit(1).collect()  # one row at most

    place = F.struct("finish", "rank", "key", first.alias("id"), "epoch", "size")
    if not last:
        taken = F.when(served, F.lit(epochs)).otherwise(F.lit(0))
    else:
        at, left = last[0]["range"], last[0]["budget"] - (last[0]["upto"] - last[0]["in_range"])
        running = F.sum("size").over(W.orderBy("finish", "rank", "key", first, "epoch", "size").rowsBetween(W.unboundedPreceding, 0))
        cut = queue.where(F.col("range") == at).withColumn("running", running).where(F.col("running") <= left).agg(F.max(place).alias("cut")).collect()[0]["cut"]
        taken = F.lit(0)
        for epoch in range(epochs):
            when = F.try_divide(F.col("upto") + epoch * F.col("source_size"), F.col("target"))
            mine = F.struct(when.alias("finish"), F.col("rank"), F.col("key"), first.alias("id"), F.lit(epoch).alias("epoch"), F.col("size"))
            within = ranged(when) < at
            if cut is not None:
                end = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["key"]).alias("key"), F.lit(cut["id"]).alias("id"), F.lit(cut["epoch"]).alias("epoch"), F.lit(cut["size"]).alias("size"))
                within = within | ((ranged(when) == at) & (mine <= end))
            taken = taken + F.when(served & F.coalesce(within, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("copies"), *keep).withColumn("taken", F.col("size") * F.col("copies"))


def op4_fair_mix(spark, sf_dir):
    from riskweave.llm.common import table

    mixed = mix_to_targets(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sums
), weighed AS (
  SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS most FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, rank, least(most::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, s.key, t.source_size, t.target, t.rank,
         (sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), queue AS (
  SELECT *, (upto + epoch * source_size) / target AS finish
  FROM placed, (SELECT unnest([0, 1]) AS epoch) e WHERE size > 0 AND target > 0
), served AS (
  SELECT doc_id, size,
         sum(size) OVER (ORDER BY finish, rank, key, doc_id, epoch, size ROWS UNBOUNDED PRECEDING)
           <= sum(size) OVER () / 2.0::DOUBLE * 1.5 AS inside
  FROM queue
), taken AS (
  SELECT doc_id, size, sum(CASE WHEN inside THEN size ELSE 0 END)::BIGINT AS taken FROM served GROUP BY doc_id, size
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.doc_id = t.doc_id AND p.size = t.size
"""
