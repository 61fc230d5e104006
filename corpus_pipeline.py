"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of documents; extra columns pass through, whatever their names. Empty
tables pass through all stages. Texts of any length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import blank_word_count, broadcast_if, materialise, table
from riskweave.llm.decontaminate import find_contamination
from riskweave.llm.fair_mix import mix_to_targets
from riskweave.llm.line_templates import drop_template_lines
from riskweave.llm.minhash import near_duplicates
from riskweave.llm.pu_quality import keep_quality

BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose texts the classifier predicts to be of quality.

    Judged row by row, on the text alone: null doc_ids are judged like others,
    equal texts alike, repeated rows each; null and empty texts have one score.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines of recurring templates out of the texts; no document goes.

    A text of nothing but such lines stays as it is, as what is left of it could
    no longer be compared by near-dedup, the next stage. Null and empty texts
    stay; equal lines all go or all stay; repeated rows are treated alike.
    """
    return drop_template_lines(docs, leave_bare=False).toDF(*docs.columns, "lines dropped here").drop("lines dropped here")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near-duplicates (five words, 0.8).

    Rows that repeat a doc_id are one document and stay or go together. Rows
    without doc_id, text or words are linked with nothing and stay.
    """
    gone = materialise(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(broadcast_if(gone, gone.count(), BROADCAST_ROWS), docs["doc_id"] == gone["gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose texts hold a window of a benchmark item.

    Rows are told by a digest of the text, not by doc_id: one without doc_id goes
    like any other, and of two rows with one doc_id only that with the passage.
    Null and empty texts stay.
    """
    found = find_contamination(docs.select(F.md5("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(broadcast_if(gone, gone.count(), BROADCAST_ROWS), F.md5(docs["text"]) == gone["gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows that it takes, with the number of copies and of words taken (columns of these names are replaced).

    Texts without words aren't taken. Of rows alike in doc_id, source and number of
    words (ties) the first by text get the larger numbers of copies, so that together
    they take what the mix gives them.
    """
    docs = docs.drop("copies", "taken")
    key = materialise(mix_to_targets(docs, keep=("source",)).select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "copies"), "copies")
    groups = key.groupBy("t_id", "t_source", "t_size").agg(F.min("copies").alias("least"), F.max("copies").alias("copies"))
    groups = materialise(groups.where(F.col("copies") > 0), "taken")
    same = docs["doc_id"].eqNullSafe(groups["t_id"]) & docs["source"].eqNullSafe(groups["t_source"]) & (blank_word_count(docs["text"]) == groups["t_size"])
    met = docs.join(broadcast_if(groups, groups.count(), BROADCAST_ROWS // 4), same)
    even = met.where(groups["least"] == groups["copies"]).select(*[docs[c] for c in docs.columns], groups["copies"], (groups["copies"] * groups["t_size"]).alias("taken"))
    uneven = groups.where(F.col("least") < F.col("copies"))
    if uneven.isEmpty():
        return even
    # Rows alike of which not all have as many copies are numbered, by copies there and by text here.
    mine = key.join(uneven.select("t_id", "t_source", "t_size").toDF("u_id", "u_source", "u_size"), F.col("t_id").eqNullSafe(F.col("u_id")) & F.col("t_source").eqNullSafe(F.col("u_source")) & (F.col("t_size") == F.col("u_size")), "left_semi")
    mine = mine.select(F.col("t_id").alias("n_id"), F.col("t_source").alias("n_source"), F.col("t_size").alias("n_size"), F.col("copies").alias("n_copies"), F.row_number().over(W.partitionBy("t_id", "t_source", "t_size").orderBy(F.desc("copies"))).alias("n_place"))
    place = F.row_number().over(W.partitionBy(groups["t_id"], groups["t_source"], groups["t_size"]).orderBy(F.md5(docs["text"])))
    rows = met.where(groups["least"] < groups["copies"]).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), groups["t_id"], groups["t_source"], groups["t_size"], place.alias("place"))
    given = rows.join(mine, rows["t_id"].eqNullSafe(mine["n_id"]) & rows["t_source"].eqNullSafe(mine["n_source"]) & (rows["t_size"] == mine["n_size"]) & (rows["place"] == mine["n_place"]))
    return even.unionByName(given.where(F.col("n_copies") > 0).select("row.*", F.col("n_copies").alias("copies"), (F.col("n_copies") * F.col("n_size")).alias("taken")))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]

#: SQL can't express the classifier; a test compares run() with a brute-force version that takes the classifier's scores as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
