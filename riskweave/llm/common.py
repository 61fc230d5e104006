"""What the operators of this subpackage share: words, shared storage, row keys.

Words come in two kinds, both fixed by the query contracts: *letters words* are
runs of anything but ASCII separators after A-Z have been lower-cased, *blank
words* are runs of anything but ASCII white space.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What stands between two letters words once A-Z are lower-cased.
LETTERS_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the byte-wise path of lower()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def letters_words(text: Column) -> Column:
    """Array of letters words; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), LETTERS_GAP), "")


def blank_word_count(text: Column) -> Column:
    """Number of blank words, as long; null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK_GAP))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session has none, a temporary folder is set up in local mode (as in
    tests) and noted in the session, so that later calls find the same one; on a
    cluster that is an error, as executors would write to folders of their own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            place = held.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            place = tempfile.mkdtemp(prefix="riskweave-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files, and a later
    job doesn't pass over the texts again. The files last as long as the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of at most `rows` rows for jobs that run inside: for rows with two long values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast df when its counted rows are within bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= bound else df


def positions(words: Column, per_word: int = 1) -> Column:
    """Generator of -1 (a row that stands for the document) and 0 .. per_word * size - 1."""
    return F.explode(F.sequence(F.lit(-1), F.size(words) * per_word - 1))
