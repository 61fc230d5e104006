"""Schemas, scans and sinks.

The test tables are no transactions; txn() reads the events table as one, in the
schema the operators share.
"""

from __future__ import annotations

import json
import re
import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import scalars as S

_D, _S, _B, _I, _TS = T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
# Columns of a transaction stream.
TRANSACTION = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("transaction_id", _S), ("timestamp", _TS), ("sender_account", _S), ("receiver_account", _S), ("sender_bank", _S), ("receiver_bank", _S),
            ("sender_country", _S), ("receiver_country", _S), ("amount", _D), ("currency", _S), ("transaction_type", _S), ("payment_channel", _S),
            ("device_id", _S), ("ip_address", _S), ("geo_latitude", _D), ("geo_longitude", _D), ("merchant_category", _S), ("transaction_status", _S),
            ("sender_balance_before", _D), ("sender_balance_after", _D), ("receiver_balance_before", _D), ("receiver_balance_after", _D),
            ("is_international", _B), ("remarks", _S), ("amount_leading_digit", _I),
        )
    ]
)
LABELS = ("is_suspicious", "fraud_ring_id", "laundering_stage", "synthetic_pattern_type")
ALERT_CSV = ("alert_id", "transaction_id", "sender_account", "receiver_account", "transaction_risk_score", "group_risk_score", "risk_level", "status", "triggered_patterns", "created_at")
# Countries of the test view, by number.
COUNTRIES = ("IN", "AE", "MU", "CN", "NG", "PK", "US", "GB", "SG", "DE")


class ArtifactNotFound(FileNotFoundError):
    """No artifact of that name in the store."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder in its place in local mode alone."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    """Microseconds since 1970, of a timestamp without zone as well."""
    return F.unix_micros(ts.cast("timestamp"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions, row by row: the receiver is a user told by sender and event, one of those up to the greatest user_id."""
    events = table(spark, sf_dir, "events")
    users = events.agg((F.max("user_id") + 1).alias("users"))
    k = F.get_json_object("props", "$.k").cast("int")
    named = F.array(*[F.lit(c) for c in COUNTRIES])
    receiver = (F.col("user_id") + F.col("event_id") * 7919 + 13) % F.col("users")
    events = events.join(F.broadcast(users))  # users is one row
    at = events.select(
        F.col("event_id").alias("tx_id"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("us"), F.col("user_id").alias("sender"), receiver.alias("receiver"),
        F.round(F.col("value") * 20000, 2).alias("amount"), F.col("event_type").alias("channel"), k.alias("k"),
    ).where(F.col("receiver").isNotNull())
    return at.select(
        "*", (F.col("k") % 20).alias("device"), (F.col("k") % 15).alias("ip"), F.element_at(named, (F.col("k") % 10) + 1).alias("country"), F.element_at(named, (F.col("receiver") % 10).cast("int") + 1).alias("receiver_country"),
        (F.col("k") % 10 != F.col("receiver") % 10).alias("international"), (F.col("k") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("k") * 53 % 360 - 180).cast("double").alias("lon"), (F.col("sender") % 4).cast("int").alias("kyc"),
    )


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of transactions with the declared schema, in stable time order."""
    return spark.read.schema(TRANSACTION).csv(path, header=True).orderBy("timestamp", "transaction_id")


def read_database(spark: SparkSession, url: str, query: str, schema: T.StructType, *, driver: str | None = None, **options: str) -> DataFrame:
    """Rows of a database query whose columns are an id and JSON: the JSON column (the last one) is parsed with schema."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).options(**options)
    rows = (reader.option("driver", driver) if driver else reader).load()
    *ids, body = rows.columns
    return rows.select(*ids, F.from_json(F.col(body).cast("string"), schema).alias("body")).select(*ids, "body.*")


def export_split(split: DataFrame, truth: DataFrame, path: str, labels: tuple[str, ...] = LABELS) -> None:
    """Write historical and stream transactions (part: hist, stream) as CSV without any label, and the truth beside them."""
    plain = split.drop(*labels)
    for part, name in (("hist", "historical_transactions"), ("stream", "stream_transactions")):
        plain.where(F.col("part") == part).drop("part").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    truth.write.mode("overwrite").option("header", True).csv(f"{path}/hidden_ground_truth")


def write_joined(joined: DataFrame, path: str) -> DataFrame:
    """Write the joined evaluation frame as Parquet, and read it back."""
    joined.write.mode("overwrite").parquet(path)
    return joined.sparkSession.read.schema(joined.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty frame of that schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_upload(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploaded rows (all strings) as transactions with defaults, and the rows that cannot be: with their errors."""
    amount, at = F.expr("try_cast(amount AS double)"), F.expr("try_cast(timestamp AS timestamp)")
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("sender_account"), F.lit("")) == "", F.lit("sender_account is missing")),
            F.when(F.coalesce(F.trim("receiver_account"), F.lit("")) == "", F.lit("receiver_account is missing")),
            F.when(amount.isNull(), F.lit("amount is no number")),
            F.when(at.isNull(), F.lit("timestamp cannot be read")),
        )
    )
    seen = raw.withColumn("errors", errors)
    good = seen.where(F.size("errors") == 0).select(
        F.coalesce("transaction_id", F.sha2(F.concat_ws("|", "sender_account", "receiver_account", "amount", "timestamp"), 256)).alias("transaction_id"), at.alias("timestamp"), "sender_account", "receiver_account", amount.alias("amount"),
        F.coalesce("currency", F.lit("INR")).alias("currency"), F.coalesce("payment_channel", F.lit("Web")).alias("payment_channel"), S.truth(F.col("is_international")).alias("is_international"), S.clipped_digit(amount).alias("amount_leading_digit"),
    )
    return good, seen.where(F.size("errors") > 0)


def keep_present(df: DataFrame, wanted: tuple[str, ...], key: str) -> DataFrame:
    """The wanted columns that df has, one row a key."""
    return df.select(*[c for c in wanted if c in df.columns]).dropDuplicates([key])


def alerts_csv(alerts: DataFrame) -> DataFrame:
    """Alerts as the ten text columns of the export: scores with four decimals, patterns as JSON."""
    out = alerts.withColumn("triggered_patterns", F.to_json("triggered_patterns"))
    for c in ("transaction_risk_score", "group_risk_score"):
        out = out.withColumn(c, F.format_string("%.4f", c))
    return out.select(*ALERT_CSV)


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    """Metrics as one JSON document."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


class ArtifactStore:
    """Named Parquet artifacts under a base path, which any Hadoop file system may serve."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str):
        if not name or name.startswith("/") or ".." in Path(name).parts:
            raise ValueError(f"not an artifact name: {name!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path.suffix("/_SUCCESS"))

    def save(self, name: str, df: DataFrame) -> str:
        self._path(name)
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return f"{self.base}/{name}"

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ArtifactNotFound(f"{self.base}/{name}")
        return self.spark.read.parquet(f"{self.base}/{name}")

    def delete(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.delete(path, True)

    def names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


#: DuckDB's form of txn().
TXN_SQL = f"""txn AS (
  SELECT *, k % 20 AS device, k % 15 AS ip, {list(COUNTRIES)}[k % 10 + 1] AS country, {list(COUNTRIES)}[(receiver % 10)::INT + 1] AS receiver_country,
    k % 10 <> receiver % 10 AS international, (k * 37 % 180 - 90)::DOUBLE AS lat, (k * 53 % 360 - 180)::DOUBLE AS lon, (sender % 4)::INT AS kyc
  FROM (SELECT event_id AS tx_id, ts, epoch_us(ts) AS us, user_id AS sender, (user_id + event_id * 7919 + 13) % (SELECT max(user_id) + 1 FROM events) AS receiver,
      round(value * 20000, 2) AS amount, event_type AS channel, json_extract(props, '$.k')::INT AS k FROM events)
  WHERE receiver IS NOT NULL)"""
