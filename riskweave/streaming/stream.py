"""Transactions as streams: windows with watermarks, keyed state, alert sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, path: str, *, files: int | None = 1, watermark: str = "1 hour") -> DataFrame:
    """Parquet files of events under path, in arrival order, with a watermark on ts.

    A stored table's files are in no order of time, and what comes behind the watermark
    is dropped where state expires: with files=None all that is there is one batch.
    """
    reader = spark.readStream.schema(EVENT)
    raw = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    return stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(stream: DataFrame, width: str = "6 hours", step: str = "1 hour") -> DataFrame:
    return stream.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n", F.round("total", 4).alias("total"))


def velocity_state(stream: DataFrame, days: int = 30) -> DataFrame:
    """event_id, user_id, velocity_1h, gap_seconds of each event from keyed state.

    State: times of the last hour, which are pruned as time goes on, and the last
    time seen, which outlives them and goes after `days` without events. An account's
    events of a batch may come in several frames, and are put in order over all of them.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, last = state.get if state.exists else ([], None)
        rows = []
        for event, ts in sorted((x for frame in frames for x in zip(frame["event_id"], frame["ts"], strict=True)), key=lambda x: (x[1], x[0])):
            us = int(ts.value // 1000)
            recent = [t for t in recent if t >= us - 3_600_000_000] + [us]
            rows.append((event, key[0], len(recent), max(0.0, (us - last) / 1e6) if last is not None else 0.0))
            last = us
        state.update((recent, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + days * 86_400_000)
        yield pd.DataFrame(rows, columns=["event_id", "user_id", "velocity_1h", "gap_seconds"])

    out = "event_id long, user_id long, velocity_1h long, gap_seconds double"
    return stream.select("event_id", "ts", "user_id").groupBy("user_id").applyInPandasWithState(run, out, "recent array<long>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def enrich(stream: DataFrame, accounts: DataFrame) -> DataFrame:
    """Stream-static left join with accounts (user_id, ...)."""
    return stream.join(accounts, "user_id", "left")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there as Parquet, exactly once, and end."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def alert_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "tx_id"):
    """Append each batch's rows to a Parquet table, under the batch's number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
