"""Structured Streaming forms of the rate and hysteresis operators, run to completion over the events table.

Each job reads the events as a stream and stops when all present input is processed; its result is the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.plans.registry import query
from millrace.sources.tables import work_folder


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: event_id, user_id, ts, bytes."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("bytes"), F.col("event_type").alias("kind"))


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all present input into Parquet files, and reads them."""
    started = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "stream01_windowed_rates",
    "SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def windowed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows under a watermark: in append mode a window is written once the watermark passes its end."""
    rows = events_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    rates = rows.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    out = run_available(rates.select("user_id", F.col("w.start").alias("day"), "bytes", "n"), work_folder(spark))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


def hysteresis(high: int, low: int):
    """State function: on above high, off below low; emits each user's changes in order of event id within a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (on,) = state.get if state.exists else (False,)
        rows = pd.concat(list(frames)).sort_values("event_id")
        changes = []
        for event, n in zip(rows["event_id"].tolist(), rows["bytes"].tolist()):
            now = n > high or (on and n >= low)
            if now != on:
                changes.append((key[0], event, now))
            on = now
        state.update((on,))
        yield pd.DataFrame(changes, columns=["user_id", "event_id", "paused"]).astype({"user_id": "int64", "event_id": "int64", "paused": "bool"})

    return step


@query(
    "stream02_hysteresis_changes",
    """WITH s AS (SELECT user_id, event_id, coalesce(last_value(CASE WHEN bytes > 45000 THEN true WHEN bytes < 20000 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), false) AS paused FROM push_events),
    c AS (SELECT *, lag(paused, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s) SELECT user_id, event_id, paused FROM c WHERE paused <> before""",
)
def hysteresis_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_stream(spark, sf_dir).select("user_id", "event_id", "bytes")
    changed = rows.groupBy("user_id").applyInPandasWithState(hysteresis(45_000, 20_000), "user_id long, event_id long, paused boolean", "paused boolean", "append", GroupStateTimeout.NoTimeout)
    return run_available(changed, work_folder(spark))
