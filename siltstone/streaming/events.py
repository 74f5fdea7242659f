"""Structured Streaming forms of the event metrics, and stateful operators.

A stream over a landing folder with ``availableNow`` gives the same rows as the batch query over the same files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.plans.materialise import ensure_checkpoint_dir

WATERMARK = "2 hours"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events as a stream of files, with an event time that has a zone."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the source takes no single file
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a stream through all available input into files on the shared checkpoint folder, and read them."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    found = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once per watermark; in a batch, its first row."""
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


BREAKER_SCHEMA = "user_id long, opened long, blocked long, calls long"


def circuit_breaker(events: DataFrame, failures: int = 3, open_s: int = 60, failed_below: float = 0.0) -> DataFrame:
    """Per user: ``failures`` failed calls in a row open the breaker for ``open_s`` seconds; how often, and calls blocked.

    State is one small row for each key, so a key's history may be of any length. A call fails if its value is null or at
    most ``failed_below``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, until, opened, blocked, calls = state.get if state.exists else (0, 0.0, 0, 0, 0)
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            for at, value in zip(pdf["ts"].astype("int64") / 1e9, pdf["value"]):
                calls += 1
                if at < until:
                    blocked += 1
                    continue
                run = run + 1 if pd.isna(value) or value <= failed_below else 0
                if run >= failures:
                    run, until, opened = 0, at + open_s, opened + 1
        state.update((run, until, opened, blocked, calls))
        yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "blocked": [blocked], "calls": [calls]})

    return events.groupBy("user_id").applyInPandasWithState(step, BREAKER_SCHEMA, "run long, until double, opened long, blocked long, calls long", "update", GroupStateTimeout.NoTimeout)
