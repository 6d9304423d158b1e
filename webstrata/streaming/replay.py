"""Streams: events replayed from files, windows with watermarks, item windows, hop depths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replayed(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; admission is bounded, nothing is dropped."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type and tumbling window; events later than the watermark go."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def item_windows(captures: DataFrame) -> DataFrame:
    """First and last capture of each item so far; late captures widen a window, none is dropped."""
    return captures.groupBy("canonical_url").agg(F.min("fetched_at").alias("first_captured_at"), F.max("fetched_at").alias("last_captured_at"))


def silences(events: DataFrame) -> DataFrame:
    """Per host, how many requests in a row went unanswered: takes host, seq, answered; gives host, silences, longest after each batch."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, longest = state.get if state.exists else (0, 0)
        for frame in frames:
            for ok in frame.sort_values("seq")["answered"]:
                now = 0 if ok else now + 1
                longest = max(longest, now)
        state.update((now, longest))
        yield pd.DataFrame({"host": [key[0]], "silences": [now], "longest": [longest]})

    return events.groupBy("host").applyInPandasWithState(step, "host string, silences long, longest long", "now long, longest long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, into a table in memory (for tests and small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
