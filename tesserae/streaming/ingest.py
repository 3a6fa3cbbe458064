"""Streams, as an extension: incremental upserts of chunks, windowed counts with late data, and threads that keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunking, store


def index_stream(elements: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Chunks each batch of element rows and replaces its documents in the table at path. A batch that runs again gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(batch.sparkSession, path, chunking.chunk(batch), buckets, batch.select("doc_id"))

    return elements.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in tumbling or sliding windows; rows later than late are left out."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of an event_id that come within late."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, turns, last_question) after each batch of messages (conv_id, turn, role, text), with a state for each thread."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, last, question = state.get if state.exists else (0, -1, "")
        for batch in batches:
            turns += len(batch)
            asked = batch[(batch["role"] == "user") & (batch["turn"] > last)]
            if len(asked):
                row = asked.loc[asked["turn"].idxmax()]
                last, question = int(row["turn"]), row["text"]
        state.update((turns, last, question))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "last_question": [question]})

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, turns bigint, last_question string", "turns bigint, last bigint, question string", "update", GroupStateTimeout.NoTimeout)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)
