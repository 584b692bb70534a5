"""A streaming monitor of call traces: counts by window, sessions by user, last state per source.

Late rows are dropped by the watermark in append mode; `counts` in update mode keeps correcting
a window until the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.session import shared_path


def read_events(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n, total by tumbling window; works on streams and tables alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    out = rows.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user, session_start, n: runs of events no further apart than the gap."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("session_start"), "n")


def running_counts(events: DataFrame, user: str = "user_id") -> DataFrame:
    """user, n: rows seen so far, a line for each user a batch touches; arbitrary state, for streams."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({user: [key[0]], "n": [n]})

    return events.groupBy(user).applyInPandasWithState(step, f"{user} bigint, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give the state after its last batch, written to the shared folder with its checkpoint."""
    spark = stream.sparkSession
    base = shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/table")  # a batch that is run again writes the same

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
