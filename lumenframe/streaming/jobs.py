"""Streaming forms of the job-pool operators. Each has a batch twin in operators.pool that an oracle checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def idle_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """key, opened, closed, n of a stream: a session is emitted once the watermark has passed its quiet gap."""
    watched = events.withWatermark(time, late)
    sessions = watched.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n")


def newest_generation(jobs: DataFrame, key: str, order: str) -> DataFrame:
    """key, joined, generation of a stream: for each key the jobs that joined so far and the largest generation.

    The state is two numbers a key. A row is emitted for each key of each micro-batch.
    """
    kind = jobs.schema[key].dataType.simpleString()

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        joined, newest = state.get if state.exists else (0, -1)
        for f in frames:
            joined, newest = joined + len(f), max(newest, int(f["generation"].max()))
        state.update((joined, newest))
        yield pd.DataFrame({key: [k[0]], "joined": [joined], "generation": [newest]})

    return jobs.select(key, order, "generation").groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, joined long, generation long", "joined long, generation long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what its source holds now and return what it has put out. Its offsets and state go to folder."""
    spark: SparkSession = stream.sparkSession
    name = f"out_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
