"""Job flights as a stream: equal jobs join the one in flight, and the watermark closes a flight once its quiet gap has passed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(flights: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """Flights (first, last, joined, generation) that are at most gap apart become one: what coalesced() does, on a list."""
    out: list[tuple[int, int, int, int]] = []
    for f in sorted(flights):
        if out and f[0] - out[-1][1] <= gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], f[1]), a[2] + f[2], max(a[3], f[3]))
        else:
            out.append(f)
    return out


def coalesced(jobs: DataFrame, keys: list[str], gap: int, late: str) -> DataFrame:
    """keys, first_seq, joined, generation of a stream of jobs (keys, seq, generation); seq is the event time in milliseconds.

    A flight is a session of its key: a few numbers in the state, whatever joins it. Jobs may come in any order inside the watermark's delay;
    one between two flights makes them one. A flight comes out once the watermark, late behind the newest job, has passed its last job by
    more than gap. A null key is a key.
    """
    timed = jobs.select(*keys, "seq", "generation", F.timestamp_millis("seq").alias("at")).withWatermark("at", late)
    quiet = F.session_window("at", f"{1000 * gap + 500} microseconds")  # between gap and the next millisecond
    out = timed.groupBy(*keys, quiet.alias("s")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("joined"), F.max("generation").alias("generation"))
    return out.select(*keys, "first_seq", "joined", "generation")


def cancelled(jobs: DataFrame, cancels: DataFrame, early: str, long: str, late: str) -> DataFrame:
    """id, outcome of a stream of jobs (id, starts, ends) against a stream of cancels (job, at): a left outer join under watermarks.

    A cancel up to early before the start stops a job before it starts, one until its end stops it while it runs; a later one, or none,
    leaves it done. Jobs last less than long, which bounds the state of both sides; a job comes out at its cancel or once the watermark rules one
    out. A job has one cancel at most.
    """
    j, c = jobs.withWatermark("starts", late), cancels.withWatermark("at", late)
    near = (F.col("job") == F.col("id")) & (F.col("at") >= F.col("starts") - F.expr(f"INTERVAL {early}")) & (F.col("at") <= F.col("starts") + F.expr(f"INTERVAL {long}"))
    return j.join(c, near, "left_outer").select("id", outcome().alias("outcome"))


def outcome():
    return F.when(F.col("at").isNull() | (F.col("at") > F.col("ends")), "done").when(F.col("at") < F.col("starts"), "cancelled before it started").otherwise("cancelled while it ran")


def drained_to_files(stream: DataFrame, folder: str, *closing: Callable[[], None]) -> DataFrame:
    """Run a stream (append mode) over what its sources hold now, into Parquet files, and read these; the driver holds no rows.

    closing: what closed() gave. After all else has been read, the closing events are written and the stream goes on from its checkpoint.
    """
    spark, name = stream.sparkSession, uuid.uuid4().hex
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        for close in (None, lambda: [c() for c in closing])[: 2 if closing else 1]:
            if close:
                close()
            q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out-{name}").option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out-{name}")


def closed(stream: DataFrame, last: DataFrame, folder: str) -> tuple[DataFrame, Callable[[], None]]:
    """(stream with a source of closing events beside it, what writes these: the rows of last, a small table).

    Their time must be later than all others' by more than the watermark's delay; then everything before them comes out.
    """
    path = f"{folder}/closing-{uuid.uuid4().hex}"
    rows = last.select(*[F.col(c).cast(stream.schema[c].dataType) for c in stream.columns])
    rows.limit(0).write.parquet(path)
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(path)), lambda: rows.write.mode("append").parquet(path)
