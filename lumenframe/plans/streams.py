"""Streaming queries, run to the end of their input. They have batch twins with SQL: idle_shrink and coalesce."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pool
from ..operators.folders import work_folder
from ..sources.fixtures import jobs, table
from ..streaming import flights
from ..streaming import jobs as streams
from .registry import query


def _stream(spark, d, name: str):
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parq*")


@query()
def q_stream_idle_shrink(spark, d):
    e = _stream(spark, d, "events").select((F.col("user_id") % 16).alias("pool"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.drained(streams.idle_sessions(e, "pool", "ts", "10 minutes", "1 hour"), "append", work_folder(spark))


@query()
def q_stream_generation(spark, d):
    j = jobs_of(_stream(spark, d, "lineitem"))
    out = streams.drained(streams.newest_generation(j, "path", "seq"), "update", work_folder(spark))
    return out.groupBy("path").agg(F.max("joined").alias("joined"), F.max("generation").alias("generation"))


def jobs_of(lineitem):
    return lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("generation"))


@query("SELECT l_partkey AS path, count(*) AS joined, max(l_orderkey) AS generation FROM lineitem GROUP BY 1")
def q_batch_generation(spark, d):
    """The batch twin of q_stream_generation."""
    return jobs(spark, d).groupBy("path").agg(F.count("*").alias("joined"), F.max("generation").alias("generation"))


# flights by all five fields, and cancels

FIVE = ["type", "path", "max_dim", "orientation", "format"]


def _flights_of(events):
    """Events as jobs: what is asked for, of which file, how large, turned how, as what; seq is the time in milliseconds."""
    c, value = F.col, F.coalesce("value", F.lit(0.0))
    return events.select(
        F.unix_millis(c("ts").cast("timestamp")).alias("seq"), c("event_type").alias("type"), (c("user_id") % 40).alias("path"), F.floor(value / 200).cast("long").alias("max_dim"),
        F.when(F.hour("ts") < 12, 6).otherwise(1).alias("orientation"), F.when(c("value").isNotNull(), "rgba").alias("format"), c("event_id").alias("generation"),
    )


FLIGHTS = """f AS (SELECT epoch_us(ts) // 1000 AS seq, event_type AS type, user_id % 40 AS path, CAST(floor(coalesce(value, 0.0) / 200) AS BIGINT) AS max_dim, CASE WHEN hour(ts) < 12 THEN 6 ELSE 1 END AS orientation, CASE WHEN value IS NOT NULL THEN 'rgba' END AS format, event_id AS generation FROM events),
m AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY type, path, max_dim, orientation, format ORDER BY seq) <= 20000000 THEN 0 ELSE 1 END AS o FROM f),
r AS (SELECT *, sum(o) OVER (PARTITION BY type, path, max_dim, orientation, format ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT type, path, max_dim, orientation, format, min(seq) AS first_seq, count(*) AS joined, max(generation) AS generation FROM r GROUP BY type, path, max_dim, orientation, format, run"""
GAP = 20_000_000


@query(f"WITH {FLIGHTS}")
def q_coalesce_five(spark, d):
    """Flights by type, path, size, orientation and format."""
    return pool.coalesce_jobs(_flights_of(table(spark, d, "events")), FIVE, "seq", GAP).drop("run")


@query(f"WITH {FLIGHTS}")
def q_stream_coalesce(spark, d):
    """The same as a stream of sessions, closed by an event behind all others."""
    folder, live = work_folder(spark), _flights_of(_stream(spark, d, "events"))
    end = spark.createDataFrame([(10**14, None, None, None, None, None, 0)], "seq long, type string, path long, max_dim long, orientation int, format string, generation long")
    live, close = flights.closed(live, end, folder)
    return flights.drained_to_files(flights.coalesced(live, FIVE, GAP, "3650 days"), folder, close).where(F.col("first_seq") < 10**14)


def _decodes_of(events):
    starts = F.col("ts").cast("timestamp")
    return events.select(F.col("event_id").alias("id"), starts.alias("starts"), F.timestamp_micros(F.unix_micros(starts) + F.floor(F.coalesce("value", F.lit(0.0)) * 1000000)).alias("ends"))


def _cancels_of(events):
    """Clicks and errors ask for their job's end, from 300 seconds before its start to 100 after it."""
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor((100 - F.least(F.coalesce("value", F.lit(0.0)), F.lit(400.0))) * 1000000))
    return events.where(F.col("event_type").isin("click", "error")).select(F.col("event_id").alias("job"), at.alias("at"))


CANCELS = """SELECT event_id AS id, CASE WHEN event_type NOT IN ('click', 'error') OR asked > ends THEN 'done' WHEN asked < starts THEN 'cancelled before it started' ELSE 'cancelled while it ran' END AS outcome
FROM (SELECT event_id, event_type, epoch_us(ts) AS starts, epoch_us(ts) + CAST(floor(coalesce(value, 0.0) * 1000000) AS BIGINT) AS ends, epoch_us(ts) + CAST(floor((100 - least(coalesce(value, 0.0), 400.0)) * 1000000) AS BIGINT) AS asked FROM events)"""


@query(CANCELS)
def q_cancel(spark, d):
    """What becomes of each job: done, or cancelled before it started or while it ran."""
    e = table(spark, d, "events")
    return _decodes_of(e).join(_cancels_of(e), F.col("job") == F.col("id"), "left").select("id", flights.outcome().alias("outcome"))


@query(CANCELS)
def q_stream_cancel(spark, d):
    """The same as a join of two streams, each closed by an event behind all others."""
    folder, e = work_folder(spark), _stream(spark, d, "events")
    far = "TIMESTAMP '2999-01-01 00:00:00'"
    jobs_, close_jobs = flights.closed(_decodes_of(e), spark.sql(f"SELECT -1L AS id, {far} AS starts, {far} AS ends"), folder)
    cancels, close_cancels = flights.closed(_cancels_of(e), spark.sql(f"SELECT -2L AS job, {far} AS at"), folder)
    return flights.drained_to_files(flights.cancelled(jobs_, cancels, "10 minutes", "10 minutes", "3650 days"), folder, close_jobs, close_cancels).where("id >= 0")


@query(
    """WITH e AS (SELECT user_id % 16 AS pool, ts, event_id FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY pool ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS o FROM e),
s AS (SELECT *, sum(o) OVER (PARTITION BY pool ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT pool, epoch_us(min(ts)) AS opened_us, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS closed_us, count(*) AS n FROM s GROUP BY pool, k"""
)
def q_stream_idle_closed(spark, d):
    """Idle sessions as a stream that a closing event ends, so that every session comes out."""
    folder = work_folder(spark)
    e = _stream(spark, d, "events").select((F.col("user_id") % 16).alias("pool"), F.col("ts").cast("timestamp").alias("ts"))
    live, close = flights.closed(e, spark.sql("SELECT -1L AS pool, TIMESTAMP '2999-01-01 00:00:00' AS ts"), folder)
    out = flights.drained_to_files(streams.idle_sessions(live, "pool", "ts", "10 minutes", "3650 days"), folder, close)
    return out.where("pool >= 0").select("pool", F.unix_micros("opened").alias("opened_us"), F.unix_micros("closed").alias("closed_us"), "n")
