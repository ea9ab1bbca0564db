"""Streams in several shuffled batches against their batch twins; late and early cancels; closing events."""

import random

import pytest

from lumenframe.operators import pool
from lumenframe.streaming import flights


def files_of(spark, rows, schema, folder, batches):
    """Rows dealt out over a folder's files; a stream reads one file a batch, in the order of writing."""
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_merged_flights():
    assert flights.merged([(10, 10, 1, 5), (0, 0, 1, 9), (4, 6, 2, 1)], 4) == [(0, 10, 4, 9)]
    assert flights.merged([(10, 10, 1, 5), (0, 0, 1, 9)], 4) == [(0, 0, 1, 9), (10, 10, 1, 5)]


def test_shuffled_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    schema = "seq long, type string, path long, generation long"
    rows = [(r.randrange(10**6), r.choice(["a", "b", None]), r.choice([1, 2, None]), r.randrange(100)) for _ in range(400)]
    live, close = flights.closed(files_of(spark, rows, schema, tmp_path / "in", 3), spark.createDataFrame([(10**9, None, None, 0)], schema), str(tmp_path))
    got = flights.drained_to_files(flights.coalesced(live, ["type", "path"], 5000, "2000 seconds"), str(tmp_path), close).where("first_seq < 10000000")
    want = pool.coalesce_jobs(spark.createDataFrame(rows, schema), ["type", "path"], "seq", 5000).drop("run")
    key = lambda df: sorted((tuple(x[c] for c in ("type", "path", "first_seq", "joined", "generation")) for x in df.collect()), key=str)
    assert key(got) == key(want)


def test_cancels(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    jobs = [(1, 100, 200), (2, 100, 200), (3, 100, 200), (4, 100, 200), (5, 100, 100)]
    asks = [(1, 150), (2, 50), (3, 201), (5, 100), (77, 100)]
    j = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in jobs], "id long, starts string, ends string").selectExpr("id", "cast(starts as timestamp) starts", "cast(ends as timestamp) ends")
    c = spark.createDataFrame([(i, at(a)) for i, a in asks], "job long, at string").selectExpr("job", "cast(at as timestamp) at")
    j.write.parquet(str(tmp_path / "j"))
    c.write.parquet(str(tmp_path / "c"))
    far = "TIMESTAMP '2999-01-01 00:00:00'"
    live_j, close_j = flights.closed(spark.readStream.schema(j.schema).parquet(str(tmp_path / "j")), spark.sql(f"SELECT -1L id, {far} starts, {far} ends"), str(tmp_path))
    live_c, close_c = flights.closed(spark.readStream.schema(c.schema).parquet(str(tmp_path / "c")), spark.sql(f"SELECT -2L job, {far} at"), str(tmp_path))
    got = {r["id"]: r["outcome"] for r in flights.drained_to_files(flights.cancelled(live_j, live_c, "10 minutes", "10 minutes", "1 hour"), str(tmp_path), close_j, close_c).where("id > 0").collect()}
    assert got == {1: "cancelled while it ran", 2: "cancelled before it started", 3: "done", 4: "done", 5: "cancelled while it ran"}


@pytest.mark.parametrize("pair", [("q_stream_coalesce", "q_coalesce_five"), ("q_stream_cancel", "q_cancel"), ("q_stream_idle_closed", "q_idle_shrink")])
def test_streams_equal_their_batch_twins(spark, sf_dir, pair):
    from lumenframe.plans import all_queries

    a, b = (all_queries()[q](spark, sf_dir) for q in pair)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
