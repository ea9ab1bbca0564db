"""What keeps work and memory from growing faster than the tables."""

from lumenframe.operators import pool
from lumenframe.streaming import flights


def test_tasks_follow_the_rows(spark):
    rows = spark.range(1000)
    assert pool.dealt(rows, ["id"], most=20).rdd.getNumPartitions() == 50
    assert pool.dealt(rows, ["id"]).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_flights_end_behind_the_gap(spark, tmp_path):
    """Jobs that are gap apart are one flight, one millisecond more makes two; the flight's sessions are built in, without Python."""
    schema = "seq long, path long, generation long"
    spark.createDataFrame([(0, 1, 3), (100, 1, 2), (201, 1, 1), (0, None, 9)], schema).write.parquet(str(tmp_path / "in"))
    live, close = flights.closed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.createDataFrame([(10**9, -1, 0)], schema), str(tmp_path))
    stream = flights.coalesced(live, ["path"], 100, "1 hour")
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString()
    got = flights.drained_to_files(stream, str(tmp_path), close).where("first_seq < 1000")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 2, 3), (1, 201, 1, 1), (None, 0, 1, 9)], key=str)
