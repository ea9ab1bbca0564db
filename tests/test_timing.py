"""Sweeps and dense numbers against plain Python."""

import random

from pyspark.sql import functions as F

from lumenframe.operators import timing


def test_sweeps(spark):
    r = random.Random(5)
    rows = []
    for lane in range(4):
        for _ in range(300):
            s = r.randrange(0, 5000)
            rows.append((lane, s, s + r.choice([0, 0, 1, 3, 40, 900 if lane == 1 else 2])))
    rows += [(9, 7, 7)] * 3 + [(8, 0, 100_000), (8, 50_000, 50_001)]
    log = spark.createDataFrame(rows, "lane int, start_us long, end_us long")
    for span in (1, 64, 10**9):
        union = {x["lane"]: (x["islands"], x["union_us"]) for x in timing.interval_union(log, ["lane"], span=span).collect()}
        water = {x["lane"]: x["high_water"] for x in timing.high_water(log, ["lane"], span=span).collect()}
        for lane in {x[0] for x in rows}:
            mine = sorted(x[1:] for x in rows if x[0] == lane)
            islands, total, high = 0, 0, None
            for s, e in mine:
                if high is None or s > high:
                    islands, total, high = islands + 1, total + e - s, e
                elif e > high:
                    total, high = total + e - high, e
            assert union[lane] == (islands, total)
            steps = sorted([(s, 1) for s, _ in mine] + [(e, -1) for _, e in mine])
            opened = most = 0
            for _, d in steps:
                opened += d
                most = max(most, opened)
            assert water[lane] == most


def test_a_hot_lane_is_split(spark):
    """All rows of one lane: what the inner windows sort by is dealt out by slices, not by lanes."""
    log = spark.range(2000).select((F.col("id") >= 0).cast("int").alias("lane"), (F.col("id") * 1000).alias("start_us"), (F.col("id") * 1000 + 500).alias("end_us"))
    plan = timing.interval_union(log, ["lane"], span=10_000)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "max(__end" in x]
    assert windows and all("__slice#" in x for x in windows)
    assert timing.interval_union(log, ["lane"], span=10_000).first()["islands"] == 2000


def test_dense_ids(spark):
    r = random.Random(6)
    rows = [(f"k{r.randrange(500)}", r.choice([r.randrange(1 << 60), 5, 5])) for _ in range(3000)] + [("none", None)]
    log = spark.createDataFrame(rows, "lane string, t long")
    first = {}
    for k, t in rows:
        first[k] = min(first.get(k, t), t) if t is not None else None
    want = sorted(first, key=lambda k: (first[k] is not None, first[k] or 0, k))
    for slices in (1, 7, 1024):
        made = timing.first_seen_ids(log, "lane", "t", slices)
        assert {x["lane"]: x["dense_id"] for x in made.collect()} == {k: i for i, k in enumerate(want)}
        assert "SinglePartition" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in x)
    assert timing.first_seen_ids(log.limit(0), "lane", "t").count() == 0
