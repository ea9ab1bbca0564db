"""Known answers: constant fields, exhaustive small domains, negative controls."""

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import pixel
from lumenframe.operators import contracts, metrics, stencil
from lumenframe.plans.images import SIX_BY_SIX


def mosaic(spark, height, width, site):
    return spark.createDataFrame([(0, y, x, site(y, x)) for y in range(height) for x in range(width)], "frame_id long, y int, x int, v int")


@pytest.mark.parametrize("red_y,red_x", [(0, 0), (0, 1), (1, 0), (1, 1)])
def test_constant_colours_come_back(spark, red_y, red_x):
    def site(y, x):
        red_row, red_column = y % 2 == red_y, x % 2 == red_x
        return 1000 if red_row and red_column else 3000 if not red_row and not red_column else 2000

    out = stencil.bayer_bilinear(stencil.scan_lines(mosaic(spark, 7, 9, site)), red_x, red_y)
    assert out.select("r", "g", "b").distinct().collect() == [(1000, 2000, 3000)]
    assert out.count() == 63


def test_constant_six_by_six(spark):
    out = stencil.mosaic_average(stencil.scan_lines(mosaic(spark, 13, 12, lambda y, x: [500, 700, 900][SIX_BY_SIX[y % 6 * 6 + x % 6]])), SIX_BY_SIX)
    assert out.select("r", "g", "b").distinct().collect() == [(500, 700, 900)]


def test_all_shifts_are_canonical(spark):
    shifts = [[SIX_BY_SIX[(y + dy) % 6 * 6 + (x + dx) % 6] for y in range(6) for x in range(6)] for dy in range(6) for dx in range(6)]
    odd = [list(SIX_BY_SIX)]
    odd[0][0] = 0
    df = spark.createDataFrame([(s,) for s in shifts + odd], "p array<int>").select(contracts.is_shift_of(F.col("p"), SIX_BY_SIX).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True] * 36 + [False]


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation_is_a_permutation(spark, orientation):
    df = mosaic(spark, 3, 5, lambda y, x: y * 5 + x)
    x, y = pixel.oriented(F.col("x"), F.col("y"), 5, 3, orientation)
    rows = {(r["y"], r["x"]): r["v"] for r in df.select(x.alias("x"), y.alias("y"), "v").collect()}
    h, w = (5, 3) if orientation > 4 else (3, 5)
    assert set(rows) == {(a, b) for a in range(h) for b in range(w)}


def test_grey_has_no_chroma(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("v"))
    out = df.select("v", *[pixel.weighed(F.col("v"), F.col("v"), F.col("v"), w).alias(n) for n, w in (("l", pixel.LUMA), ("cb", pixel.CB), ("cr", pixel.CR))]).collect()
    assert all(r["l"] == r["v"] and r["cb"] == 128 and r["cr"] == 128 for r in out)


def test_one_changed_sample_is_seen(spark):
    a = spark.createDataFrame([(0, y, x, 10, 20, 30) for y in range(4) for x in range(4)], "frame_id long, y int, x int, r int, g int, b int")
    b = a.withColumn("g", F.when((F.col("y") == 2) & (F.col("x") == 1), 25).otherwise(F.col("g")))
    same = {r["ch"]: r for r in metrics.channel_psnr(metrics.paired(a, a), 255.0).collect()}
    assert all(r["psnr"] == metrics.SAME_DB for r in same.values())
    seen = {r["ch"]: r for r in metrics.channel_psnr(metrics.paired(a, b), 255.0).collect()}
    assert seen[0]["psnr"] == metrics.SAME_DB and seen[1]["max_abs"] == 5 and (seen[1]["at_y"], seen[1]["at_x"]) == (2, 1)
    assert metrics.frame_hash(a, ["r", "g", "b"]).first()["sha256"] != metrics.frame_hash(b, ["r", "g", "b"]).first()["sha256"]


def test_exact_quantile(spark):
    df = spark.range(1000).select(F.lit(0).alias("k"), (F.col("id") % 100).cast("int").alias("v"))
    assert metrics.class_quantile(df, ["k"], "v", 0.99).first()["q"] == sorted(i % 100 for i in range(1000))[990]


def test_first_failure_wins(spark):
    code, reason = contracts.first_failure([(F.col("id") < 2, -1, "a"), (F.col("id") < 1, -2, "b")])
    assert [tuple(r) for r in spark.range(3).select(code, reason).collect()] == [(0, None), (-2, "b"), (-1, "a")]
