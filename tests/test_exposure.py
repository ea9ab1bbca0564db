"""Exposure: quantiles, guards in order, and the root against plain Python; frame rules one by one."""

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import adapter, exposure
from lumenframe.plans.exposure import CHAIN


def peak(h, ev):
    clip = lambda v: min(1.0, max(0.0, v))
    times = lambda m, v: [clip(sum(a * b for a, b in zip(row, v, strict=True))) for row in m]
    rgb = times(CHAIN.camera, [min(a, b) for a, b in zip(h, CHAIN.camera_white, strict=True)])
    white = 2.0**-ev
    black = min(0.005, 0.99 * white)
    rgb = [clip((v - black) / (white - black)) for v in rgb]
    tone = lambda v: math.sqrt(v) * (1 - 0.2 * v) + 0.2 * v
    hi, lo = max(rgb), min(rgb)
    rgb = [tone(hi) if v == hi else tone(lo) if v == lo else tone(lo) + (tone(hi) - tone(lo)) * (v - lo) / (hi - lo) for v in rgb]
    return adapter.binary32(max(12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055 for v in times(CHAIN.final, rgb)))


def solve(h):
    if peak(h, 0.0) >= 1:
        return 0.0
    if peak(h, 2.0) < 1:
        return 2.0
    lo, hi = 0.0, 2.0
    for _ in range(30):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if peak(h, mid) < 1 else (lo, mid)
    return (lo + hi) / 2


SCHEMA = "k int, layout_ok boolean, sampled long, h array<double>, has_chain boolean, black double, white double"


def test_exposures(spark):
    colours = [[0.9, 0.9, 0.9], [0.5, 0.5, 0.5], [0.3, 0.5, 0.2], [0.6, 0.1, 0.1], [0.05, 0.02, 0.02], [0.0, 0.4, 0.0], [2.0, 2.0, 2.0], [0.25, 0.26, 0.24]]
    rows = [(k, True, 5000, h, True, 10.0, 100.0) for k, h in enumerate(colours)]
    got = {r["k"]: r for r in exposure.solved(spark.createDataFrame(rows, SCHEMA), CHAIN).collect()}
    for k, h in enumerate(colours):
        assert got[k]["status"] == "ok" and got[k]["ev"] == pytest.approx(solve(h), abs=1e-7)
    assert got[4]["ev"] == 2.0 and got[6]["ev"] == 0.0 and got[6]["reason"] == "already at white, no gain"
    assert 0 < got[1]["ev"] < 2


def test_guards_in_order(spark):
    fine = (True, 4096, [0.1, 0.2, 0.3], True, 10.0, 100.0)
    broken = [(0, False, "unsupported layout"), (1, 4095, "too few samples"), (3, False, "no chain"), (5, 10.0, "degenerate"), (2, [0.0, 0.0, 0.0], "degenerate")]
    rows, want = [(99, *fine)], {99: "ok"}
    for k in range(len(broken)):  # the k-th guard and all after it are broken: the k-th is told
        row = list(fine)
        for at, value, _ in broken[k:]:
            row[at] = value
        rows.append((k, *row))
        want[k] = broken[k][2]
    rows += [(50, True, 4096, [math.nan, 1.0, 1.0], True, 1.0, 9.0), (51, True, 4096, None, True, 1.0, 9.0), (52, True, 4096, [0.1, 0.1, 0.1], True, 1.0, math.inf), (53, None, None, None, None, None, None)]
    want |= {50: "degenerate", 51: "degenerate", 52: "degenerate", 53: "unsupported layout"}
    got = {r["k"]: r for r in exposure.solved(spark.createDataFrame(rows, SCHEMA), CHAIN).collect()}
    assert {k: r["status"] for k, r in got.items()} == want
    assert all(r["ev"] == 0.0 for k, r in got.items() if k != 99)


def test_highlights(spark):
    rows = [(1, y, x, 100 * y + x) for y in range(40) for x in range(40)]
    s = exposure.samples(spark.createDataFrame(rows, "f int, y int, x int, v int"), "f", [0, 1, 3, 2], 2, stride=4)
    r = exposure.highlights(s, "f", [0.0, 0.0, 0.0], 1000.0).first()
    values = sorted(100 * y + x for y in range(0, 40, 4) for x in range(0, 40, 4))
    assert r["sampled"] == 100 and r["h"] == [pytest.approx(values[99] / 1000, rel=1e-6), 0.0, 0.0]
    odd = exposure.samples(spark.createDataFrame(rows, "f int, y int, x int, v int"), "f", [0, 1, 3, 2], 2, stride=1).groupBy("ch").count().collect()
    assert {r["ch"]: r["count"] for r in odd} == {0: 400, 1: 800, 2: 400}


def test_matrix_keeps_white(spark):
    """Rows of either route sum to the white of the connection space where the camera's white is (1, 1, 1)."""
    srgb = [0.8, 0.15, 0.05, 0.0, 0.1, 0.85, 0.05, 0.0, 0.02, 0.08, 0.9, 0.0]
    xyz = [0.7, -0.2, 0.1, -0.3, 1.1, 0.2, 0.05, 0.1, 0.6, 0.0, 0.0, 0.0]
    rows = [(1, srgb, xyz, 0, 3), (2, srgb, xyz, 1, 3), (3, None, xyz, 0, 3), (4, srgb, xyz, 0, 4), (5, None, None, 0, 3), (6, [math.nan, *srgb[1:]], xyz, 0, 3), (7, srgb, None, 5, 3), (8, srgb, xyz, 0, 1)]
    df = spark.createDataFrame(rows, "k int, a array<double>, x array<double>, raw int, n int")
    got = {r["k"]: r for r in adapter.camera_matrix(df, "a", "x", "raw", "n").collect()}
    assert {k: r["route"] for k, r in got.items()} == {1: "rgb_cam", 2: "cam_xyz", 3: "cam_xyz", 4: "none", 5: "none", 6: "cam_xyz", 7: "none", 8: "none"}
    for k in (1, 2, 3, 6):
        for r in range(3):
            assert sum(got[k]["matrix"][3 * r : 3 * r + 3]) == pytest.approx(adapter.SPACE_WHITE[r], abs=1e-5)
    assert got[4]["matrix"] is None and got[4]["matrix_reason"] == "four colours have no 3x3 matrix" and got[5]["matrix_reason"] == "no usable colour data"


def test_each_rule(spark):
    good = {
        "planes": 1, "components": 1, "width": 10, "height": 8, "has_data": True, "row_stride": 20, "pixel_stride": 2, "sample_bytes": 2, "bytes": 160, "active_x": 0, "active_y": 0, "active_w": 10, "active_h": 8,
        "crop_x": 1, "crop_y": 1, "crop_w": 4, "crop_h": 4, "model": "cfa", "layout": "bayer", "side": 2, "pattern_count": 4, "black": [1.0] * 4, "component_black": [0.0] * 4, "white": 100.0, "matrix": [1.0] * 9,
    }
    linear = good | {"model": "rgb", "layout": "linear_rgb", "components": 3, "pixel_stride": 6, "row_stride": 60, "bytes": 480, "pattern_count": 0, "black": [0.0], "side": 0}
    cases = [
        (good, {}, None), (linear, {}, None), (good, {"layout": "monochrome"}, "layout is not supported"), (good, {"planes": 0}, "no planes"), (good, {"width": 0}, "empty plane"), (good, {"has_data": False}, "plane without data"),
        (good, {"row_stride": -20}, "stride is not positive"), (good, {"row_stride": 1 << 62}, "size of the plane overflows"), (good, {"pixel_stride": 1}, "pixel stride is shorter than a sample"), (good, {"bytes": 159}, "data end before the last pixel"),
        (good, {"active_w": 11}, "active area is outside the plane"), (good, {"crop_x": 7}, "crop is outside the plane"), (good, {"pattern_count": 3}, "pattern count is not that of the repeat"),
        (good, {"component_black": [0.0, 1.0, 0.0, 0.0]}, "component black beside a pattern"), (good, {"black": [0.0] * 65}, "black repeat is above the ceiling"), (good, {"black": [math.nan]}, "black is negative or not finite"),
        (good, {"white": math.inf}, "white is not positive or not finite"), (good, {"black": [100.0]}, "black is not below white"), (linear, {"component_black": [-1.0] * 4}, "component black is negative or not finite"),
        (linear, {"component_black": [100.0] * 4}, "component black is not below white"), (good, {"matrix": None}, "colour matrix is missing"), (good, {"matrix": None, "layout": "monochrome"}, "layout is not supported"),
        (linear, {"components": 4}, "linear colour needs one interleaved plane of three samples"), (linear, {"pattern_count": 4}, "linear colour with a pattern"), (linear, {"pixel_stride": 8, "row_stride": 80, "bytes": 640}, "linear colour needs a pixel stride of 6"),
        (linear, {"black": [1.0]}, "linear colour with a black tile"), (good, {"planes": 2}, "mosaics need one plane of one sample"), (good, {"crop_w": None}, "crop is outside the plane"),
    ]
    schema = "k int, planes int, components int, width long, height long, has_data boolean, row_stride long, pixel_stride int, sample_bytes int, bytes long, active_x int, active_y int, active_w long, active_h long, crop_x int, crop_y int, crop_w int, crop_h int, model string, layout string, side int, pattern_count int, black array<double>, component_black array<double>, white double, matrix array<double>"
    rows = [(k, *(base | change).values()) for k, (base, change, _) in enumerate(cases)]
    got = {r["k"]: r["reason"] for r in adapter.frames_validated(spark.createDataFrame(rows, schema)).select("k", F.col("reason")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]
