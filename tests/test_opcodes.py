"""Opcode lists against plain Python, in both orders; warps that differ by frame; planes of half size."""

import numpy as np

from lumenframe.operators import opcodes, stencil, warp

G = warp.Geometry(12, 10, 12, 10)
LENS = [1.0, -0.2, 0.1, 0.0, 0.01, -0.02]
POLY = [0.05, 0.7, 0.3, -0.1, 0.0, 0.0]
VIGN = [0.4, -0.1, 0.02, 0.0, 0.0, 0.0]


def frame(seed):
    return np.random.default_rng(seed).integers(0, 65536, (2, G.height, G.width))


def brute(planes, ops):
    for kind, c in ops:
        if kind == opcodes.WARP:
            made = [warp.warp_line(y, np.arange(G.height), list(planes.astype(np.int32)), G, tuple(c)) for y in range(G.height)]
            planes = np.array([[line[k] for line in made] for k in range(2)])
        elif kind == opcodes.POLYNOMIAL:
            x = planes / 65535.0
            planes = np.floor(np.clip(c[0] + x * (c[1] + x * (c[2] + x * c[3])), 0, 1) * 65535.0 + 0.5).astype(int)
        elif kind == opcodes.VIGNETTE:
            cx, cy = (G.width - 1) / 2, (G.height - 1) / 2
            yy, xx = np.mgrid[0 : G.height, 0 : G.width]
            rr = ((xx - cx) ** 2 + (yy - cy) ** 2) / (cx * cx + cy * cy)
            planes = np.floor(np.clip(planes * (1 + rr * (c[0] + rr * (c[1] + rr * c[2]))), 0, 65535) + 0.5).astype(int)
    return planes


LISTS = {
    0: [(opcodes.POLYNOMIAL, POLY), (opcodes.WARP, LENS)],
    1: [(opcodes.WARP, LENS), (opcodes.POLYNOMIAL, POLY)],
    2: [(opcodes.WARP, LENS), (opcodes.VIGNETTE, VIGN), (opcodes.WARP, [1.0, 0.1, 0.0, 0.0, 0.0, 0.0]), (opcodes.POLYNOMIAL, POLY)],
    3: [],
    4: [(opcodes.VIGNETTE, VIGN), (99, POLY)],
}


def test_lists_act_in_order(spark):
    lines = [(f, y, *[p[y].tolist() for p in frame(7 if f < 2 else f)], f"line {y}") for f in [*LISTS, 5] for y in range(G.height)]
    ops = [(f, k, kind, c, kind == 99 and f == 4) for f, ops in LISTS.items() for k, (kind, c) in enumerate(ops)] + [(5, 0, opcodes.VIGNETTE, VIGN, False), (5, 1, 77, POLY, False)]
    lists = opcodes.opcode_lists(spark.createDataFrame(ops, "frame_id int, place int, kind int, coefficients array<double>, optional boolean"))
    df = spark.createDataFrame(lines, "frame_id int, y int, a array<int>, b array<int>, note string")
    got = opcodes.apply_opcodes(df, ["a", "b"], lists, G).collect()
    assert all(r["note"] == f"line {r['y']}" for r in got)
    made = {f: np.array([[r[p] for r in sorted((r for r in got if r["frame_id"] == f), key=lambda r: r["y"])] for p in "ab"]) for f in LISTS}
    for f, ops in LISTS.items():
        assert (made[f] == brute(frame(7 if f < 2 else f), [o for o in ops if o[0] != 99])).all()
    assert (made[0] != made[1]).any()
    assert {r["frame_id"] for r in got} == set(LISTS) and {r["frame_id"]: r["refused"] for r in lists.collect() if r["refused"]} == {5: "opcode 77 at 1 is not supported"}


def test_no_lists(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], [3, 4])], "frame_id int, y int, a array<int>, b array<int>")
    none = opcodes.opcode_lists(spark.createDataFrame([], "frame_id int, place int, kind int, coefficients array<double>, optional boolean"))
    assert [tuple(r) for r in opcodes.apply_opcodes(df, ["a", "b"], none, G).collect()] == [(1, 0, [1, 2], [3, 4])]


def test_identity_and_constant_fields():
    flat = np.full((G.height, G.width), 1234, np.int32)
    assert all((warp.warp_line(y, np.arange(G.height), [flat], G, tuple(LENS))[0] == 1234).all() for y in range(G.height))


def test_frames_that_lack_lines(spark):
    """Only lines that are there come out; a constant field stays constant."""
    df = spark.createDataFrame([(1, y, [700] * G.width) for y in (0, 1, 2, 7)], "frame_id int, y int, v array<int>")
    got = {r["y"]: r["v"] for r in warp.warp_lines(df, ["v"], LENS, G).collect()}
    assert set(got) == {0, 1, 2, 7} and all(set(v) <= {700, 0} for v in got.values()) and got[1] == [700] * G.width


def test_planes(spark):
    rows = [(1, y, x, 10 * y + x, 100 + y, 50 + x) for y in range(3) for x in range(5)]
    got = {(r["plane"], r["y"], r["x"]): r["v"] for r in stencil.planes_420(spark.createDataFrame(rows, "frame_id int, y int, x int, luma int, cb int, cr int"), 5, 3).collect()}
    assert len(got) == 15 + 2 * 6 and all(got["y", y, x] == 10 * y + x for y in range(3) for x in range(5))
    for by in range(2):
        for bx in range(3):
            ys, xs = [min(2 * by + k, 2) for k in (0, 1)], [min(2 * bx + k, 4) for k in (0, 1)]
            assert got["cb", by, bx] == (sum(100 + y for y in ys for _ in xs) + 1 + bx % 2) >> 2
            assert got["cr", by, bx] == (sum(50 + x for _ in ys for x in xs) + 1 + bx % 2) >> 2
