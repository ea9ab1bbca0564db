"""Lists of image opcodes that come as data and act on the lines of their frames, in list order.

What one pixel needs alone is folded over a line by `aggregate`, with a dispatch by kind for each list entry. What needs
neighbours, the lens warp, ends a segment of the list: all frames fold their segment, then the frames that have a warp next are
warped, each by its own coefficients. There are as many rounds as the longest list has warps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import apart
from .folders import work_folder
from .warp import Geometry, warp_lines

# Numbers of the opcodes in the public file format.
WARP, VIGNETTE, POLYNOMIAL = 1, 3, 8
KNOWN = [WARP, VIGNETTE, POLYNOMIAL]
TOP = 65535.0


def opcode_lists(opcodes: DataFrame) -> DataFrame:
    """frame_id, opcodes (in order, with the number of warps before each), refused (why a frame can't be processed, else null).

    opcodes: frame_id, place, kind, coefficients, optional. An unknown kind is skipped where it is optional and else refuses its frame,
    as the first such one in the list tells. Lists are short by their format; a frame's is one row.
    """
    before = Window.partitionBy("frame_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = opcodes.withColumn("segment", F.coalesce(F.sum((F.col("kind") == WARP).cast("int")).over(before), F.lit(0)).cast("int"))
    lists = placed.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "coefficients", "optional", "segment"))).alias("all"))
    bad = F.get(F.filter("all", lambda o: ~o["kind"].isin(KNOWN) & ~o["optional"]), 0)
    said = F.when(bad.isNotNull(), F.concat(F.lit("opcode "), bad["kind"].cast("string"), F.lit(" at "), bad["place"].cast("string"), F.lit(" is not supported")))
    return lists.select("frame_id", F.filter("all", lambda o: o["kind"].isin(KNOWN)).alias("opcodes"), said.alias("refused"))


def polynomial(v: Column, c: Column) -> Column:
    """MapPolynomial over the whole range: clamped and rounded half up."""
    x = v.cast("double") / TOP
    y = F.get(c, 0) + x * (F.get(c, 1) + x * (F.get(c, 2) + x * F.get(c, 3)))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)) * TOP + 0.5).cast("int")


def vignette(v: Column, x: Column, y: Column, c: Column, g: Geometry) -> Column:
    """FixVignetteRadial: a gain that is a polynomial of the squared distance from the centre, in units of the distance to a corner."""
    cx, cy = (g.width - 1) / 2, (g.height - 1) / 2
    dx, dy = x - cx, y - cy
    rr = (dx * dx + dy * dy) / (cx * cx + cy * cy)
    gain = 1.0 + rr * (F.get(c, 0) + rr * (F.get(c, 1) + rr * (F.get(c, 2) + rr * (F.get(c, 3) + rr * F.get(c, 4)))))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(TOP), v * gain)) + 0.5).cast("int")


def folded(planes: Column, opcodes: Column, g: Geometry) -> Column:
    """planes (an array of arrays of samples, of the line y) after the pointwise opcodes of a list."""

    def act(lines: Column, op: Column) -> Column:
        every = lambda f: F.transform(lines, lambda line: F.transform(line, f))
        return (
            F.when(op["kind"] == POLYNOMIAL, every(lambda v, _: polynomial(v, op["coefficients"])))
            .when(op["kind"] == VIGNETTE, every(lambda v, x: vignette(v, x.cast("double"), F.col("y").cast("double"), op["coefficients"], g)))
            .otherwise(lines)
        )

    return F.aggregate(opcodes, planes, act)


def apply_opcodes(lines: DataFrame, planes: list[str], lists: DataFrame, g: Geometry) -> DataFrame:
    """lines (frame_id, y and an array of integers per plane) after their frames' opcodes (from opcode_lists).

    Frames without a list stay as they are; refused frames have no lines in the result, and lists tells why.
    """
    # files list opcodes of frames that have no lines here; those are left out before any list is worked on
    work_folder(lines.sparkSession)
    lists = lists.join(lines.select("frame_id").distinct(), "frame_id", "left_semi").checkpoint()
    rounds = lists.where("refused IS NULL").agg(F.max(F.size(F.filter("opcodes", lambda o: o["kind"] == WARP)))).first()[0] or 0  # a small number
    listed = lists.select(F.col("frame_id").alias("list_of"), F.col("opcodes").alias("__ops"), "refused")
    rows = lines.join(listed, F.col("frame_id") == F.col("list_of"), "left").where("refused IS NULL").drop("list_of", "refused")
    for k in range(rounds + 1):
        mine = F.filter("__ops", lambda o: (o["segment"] == k) & (o["kind"] != WARP))  # noqa: B023
        acted = F.when(F.coalesce(F.size(mine), F.lit(0)) > 0, folded(F.array(*planes), mine, g)).otherwise(F.array(*planes))
        rows = apart(rows.withColumn("__planes", acted)).withColumns({p: F.col("__planes")[j] for j, p in enumerate(planes)}).drop("__planes")
        if k < rounds:
            lens = lambda ops: F.get(F.filter(ops, lambda o: o["kind"] == WARP), k)["coefficients"]  # noqa: B023, E731
            frames = lists.where("refused IS NULL").select("frame_id", lens("opcodes").alias("frame_lens")).where("frame_lens IS NOT NULL")
            rows = warp_lines(rows, planes, lens("__ops"), g, frames)
    return rows.drop("__ops")
