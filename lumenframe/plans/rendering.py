"""Queries that render whole frames: opcode lists that act, planes of several resolutions, scaled decodes, fused routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..operators import opcodes, stencil, warp
from ..sources.fixtures import HEIGHT, WIDTH, pixels, table
from . import images as im
from .registry import query

# opcode lists: the order with the number of the frame plus one; its second and sixth line are warps


def frame_opcodes(spark, d) -> DataFrame:
    c, n = F.col, F.col("l_linenumber")
    zero = F.lit(0.0)
    lens = F.array(F.lit(1.0), -c("l_discount") / 2, c("l_tax") / 4, F.lit(-0.005), F.lit(0.001), -0.0005 * n)
    poly = F.array(c("l_tax") / 10, 1 - c("l_discount"), c("l_discount"), -c("l_tax") / 2, zero, zero)
    vign = F.array(c("l_discount"), -c("l_tax"), F.lit(0.01), zero, zero, zero)
    kind = F.when(n % 4 == 2, opcodes.WARP).when(c("l_partkey") % 2 == 0, opcodes.POLYNOMIAL).when(c("l_partkey") % 7 == 1, 14).otherwise(opcodes.VIGNETTE)
    # an order may have several lines of one number: the largest counts
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_partkey", "l_suppkey", "l_discount", "l_tax")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    rows = one.select((c("l_orderkey") - 1).alias("frame_id"), n.alias("place"), kind.alias("kind"), F.when(kind == opcodes.WARP, lens).when(kind == opcodes.POLYNOMIAL, poly).otherwise(vign).alias("coefficients"), (c("l_suppkey") % 3 != 0).alias("optional"))
    return rows.where("frame_id >= 0")


OPS = """op AS (SELECT l_orderkey - 1 AS frame_id, l_linenumber AS place, CASE WHEN l_linenumber % 4 = 2 THEN 1 WHEN l_partkey % 2 = 0 THEN 8 WHEN l_partkey % 7 = 1 THEN 14 ELSE 3 END AS kind,
  l_discount AS dis, l_tax AS tax, l_suppkey % 3 <> 0 AS optional
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_discount DESC, l_tax DESC) = 1)),
bad AS (SELECT frame_id, arg_min('opcode ' || CAST(kind AS VARCHAR) || ' at ' || CAST(place AS VARCHAR) || ' is not supported', place) AS refused FROM op WHERE kind = 14 AND NOT optional GROUP BY 1)"""


def _act(out: str, source: str, place: int) -> str:
    """One place of the list on every pixel."""
    v = "(v / 65535.0::DOUBLE)"
    dx, dy, far = f"(x - {(WIDTH - 1) / 2}::DOUBLE)", f"(y - {(HEIGHT - 1) / 2}::DOUBLE)", ((WIDTH - 1) / 2) ** 2 + ((HEIGHT - 1) / 2) ** 2
    rr = f"(({dx} * {dx} + {dy} * {dy}) / {far!r}::DOUBLE)"
    poly = f"floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, tax / 10 + {v} * ((1 - dis) + {v} * (dis + {v} * (-tax / 2))))) * 65535.0 + 0.5)"
    vign = f"floor(greatest(0.0::DOUBLE, least(65535.0::DOUBLE, v * (1.0::DOUBLE + {rr} * (dis + {rr} * (-tax + {rr} * (0.01::DOUBLE + {rr} * (0.0::DOUBLE + {rr} * 0.0::DOUBLE)))))) ) + 0.5)"
    return f", {out} AS (SELECT s.frame_id, y, x, CAST(CASE kind WHEN 8 THEN {poly} WHEN 3 THEN {vign} ELSE v END AS INT) AS v FROM {source} s LEFT JOIN op ON op.frame_id = s.frame_id AND op.place = {place})"


def _bend(out: str, source: str, place: int) -> str:
    """The warp at one place of the list on the frames that have it; the others stay."""
    text = im._bicubic(source, "v").removeprefix(im.PX + ", ")
    lens = text.replace("FROM px)", f"FROM px JOIN op USING (frame_id) WHERE op.place = {place})", 1).replace("SELECT frame_id, y, x, (x -", "SELECT frame_id, y, x, dis, tax, (x -", 1)
    lens = lens.replace("rr * (-0.05::DOUBLE + rr * (0.02::DOUBLE + rr * (-0.005::DOUBLE)))", "rr * (-dis / 2 + rr * (tax / 4 + rr * (-0.005::DOUBLE)))").replace("-0.0005::DOUBLE", f"-0.0005::DOUBLE * {place}")
    for name in ("n AS (", "rr AS (", "place AS (", "bounds AS (", "base AS (", "fit AS (", "tap AS (", "warped AS ("):
        lens = lens.replace(name, f"{out}_{name}", 1)
    for name in ("n)", "rr))", "place GROUP", "place p", "bounds b", "base)", "fit f", "tap GROUP"):
        lens = lens.replace(f"FROM {name}", f"FROM {out}_{name}").replace(f"JOIN {name}", f"JOIN {out}_{name}")
    lens = lens.replace("FROM rr)", f"FROM {out}_rr)")
    return f", {lens}, {out} AS (SELECT frame_id, y, x, v FROM {out}_warped UNION ALL SELECT frame_id, y, x, v FROM {source} WHERE frame_id NOT IN (SELECT frame_id FROM op WHERE place = {place}))"


ACTED = im.PX + ", " + OPS + ", p0 AS (SELECT * FROM px WHERE frame_id NOT IN (SELECT frame_id FROM bad))" + _act("p1", "p0", 1) + _bend("p2", "p1", 2) + _act("p3", "p2", 3) + _act("p4", "p3", 4) + _act("p5", "p4", 5) + _bend("p6", "p5", 6) + _act("p7", "p6", 7)


@query(f"WITH {ACTED} SELECT frame_id, y, x, v FROM p7")
def q_opcode3_pixels(spark, d):
    """Frames after their opcode lists: polynomials, vignettes and warps in list order."""
    lines = warp.plane_lines(pixels(spark, d), ["v"])
    return warp.pixels_of(opcodes.apply_opcodes(lines, ["v"], opcodes.opcode_lists(frame_opcodes(spark, d)), im.GEOMETRY), ["v"])


@query(f"WITH {OPS} SELECT frame_id, CAST(count(*) FILTER (kind <> 14) AS INT) AS n, any_value(refused) AS refused FROM op LEFT JOIN bad USING (frame_id) WHERE frame_id >= 0 GROUP BY frame_id")
def q_opcode3_refused(spark, d):
    """Every opcode list: how many of its opcodes act, and why its frame is refused, if it is."""
    return opcodes.opcode_lists(frame_opcodes(spark, d)).select("frame_id", F.size("opcodes").alias("n"), "refused")


# planes


def rendered_planes(linear: DataFrame, width: int, height: int) -> DataFrame:
    shown = im.stages(linear)
    ycc = shown.select("frame_id", "y", "x", *[px.weighed(*im.rgb_columns(), w).alias(n) for n, w in (("luma", px.LUMA), ("cb", px.CB), ("cr", px.CR))])
    return stencil.planes_420(ycc, width, height)


def _planes_sql(source: str, width: int, height: int) -> str:
    odd = lambda c, n: f"CASE WHEN {c} = {n - 1} THEN 2 ELSE 1 END" if n % 2 else "1"
    return f""", yc AS (SELECT frame_id, y, x, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS luma, (-11059 * r - 21709 * g + 32768 * b + 8421375) >> 16 AS cb, (32768 * r - 27439 * g - 5329 * b + 8421375) >> 16 AS cr FROM {source}),
blk AS (SELECT frame_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(sum(cb * ({odd('x', width)}) * ({odd('y', height)})) AS BIGINT) AS cb, CAST(sum(cr * ({odd('x', width)}) * ({odd('y', height)})) AS BIGINT) AS cr FROM yc GROUP BY frame_id, y // 2, x // 2)
SELECT 'y' AS plane, frame_id, y, x, luma AS v FROM yc UNION ALL SELECT 'cb', frame_id, y, x, CAST((cb + 1 + x % 2) >> 2 AS INT) FROM blk UNION ALL SELECT 'cr', frame_id, y, x, CAST((cr + 1 + x % 2) >> 2 AS INT) FROM blk"""


@query(f"WITH {im.BYTES}{_planes_sql('bytes', WIDTH // 3, HEIGHT)}")
def q_render_yuv420_planes(spark, d):
    """Rendered frames as one plane of luma and two of chroma at half the resolution."""
    return rendered_planes(im.unit(spark, d), WIDTH // 3, HEIGHT)


SMALL = im.UNIT.replace(", unit AS", ", unit0 AS") + im.CELLS.format(src="unit0") + ", unit AS (SELECT frame_id, y, x, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM cells GROUP BY 1, 2, 3)" + im.BYTES[len(im.UNIT) :]


@query(f"WITH {SMALL}{_planes_sql('bytes', 10, 17)}")
def q_render_yuv420_scaled(spark, d):
    """The same of a smaller picture: cells are averaged in linear light before any colour arithmetic, then rendered."""
    small = im._cells(im.unit(spark, d)).agg(*[F.round(F.avg(c), 9).alias(c) for c in "rgb"])
    return rendered_planes(small, 10, 17)


# fused routes: mosaics of both kinds and linear samples, rendered to bytes and to planes


def six_by_six_linear(spark, d) -> DataFrame:
    dem = stencil.mosaic_average(stencil.scan_lines(pixels(spark, d)), im.SIX_BY_SIX, HEIGHT)
    return dem.select("frame_id", "y", "x", *[(F.col(c) / 65535.0).alias(c) for c in "rgb"])


_UNIT_OF = ", unit AS (SELECT frame_id, y, x, r / 65535.0::DOUBLE AS r, g / 65535.0::DOUBLE AS g, b / 65535.0::DOUBLE AS b FROM {})" + im.BYTES[len(im.UNIT) :]
SIX = im.SIX_SQL + _UNIT_OF.format("six")
LINEAR = im.RGB + im.LINEAR_SQL + _UNIT_OF.format("n")


@query(f"WITH {SIX} SELECT frame_id, y, x, r, g, b, 255 AS a FROM bytes")
def q_fused_xtrans(spark, d):
    """The 6 x 6 mosaic to rendered bytes in one plan."""
    return im.stages(six_by_six_linear(spark, d)).withColumn("a", F.lit(255))


@query(f"WITH {SIX}{_planes_sql('bytes', WIDTH, HEIGHT)}")
def q_fused_xtrans_yuv420(spark, d):
    return rendered_planes(six_by_six_linear(spark, d), WIDTH, HEIGHT)


def linear_samples(spark, d) -> DataFrame:
    return im.q_normalize_linear(spark, d).select("frame_id", "y", "x", *[(F.col(c) / 65535.0).alias(c) for c in "rgb"])


@query(f"WITH {LINEAR} SELECT frame_id, y, x, r, g, b, 255 AS a FROM bytes")
def q_fused_linear(spark, d):
    """Linear colour samples, normalised, to rendered bytes in one plan."""
    return im.stages(linear_samples(spark, d)).withColumn("a", F.lit(255))


@query(f"WITH {LINEAR}{_planes_sql('bytes', WIDTH // 3, HEIGHT)}")
def q_fused_linear_yuv420(spark, d):
    return rendered_planes(linear_samples(spark, d), WIDTH // 3, HEIGHT)


@query(f"WITH {im.FULL}{_planes_sql('bytes', WIDTH, HEIGHT)}")
def q_fused_bayer_yuv420(spark, d):
    linear = im.demosaiced(spark, d).select("frame_id", "y", "x", *[(F.col(c) / 65535.0).alias(c) for c in "rgb"])
    return rendered_planes(linear, WIDTH, HEIGHT)
