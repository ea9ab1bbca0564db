"""Queries of camera matrices, input rules and composed frame descriptions, over parts as what a decoder reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adapter, contracts
from ..sources.fixtures import table
from .contracts import CLASSED, layouts
from .images import SIX_BY_SIX
from .registry import query


def reported(spark, d) -> DataFrame:
    """k, colors, raw_color, rgb_cam, cam_xyz and the rest of a decoder's report; most frames are sound, every rule is broken by some."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    u = (k % 7).cast("double") / 10
    rgb = [1.0 + size / 100, -0.2 + u / 10, 0.05, 0.0, -0.1, 1.3 + u / 5, -0.15, 0.0, 0.02, -0.3, 1.1 + size / 200, 0.0]
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    xyz = [0.7 + size / 100, -0.2, 0.1, -0.3, 1.1 + u, 0.2, 0.05, 0.1, 0.6, 0.0, 0.0, 0.0]
    flat = [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.5, 0.1, 0.9, 0.0, 0.0, 0.0]
    even = [1.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]  # its inverse has no row sum of zero
    zero = [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]  # the first row of its inverse is 1, 0, -1
    listed = lambda v: F.array(*[F.lit(x).cast("double") for x in v])
    return table(spark, d, "part").select(
        k.alias("k"),
        "p_size",
        F.when(k % 23 == 0, 4).when(k % 29 == 0, 1).otherwise(3).alias("colors"),
        (k % 3 % 2).cast("int").alias("raw_color"),
        F.when(k % 8 == 0, listed(eye)).when(k % 31 == 0, F.lit(None)).otherwise(listed(rgb)).alias("rgb_cam"),
        F.when(k % 5 == 0, listed(flat)).when(k % 37 == 0, listed([0.0] * 12)).when(k % 11 == 0, listed(zero)).when(k % 13 == 0, listed(even)).otherwise(listed(xyz)).alias("cam_xyz"),
    )


_SRGB = [[f"{v!r}::DOUBLE" for v in row] for row in adapter.SRGB]
_F = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_RGB = ["1.0 + s / 100", "-0.2 + u / 10", "0.05", "0.0", "-0.1", "1.3 + u / 5", "-0.15", "0.0", "0.02", "-0.3", "1.1 + s / 200", "0.0"]
_XYZ = ["0.7 + s / 100", "-0.2", "0.1", "-0.3", "1.1 + u", "0.2", "0.05", "0.1", "0.6"]


def _ls(values) -> str:
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "]"


_A = [_F.format(f"a[{4 * (i // 3) + i % 3 + 1}]") for i in range(9)]
_M = [_F.format(f"x[{i + 1}]") for i in range(9)]
_ADJ = [f"{_M[a]} * {_M[b]} - {_M[e]} * {_M[f]}" for a, b, e, f in [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]]
MATRIX = f"""rep0 AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 7 AS DOUBLE) / 10 AS u, CASE WHEN p_partkey % 23 = 0 THEN 4 WHEN p_partkey % 29 = 0 THEN 1 ELSE 3 END AS colors, p_partkey % 3 % 2 AS raw_color FROM part),
rep AS (SELECT *, CASE WHEN k % 8 = 0 THEN {_ls([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])} WHEN k % 31 = 0 THEN NULL ELSE {_ls(_RGB)} END AS a,
  CASE WHEN k % 5 = 0 THEN {_ls([1, 2, 3, 2, 4, 6, 0.5, 0.1, 0.9])} WHEN k % 37 = 0 THEN {_ls([0] * 9)} WHEN k % 11 = 0 THEN {_ls([1, 0, 1, 0, 1, 0, 0, 0, 1])} WHEN k % 13 = 0 THEN {_ls([1, 0, -1, 0, 1, 0, 0, 0, 1])} ELSE {_ls(_XYZ)} END AS x FROM rep0),
adj AS (SELECT *, a IS NOT NULL AND k % 8 <> 0 AND raw_color = 0 AND colors = 3 AS first, {_ls(_ADJ)} AS j FROM rep),
det AS (SELECT *, {_M[0]} * j[1] + {_M[1]} * j[4] + {_M[2]} * j[7] AS det FROM adj),
inv AS (SELECT *, CASE WHEN abs(det) >= 1e-12 THEN list_transform(j, lambda v: CAST(CAST(v / det AS FLOAT) AS DOUBLE)) END AS v FROM det),
mat AS (SELECT *, CASE WHEN colors >= 4 THEN 'none' WHEN first THEN 'rgb_cam' WHEN k % 37 = 0 AND k % 5 <> 0 OR colors < 3 OR v IS NULL OR abs(v[1] + v[2] + v[3]) <= 1e-8 OR abs(v[4] + v[5] + v[6]) <= 1e-8 OR abs(v[7] + v[8] + v[9]) <= 1e-8 THEN 'none' ELSE 'cam_xyz' END AS route,
  CASE WHEN colors >= 4 THEN 'four colours have no 3x3 matrix' WHEN first THEN NULL WHEN k % 37 = 0 AND k % 5 <> 0 OR colors < 3 THEN 'no usable colour data' WHEN v IS NULL THEN 'cam_xyz is not invertible'
    WHEN abs(v[1] + v[2] + v[3]) <= 1e-8 OR abs(v[4] + v[5] + v[6]) <= 1e-8 OR abs(v[7] + v[8] + v[9]) <= 1e-8 THEN 'a row of the inverse sums to zero' END AS matrix_reason FROM inv),
full_ AS (SELECT *, CASE route WHEN 'rgb_cam' THEN [{', '.join(_F.format(f'({_SRGB[r][0]} * {_A[c]} + {_SRGB[r][1]} * {_A[3 + c]}) + {_SRGB[r][2]} * {_A[6 + c]}') for r in range(3) for c in range(3))}]
  WHEN 'cam_xyz' THEN [{', '.join(_F.format(f'v[{3 * r + c + 1}] * ({adapter.SPACE_WHITE[r]!r}::DOUBLE / (v[{3 * r + 1}] + v[{3 * r + 2}] + v[{3 * r + 3}]))') for r in range(3) for c in range(3))}] END AS matrix FROM mat)"""


@query(f"WITH {MATRIX} SELECT k, route, matrix_reason, " + ", ".join(f"round(matrix[{i + 1}], 6) AS m{i}" for i in range(9)) + " FROM full_")
def q_camera_routes(spark, d):
    """Camera matrices by both routes, with what speaks against one."""
    made = adapter.camera_matrix(reported(spark, d), "rgb_cam", "cam_xyz", "raw_color", "colors")
    return made.select("k", "route", "matrix_reason", *[F.round(F.get("matrix", i), 6).alias(f"m{i}") for i in range(9)])


def with_layout(spark, d):
    lay = layouts(spark, d).withColumnRenamed("k", "of_k")
    layout = contracts.layout_class(F.col("model"), F.col("side"), F.col("side"), F.col("pattern"), SIX_BY_SIX)
    return lambda f: f.join(lay, F.col("k") == F.col("of_k")).drop("of_k").withColumn("layout", layout)


def areas(f: DataFrame) -> DataFrame:
    k, linear = F.col("k"), F.col("model") == "rgb"
    width, height = (F.col("p_size") * 10).cast("long"), k % 400 + 20
    stride = F.when(linear, 6).otherwise(F.when(k % 47 == 0, 1).otherwise(2))
    return f.withColumns(
        {
            "width": F.when(k % 53 == 0, 0).otherwise(width),
            "height": height,
            "planes": F.when(k % 61 == 0, 0).when(k % 67 == 0, 2).otherwise(1),
            "components": F.when(linear, 3).otherwise(1),
            "has_data": k % 71 != 0,
            "sample_bytes": F.lit(2),
            "pixel_stride": stride,
            "row_stride": F.when(k % 73 == 0, F.lit(1 << 61)).when(k % 79 == 0, 0).otherwise(width * stride),
            "bytes": width * stride * height - F.when(k % 83 == 0, 1).otherwise(0),
            "active_x": F.when(k % 89 == 0, -1).otherwise(0), "active_y": F.lit(0), "active_w": F.when(k % 53 == 0, 0).otherwise(width), "active_h": height,
            "crop_x": k % 4, "crop_y": k % 3, "crop_w": width - F.when(k % 97 == 0, 1).otherwise(4), "crop_h": height - 3,
            "pattern_count": F.coalesce(F.size("pattern"), F.lit(0)) + F.when(k % 101 == 0, 1).otherwise(0),
        }
    ).withColumn("side", F.when(F.col("pattern").isNull(), 0).otherwise(F.col("side")))


def blacks(f: DataFrame) -> DataFrame:
    """A black tile where there is a pattern, component black where there is none."""
    k, size = F.col("k"), F.col("p_size").cast("double")
    tile = contracts.merged_black(size, F.lit([1.0, 2.0, 3.0]), F.lit([0, 1, 1, 2]), F.lit([float(v) for v in range(4)]), 2, 2, k % 3, k % 2)
    none = F.array(F.lit(0.0))
    odd = F.when(k % 103 == 0, F.array(F.lit(float("nan")))).when(k % 107 == 0, F.array(F.lit(-1.0))).when(k % 109 == 0, F.array_repeat(F.lit(0.0), 65))
    component = F.when(F.col("model") == "rgb", size).otherwise(F.when(k % 113 == 0, 5.0).otherwise(0.0))
    return f.withColumns({"black": F.coalesce(odd, F.when(F.col("model") == "rgb", none).otherwise(tile)), "component_black": F.array_repeat(component, 4)})


def white_and_neutral(f: DataFrame) -> DataFrame:
    k, size = F.col("k"), F.col("p_size")
    shot = F.when(k % 4 == 1, F.array(size / 10.0, F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    neutral = contracts.neutral_of(k % 4 == 0, shot, F.when(k % 4 == 2, F.array(F.lit(2.0), F.lit(1.0), size / 5.0)))
    return f.withColumns({"white": F.when(k % 127 == 0, 0.0).when(k % 131 == 0, 20.0).otherwise(900.0), "neutral": neutral})


_RULES = [
    ("planes = 0", -206, "no planes"), ("width = 0", -206, "empty plane"), ("k % 71 = 0", -206, "plane without data"), ("k % 79 = 0 AND k % 73 <> 0", -206, "stride is not positive"),
    ("CAST(row_stride AS HUGEINT) * height > 9223372036854775807", -210, "size of the plane overflows"), ("ps < 2", -206, "pixel stride is shorter than a sample"),
    ("CAST(p_size * 10 AS BIGINT) * ps * height - CASE WHEN k % 83 = 0 THEN 1 ELSE 0 END < (height - 1) * CAST(row_stride AS HUGEINT) + width * ps", -206, "data end before the last pixel"),
    ("k % 89 = 0", -206, "active area is outside the plane"), ("k % 4 + crop_w > width OR crop_w <= 0", -206, "crop is outside the plane"),
    ("model = 'cfa' AND k % 101 = 0", -206, "pattern count is not that of the repeat"), ("model = 'cfa' AND k % 113 = 0", -206, "component black beside a pattern"),
    ("k % 109 = 0 AND k % 103 <> 0 AND k % 107 <> 0", -206, "black repeat is above the ceiling"), ("k % 103 = 0 OR k % 107 = 0", -206, "black is negative or not finite"),
    ("k % 127 = 0", -206, "white is not positive or not finite"), ("black_max >= white", -206, "black is not below white"),
    ("model = 'rgb' AND p_size >= white", -206, "component black is not below white"), ("route = 'none' AND layout <> 'monochrome'", -206, "colour matrix is missing"),
    ("layout NOT IN ('bayer', 'xtrans', 'linear_rgb')", -205, "layout is not supported"), ("layout = 'linear_rgb' AND planes <> 1", -205, "linear colour needs one interleaved plane of three samples"),
    ("layout = 'linear_rgb' AND k % 101 = 0", -206, "linear colour with a pattern"), ("layout = 'linear_rgb' AND k % 109 = 0", -206, "linear colour with a black tile"), ("layout <> 'linear_rgb' AND planes <> 1", -205, "mosaics need one plane of one sample"),
]
BUILT = f"""{CLASSED}, {MATRIX}, fr0 AS (SELECT f.k, p_size, layout, model, route, matrix_reason, CASE WHEN model = 'rgb' THEN 6 WHEN f.k % 47 = 0 THEN 1 ELSE 2 END AS ps, CASE WHEN f.k % 53 = 0 THEN 0 ELSE p_size * 10 END AS width, f.k % 400 + 20 AS height,
  CASE WHEN f.k % 61 = 0 THEN 0 WHEN f.k % 67 = 0 THEN 2 ELSE 1 END AS planes, p_size * 10 - CASE WHEN f.k % 97 = 0 THEN 1 ELSE 4 END AS crop_w, CASE WHEN f.k % 127 = 0 THEN 0.0 WHEN f.k % 131 = 0 THEN 20.0 ELSE 900.0 END AS white,
  CASE WHEN f.k % 109 = 0 THEN 0.0 WHEN model = 'rgb' THEN 0.0 ELSE p_size + list_max(list_transform(range(4), lambda i: [1, 2, 2, 3][i + 1] + [0, 1, 2, 3][CAST((i // 2 + f.k % 2) % 2 * 2 + (i % 2 + f.k % 3) % 2 + 1 AS INT)])) END AS black_max
  FROM full_ f JOIN cls USING (k) JOIN lay USING (k) JOIN part ON p_partkey = f.k),
fr AS (SELECT *, CASE WHEN k % 73 = 0 THEN 2305843009213693952 WHEN k % 79 = 0 THEN 0 ELSE CAST(p_size * 10 * ps AS BIGINT) END AS row_stride FROM fr0),
w AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 1 THEN [p_size / 10.0, 1.0, 2.0] WHEN 2 THEN [2.0, 1.0, p_size / 5.0] ELSE [1.0, 1.0, 1.0] END AS m FROM part)"""
_CODE = "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e, _ in _RULES) + " ELSE 0 END"
_SAID = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in _RULES) + " END"


@query(f"WITH {BUILT} SELECT k, layout, route, crop_w, CAST(m[2] AS DOUBLE) / CAST(m[1] AS DOUBLE) AS red, CAST(m[2] AS DOUBLE) / CAST(m[3] AS DOUBLE) AS blue, {_CODE} AS error_code, {_SAID} AS reason FROM fr JOIN w USING (k)")
def q_frame_build(spark, d):
    """Reports to frame descriptions: layout, areas, black, white and neutral, matrix, all input rules in order."""
    matrix = lambda f: adapter.camera_matrix(f, "rgb_cam", "cam_xyz", "raw_color", "colors")
    built = adapter.build(reported(spark, d), [with_layout(spark, d), areas, blacks, white_and_neutral, matrix, adapter.frames_validated])
    return built.select("k", "layout", "route", "crop_w", F.col("neutral")[0].alias("red"), F.col("neutral")[2].alias("blue"), "error_code", "reason")


@query(f"WITH {BUILT}, j AS (SELECT {_CODE} AS error_code, {_SAID} AS reason FROM fr) SELECT error_code, reason, count(*) AS frames FROM j GROUP BY 1, 2")
def q_input_rules(spark, d):
    """How many frames each rule turns away."""
    return q_frame_build(spark, d).groupBy("error_code", "reason").agg(F.count("*").alias("frames"))
