"""What a raw decoder reports, turned into a frame description that the pipeline accepts: one row per frame, stage by stage.

Matrix algebra is columns: products, the adjugate and row scales are written out over arrays of nine, with binary32 rounding
where the result is stored so. A frame that can't be described keeps its row, with a code and a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import apart
from . import contracts

METADATA, UNSUPPORTED, OVERFLOW = -206, -205, -210

# The chromaticity of the connection space's white (D50), and sRGB primaries in that space before its rows are scaled to it.
WHITE_XY = (0.3457, 0.3585)
SRGB_TO_SPACE = [[0.4361, 0.3851, 0.1431], [0.2225, 0.7169, 0.0606], [0.0139, 0.0971, 0.7141]]


def binary32(x: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


SPACE_WHITE = [binary32(v) for v in (WHITE_XY[0] / WHITE_XY[1], 1.0, (1 - WHITE_XY[0] - WHITE_XY[1]) / WHITE_XY[1])]
SRGB = [[binary32(v * (SPACE_WHITE[r] / sum(row))) for v in row] for r, row in enumerate(SRGB_TO_SPACE)]


def stored(c: Column) -> Column:
    """A number as it is after being kept in binary32."""
    return c.cast("float").cast("double")


def finite(a: Column) -> Column:
    return F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def camera_matrix(df: DataFrame, rgb_cam: str, cam_xyz: str, raw_color: str, colors: str) -> DataFrame:
    """df with route (rgb_cam, cam_xyz or none), matrix (nine doubles, row-major, null without a route) and matrix_reason.

    rgb_cam: sRGB from camera, three rows of four. cam_xyz: camera from XYZ, four rows of three. Sensors of four colours have no 3 x 3 matrix. The
    first route needs a matched camera (raw_color 0), three colours, finite entries and something other than the identity; it keeps white by
    itself. The second inverts cam_xyz and scales each row onto the white of the connection space. Nothing is ever made up.
    """
    c = F.col
    nine = [F.get(rgb_cam, 4 * r + k) for r in range(3) for k in range(3)]
    identity = F.lit(True)
    for k, v in enumerate(nine):
        identity = identity & (F.abs(v - (1.0 if k % 4 == 0 else 0.0)) <= 1e-6)
    first = c(rgb_cam).isNotNull() & (c(raw_color) == 0) & (c(colors) == 3) & finite(F.array(*nine)) & ~identity
    product = [stored(sum((F.lit(SRGB[r][k]) * stored(nine[3 * k + j]) for k in range(1, 3)), F.lit(SRGB[r][0]) * stored(nine[j]))) for r in range(3) for j in range(3)]
    m = [stored(F.get(cam_xyz, k)) for k in range(9)]
    adjugate = [
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    ]
    det = m[0] * adjugate[0] + m[1] * adjugate[3] + m[2] * adjugate[6]
    given = c(cam_xyz).isNotNull() & F.exists(cam_xyz, lambda v: v != 0)
    df = apart(df.withColumns({"__first": F.coalesce(first, F.lit(False)), "__given": F.coalesce(given, F.lit(False)), "__adj": F.array(*adjugate), "__det": det}))
    sound = finite(F.array("__det")) & (F.abs("__det") >= 1e-12)
    df = apart(df.withColumn("__inv", F.when(F.coalesce(sound, F.lit(False)), F.transform("__adj", lambda v: stored(v / c("__det"))))))
    sums = [F.get("__inv", 3 * r) + F.get("__inv", 3 * r + 1) + F.get("__inv", 3 * r + 2) for r in range(3)]
    df = apart(df.withColumn("__sums", F.array(*sums)))
    scaled = [stored(F.get("__inv", 3 * r + k) * (F.lit(SPACE_WHITE[r]) / F.get("__sums", r))) for r in range(3) for k in range(3)]
    scalable = F.forall("__sums", lambda s: F.abs(s) > 1e-8)
    invertible = c("__inv").isNotNull() & finite(c("__inv"))
    route = F.when(c(colors) >= 4, "none").when(c("__first"), "rgb_cam").when(c("__given") & (c(colors) >= 3) & invertible & scalable, "cam_xyz").otherwise("none")
    reason = (
        F.when(c(colors) >= 4, "four colours have no 3x3 matrix")
        .when(c("__first"), F.lit(None).cast("string"))
        .when(~c("__given") | (c(colors) < 3), "no usable colour data")
        .when(~invertible, "cam_xyz is not invertible")
        .when(~scalable, "a row of the inverse sums to zero")
    )
    out = df.withColumns({"route": route, "matrix_reason": reason})
    matrix = F.when(c("route") == "rgb_cam", F.array(*product)).when(c("route") == "cam_xyz", F.array(*scaled))
    return out.withColumn("matrix", matrix).drop("__first", "__given", "__adj", "__det", "__inv", "__sums")


def frame_rules() -> list[tuple[Column, int, str]]:
    """What must hold of a frame, in the order in which it is told. Columns as in frames_validated."""
    c = F.col
    known = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    inside = lambda r: contracts.rect_inside(c(f"{r}_x"), c(f"{r}_y"), c(f"{r}_w"), c(f"{r}_h"), c("width"), c("height"))
    cfa, linear = c("model") == "cfa", c("layout") == "linear_rgb"
    rows = (c("height").cast("decimal(20,0)") - 1) * c("row_stride").cast("decimal(20,0)")
    last = rows + c("width").cast("decimal(20,0)") * c("pixel_stride")
    return [
        (c("planes") > 0, METADATA, "no planes"),
        ((c("width") > 0) & (c("height") > 0), METADATA, "empty plane"),
        (c("has_data"), METADATA, "plane without data"),
        ((c("row_stride") > 0) & (c("pixel_stride") > 0), METADATA, "stride is not positive"),
        (rows + c("row_stride") <= F.lit((1 << 63) - 1).cast("decimal(20,0)"), OVERFLOW, "size of the plane overflows"),
        (c("pixel_stride") >= c("sample_bytes"), METADATA, "pixel stride is shorter than a sample"),
        (c("bytes") >= last, METADATA, "data end before the last pixel"),
        (inside("active"), METADATA, "active area is outside the plane"),
        (inside("crop"), METADATA, "crop is outside the plane"),
        (~cfa | (c("pattern_count") == c("side") * c("side")), METADATA, "pattern count is not that of the repeat"),
        (~cfa | F.forall("component_black", lambda v: v == 0), METADATA, "component black beside a pattern"),
        (F.size("black") <= 64, METADATA, "black repeat is above the ceiling"),
        (F.forall("black", lambda v: known(v) & (v >= 0)), METADATA, "black is negative or not finite"),
        (known(c("white")) & (c("white") > 0), METADATA, "white is not positive or not finite"),
        (F.array_max("black") < c("white"), METADATA, "black is not below white"),
        (F.forall("component_black", lambda v: known(v) & (v >= 0)), METADATA, "component black is negative or not finite"),
        (F.array_max("component_black") < c("white"), METADATA, "component black is not below white"),
        (c("matrix").isNotNull() | (c("layout") == "monochrome"), METADATA, "colour matrix is missing"),
        (c("layout").isin(contracts.PRODUCTION), UNSUPPORTED, "layout is not supported"),
        (~linear | ((c("planes") == 1) & (c("components") == 3) & (c("sample_bytes") == 2)), UNSUPPORTED, "linear colour needs one interleaved plane of three samples"),
        (~linear | (c("pattern_count") == 0), METADATA, "linear colour with a pattern"),
        (~linear | (c("pixel_stride") == 6), UNSUPPORTED, "linear colour needs a pixel stride of 6"),
        (~linear | ((F.size("black") == 1) & (F.get("black", 0) == 0)), METADATA, "linear colour with a black tile"),
        (linear | ((c("planes") == 1) & (c("components") == 1) & (c("sample_bytes") == 2)), UNSUPPORTED, "mosaics need one plane of one sample"),
    ]


def frames_validated(frames: DataFrame) -> DataFrame:
    """frames with error_code and reason of the first rule that does not hold (0 and null if all do).

    Columns: planes, components, width, height, has_data, row_stride, pixel_stride, sample_bytes, bytes, active_x/y/w/h, crop_x/y/w/h, model, layout,
    side, pattern_count, black (array), component_black (array), white, matrix. A null in any of them is a rule that does not hold.
    """
    code, reason = contracts.first_failure(frame_rules())
    return frames.withColumns({"error_code": code, "reason": reason})


def build(frames: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stages in order, each a step of its own in the plan so that none repeats the text of those below it."""
    for stage in stages:
        frames = apart(stage(frames))
    return frames
