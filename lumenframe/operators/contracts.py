"""Layout classification and input contracts. A failed contract is a row with an error code and a reason, never an
exception; of several failures the first in the order of the checks is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RED, GREEN, BLUE, OTHER_GREEN, UNKNOWN = 0, 1, 2, 3, 9
MAX_REPEAT = 8
PIXEL_LIMIT = 1 << 28
PRODUCTION = ["bayer", "xtrans", "linear_rgb"]

# Colour letters and the keys that they stand for.
COLOUR_KEYS = {"R": 0, "G": 1, "B": 2, "C": 4, "M": 5, "Y": 6, "W": 7, "E": 8}
# The 2 x 2 patterns of the four phases, by the place of the red site.
PHASES = {"RGGB": [0, 1, 1, 2], "GRBG": [1, 0, 2, 1], "GBRG": [1, 2, 0, 1], "BGGR": [2, 1, 1, 0]}


def first_failure(checks: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(error code, reason) of the first check that does not hold; 0 and null if all do."""
    code, reason = F.lit(0), F.lit(None).cast("string")
    for holds, error, said in reversed(checks):
        bad = ~F.coalesce(holds, F.lit(False))
        code, reason = F.when(bad, error).otherwise(code), F.when(bad, said).otherwise(reason)
    return code, reason


def count_of(pattern: Column, keys: list[int]) -> Column:
    return F.size(F.filter(pattern, lambda k: k.isin(keys)))


def is_shift_of(pattern: Column, tile: list[int], side: int = 6) -> Column:
    """Whether a pattern is the tile moved round by some rows and columns; both kinds of green count as one."""
    shifts = []
    for dy in range(side):
        for dx in range(side):
            shifts.append([tile[(y + dy) % side * side + (x + dx) % side] for y in range(side) for x in range(side)])
    plain = F.transform(pattern, lambda k: F.when(k == OTHER_GREEN, GREEN).otherwise(k))
    return F.array_join(plain, "").isin(["".join(map(str, s)) for s in shifts])


def layout_class(model: Column, w: Column, h: Column, pattern: Column, six_by_six: list[int]) -> Column:
    """bayer, xtrans, other_cfa, linear_rgb, monochrome or invalid."""
    greens = F.when((w == 6) & (h == 6), count_of(pattern, [GREEN, OTHER_GREEN])).otherwise(count_of(pattern, [GREEN]))
    reds, blues = count_of(pattern, [RED]), count_of(pattern, [BLUE])
    sound = pattern.isNotNull() & w.between(1, MAX_REPEAT) & h.between(1, MAX_REPEAT) & (F.size(pattern) == w * h) & (count_of(pattern, [UNKNOWN]) == 0)
    bayer = (w == 2) & (h == 2) & (reds == 1) & (blues == 1) & (greens == 2)
    xtrans = (w == 6) & (h == 6) & (greens == 20) & (reds == 8) & (blues == 8) & is_shift_of(pattern, six_by_six)
    cfa = F.when(~F.coalesce(sound, F.lit(False)), "invalid").when(bayer, "bayer").when(xtrans, "xtrans").otherwise("other_cfa")
    return F.when(model == "cfa", cfa).when(model == "rgb", "linear_rgb").when(model == "mono", "monochrome").otherwise("invalid")


def red_phase(pattern: Column) -> Column:
    """The place of the first red site of a 2 x 2 pattern as (y, x) digits; RGGB's without one."""
    at = F.greatest(F.array_position(pattern, RED) - 1, F.lit(0))
    return F.concat(F.floor(at / 2).cast("string"), (at % 2).cast("string"))


def rect_inside(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a rectangle with an area lies in an image, in 64-bit arithmetic."""
    long = lambda c: c.cast("long")
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (long(x) + long(w) <= long(width)) & (long(y) + long(h) <= long(height))


def within_ceiling(w: Column, h: Column) -> Column:
    return w.cast("long") * h.cast("long") <= PIXEL_LIMIT


def two_row_period(word: Column) -> Column:
    """Whether a packed 32-bit filter word, 4 bits to a row of two sites, repeats every two rows; 1 is no pattern."""
    rows = [F.shiftrightunsigned(word, 4 * k).bitwiseAND(F.lit(15)) for k in range(8)]
    same = F.lit(True)
    for k in range(2, 8):
        same = same & (rows[k] == rows[k - 2])
    return same & (word != 1)


def merged_black(base: Column, by_colour: Column, pattern: Column, spatial: Column, side: int, spatial_side: int, margin_x: Column, margin_y: Column) -> Column:
    """The black level of each site of the tile that both patterns repeat in: base, colour and spatial parts added."""
    tile = side * spatial_side if side % spatial_side and spatial_side % side else max(side, spatial_side)
    sites = F.sequence(F.lit(0), F.lit(tile * tile - 1))

    def at(k: Column) -> Column:
        y, x = F.floor(k / tile), k % tile
        colour = F.get(pattern, ((y % side) * side + x % side).cast("int"))
        place = F.pmod(y + margin_y, F.lit(spatial_side)) * spatial_side + F.pmod(x + margin_x, F.lit(spatial_side))
        return base + F.get(by_colour, colour.cast("int")) + F.get(spatial, place.cast("int"))

    return F.transform(sites, at)


def neutral_of(applied: Column, shot: Column, preset: Column) -> Column:
    """Camera neutral: ones where white balance is in the data; else from the shot's multipliers, the preset's, or ones."""
    usable = lambda m: m.isNotNull() & (F.size(m) == 3) & F.forall(m, lambda v: v > 0)
    ones = F.array(*[F.lit(1.0)] * 3)
    chosen = F.when(applied, ones).when(F.coalesce(usable(shot), F.lit(False)), shot).when(F.coalesce(usable(preset), F.lit(False)), preset).otherwise(ones)
    return F.transform(chosen, lambda v: F.get(chosen, 1) / v)


def inverse3(m: list[Column]) -> tuple[list[Column], Column]:
    """(adjugate over determinant, determinant) of a row-major 3 x 3 matrix; null where singular."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adj = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return [F.when(F.abs(det) > 1e-12, x / det) for x in adj], det


def frames_judged(frames: DataFrame) -> DataFrame:
    """frames with error_code and reason. Columns: planes, width, height, stride, pixel_bytes, bytes, crop_x, crop_y,
    crop_w, crop_h, layout, black, white, has_matrix."""
    c = F.col
    needed = (c("height").cast("long") - 1) * c("stride") + c("width").cast("long") * c("pixel_bytes")
    code, reason = first_failure(
        [
            (c("planes") == 1, -202, "one plane is needed"),
            ((c("width") > 0) & (c("height") > 0), -203, "empty image"),
            (within_ceiling(c("width"), c("height")), -203, "image above the ceiling"),
            (c("stride") >= c("width") * c("pixel_bytes"), -204, "row stride is too short"),
            (c("bytes") >= needed, -204, "buffer ends before the last pixel"),
            (rect_inside(c("crop_x"), c("crop_y"), c("crop_w"), c("crop_h"), c("width"), c("height")), -205, "crop is outside the image"),
            (c("layout") != "invalid", -206, "layout is invalid"),
            ((c("black") >= 0) & (c("black") < c("white")), -207, "black is not in [0, white)"),
            (c("has_matrix") | (c("layout") == "monochrome"), -208, "colour matrix is missing"),
            (c("layout").isin(PRODUCTION), -209, "layout is not supported"),
        ]
    )
    return frames.withColumns({"error_code": code, "reason": reason})


ENCODE_FORMATS = ["jpeg", "webp", "jxl", "heic", "avif"]


def encode_requests_judged(requests: DataFrame) -> DataFrame:
    """requests with error_code and reason. Columns: has_pixels, format, width, height, effort, quality, lossless,
    metadata_length, has_metadata."""
    c = F.col
    code, reason = first_failure(
        [
            (c("has_pixels"), -401, "no pixels"),
            (c("format").isin(ENCODE_FORMATS), -402, "unknown format"),
            (c("width").between(1, 65535) & c("height").between(1, 65535), -403, "size out of range"),
            (c("effort").between(0, 10), -404, "effort out of range"),
            (c("lossless") | c("quality").between(1, 100), -405, "quality out of range"),
            (~(c("lossless") & (c("format") == "jpeg")), -406, "no lossless form of this format"),
            (c("has_metadata") == (c("metadata_length") > 0), -407, "metadata and length disagree"),
        ]
    )
    return requests.withColumns({"error_code": code, "reason": reason})


def unpacked_layout(has_mosaic: Column, filters: Column, colours: Column, sizes_match: Column) -> Column:
    """mosaic, colour3 or unsupported, by what a raw decoder has unpacked."""
    flat = filters == 0
    mosaic = has_mosaic & ~(flat & (colours != 1)) & sizes_match
    return F.when(mosaic, "mosaic").when(~mosaic & flat & (colours == 3) & sizes_match, "colour3").otherwise("unsupported")


def bends(curves: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """key, bent: whether any place of a curve differs from the identity."""
    return curves.groupBy(key).agg(F.bool_or(F.col(value) != F.col(index)).alias("bent"))


def opcode_order(opcodes: DataFrame) -> DataFrame:
    """frame_id, plan: the handlers of a frame's opcodes in list order, neighbours of one handler merged.

    Opcodes without a place come last, as in SQL. Those of equal places are ordered by handler, both where neighbours are merged and where
    they are listed: either order alone could part neighbours that the other has merged.
    """
    handler = F.when(F.col("opcode") == 1, "warp").when(F.col("opcode") == 8, "polynomial").otherwise("other")
    w = Window.partitionBy("frame_id").orderBy(F.asc_nulls_last("place"), "handler")
    marked = opcodes.withColumn("handler", handler).withColumn("before", F.lag("handler").over(w))
    runs = marked.where("before IS NULL OR before != handler OR handler = 'warp'")
    listed = F.array_sort(F.collect_list(F.struct(F.isnull("place").alias("last"), "place", "handler")))
    return runs.groupBy("frame_id").agg(F.array_join(F.transform(listed, lambda s: s["handler"]), ">").alias("plan"))
