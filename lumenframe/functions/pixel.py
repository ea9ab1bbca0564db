"""Pixel arithmetic as columns. Samples are integers, colour is DOUBLE in [0, 1] unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 65535


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def inverse_range(black: Column, white: Column) -> Column:
    """Factor from a sample above black to the full 16-bit range; 1 where white is not above the highest black."""
    span = white - F.array_max(black)
    return F.when(span > 0, F.lit(float(TOP)) / span).otherwise(1.0)


def normalised(v: Column, black: Column, inverse: Column, rounded: bool) -> Column:
    """A sample on the 16-bit range in binary32 arithmetic: mosaics truncate, colour samples round half up."""
    f = (v.cast("float") - black.cast("float")) * inverse.cast("float")
    f = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(float(TOP)).cast("float"), f))
    return F.floor(f + F.lit(0.5).cast("float")).cast("int") if rounded else f.cast("int")


def polynomial(v: Column, coefficients: list[float], span: float = float(TOP)) -> Column:
    """A polynomial over v / span, clamped, back on the range of v."""
    x = v.cast("double") / span
    y = reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    return F.floor(clamp(y, 0.0, 1.0) * span + 0.5).cast("int")


def matrix(rgb: tuple[Column, Column, Column], m: list[list[float]]) -> tuple[Column, ...]:
    return tuple(clamp((rgb[0] * row[0] + rgb[1] * row[1]) + rgb[2] * row[2], 0.0, 1.0) for row in m)


def lut(f: Callable[[float], float], n: int = 4096) -> list[float]:
    """A function sampled at n + 1 places of [0, 1]; the last is there twice, so that 1 can be interpolated."""
    return [f(min(i, n) / n) for i in range(n + 2)]


def listed(values: list[float]) -> Column:
    """Numbers as one array literal. Written as text, which is parsed once while the plan is made, so that the plan
    does not hold an expression for each number."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def interpolated(v: Column, table: Column, n: int = 4096) -> Column:
    y = clamp(v, 0.0, 1.0) * n
    i = F.floor(y).cast("int")
    part = y - i
    return F.get(table, i) * (1.0 - part) + F.get(table, i + 1) * part


def srgb_encode(x: float) -> float:
    return 12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055


def to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 6), saturation and value of the hexcone."""
    v, gap = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    red = (g - b) / gap
    h = F.when(gap <= 0, 0.0).when(r == v, F.when(red < 0, red + 6).otherwise(red)).when(g == v, 2.0 + (b - r) / gap).otherwise(4.0 + (r - g) / gap)
    return h, F.when(gap <= 0, 0.0).otherwise(gap / v), v


def to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    i = F.floor(h)
    f = h - i
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    pick = lambda *c: F.when(i == 0, c[0]).when(i == 1, c[1]).when(i == 2, c[2]).when(i == 3, c[3]).when(i == 4, c[4]).otherwise(c[5])
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def hsv_mapped(h: Column, s: Column, v: Column, cube: list[tuple[float, float, float]], hues: int, sats: int, vals: int) -> tuple[Column, Column, Column]:
    """h, s, v shifted and scaled by a trilinearly interpolated cube of (degrees, saturation factor, value factor).

    The cube lists value by value, in each hue by hue, in each saturation by saturation. The hue may leave [0, 6).
    """
    hs, ss, vs = h * (hues / 6.0), s * float(sats - 1), v * float(vals - 1)
    h0 = F.greatest(F.lit(0), F.least(F.lit(hues - 1), F.floor(hs))).cast("int")
    h1 = F.when(h0 >= hues - 1, 0).otherwise(h0 + 1)
    s0 = F.greatest(F.lit(0), F.least(F.lit(sats - 2), F.floor(ss))).cast("int")
    v0 = F.greatest(F.lit(0), F.least(F.lit(max(vals - 2, 0)), F.floor(vs))).cast("int")
    fh, fs, fv = hs - h0, ss - s0, (vs - v0 if vals > 1 else F.lit(0.0))
    last = len(cube) - 1

    def part(k: int) -> Column:
        table = listed([c[k] for c in cube])
        get = lambda vi, hi, si: F.get(table, F.least(F.lit(last), (vi * hues + hi) * sats + si))
        plane = lambda vi: (1.0 - fs) * ((1.0 - fh) * get(vi, h0, s0) + fh * get(vi, h1, s0)) + fs * ((1.0 - fh) * get(vi, h0, s0 + 1) + fh * get(vi, h1, s0 + 1))
        return (1.0 - fv) * plane(v0) + fv * plane(v0 + 1)

    return h + part(0) * (6.0 / 360.0), F.least(s * part(1), F.lit(1.0)), clamp(v * part(2), 0.0, 1.0)


def toned_channel(c: Column, hi: Column, lo: Column, hi_toned: Column, lo_toned: Column) -> Column:
    """A tone curve that keeps hue: the largest and the smallest channel go through it, the middle one keeps its
    relative place between them."""
    return F.when(c == hi, hi_toned).when(c == lo, lo_toned).otherwise(lo_toned + (hi_toned - lo_toned) * (c - lo) / (hi - lo))


def apart(df: DataFrame) -> DataFrame:
    """df behind a filter that always holds but is not known to: the projections on its two sides stay two, where
    merging them would repeat the text of the lower one in the upper one for each use."""
    return df.where(F.monotonically_increasing_id() >= 0)


def encode8(v: Column, gamma: Callable[[Column], Column]) -> Column:
    return clamp(gamma(v) * 255.0 + 0.5, 0.0, 255.0).cast("int")


# ITU-R BT.601 full-range weights at 16 bits of fraction, as JPEG uses them.
LUMA = (19595, 38470, 7471, 32768)
CB = (-11059, -21709, 32768, (128 << 16) + 32767)
CR = (32768, -27439, -5329, (128 << 16) + 32767)
CR_TO_R, CB_TO_B, CR_TO_G, CB_TO_G = 91881, 116130, -46802, -22554


def weighed(r: Column, g: Column, b: Column, w: tuple[int, int, int, int]) -> Column:
    return F.shiftright(r * w[0] + g * w[1] + b * w[2] + w[3], 16)


def from_ycc(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    u, v, half = cb - 128, cr - 128, 1 << 15
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x))
    return (byte(y + F.shiftright(v * CR_TO_R + half, 16)), byte(y + F.shiftright(u * CB_TO_G + v * CR_TO_G + half, 16)), byte(y + F.shiftright(u * CB_TO_B + half, 16)))


def scaled(side: Column, long_edge: Column, most: Column) -> Column:
    """A side after scaling so that the long edge is most; unchanged if that would not shrink it."""
    return F.when((most == 0) | (most >= long_edge), side).otherwise(F.greatest(F.lit(1), F.floor(side * (most / long_edge) + 0.5))).cast("long")


def oriented(x: Column, y: Column, width: int, height: int, orientation: int) -> tuple[Column, Column]:
    """Where a pixel goes for an EXIF orientation; 5 to 8 swap the sides, anything else but 1 to 8 counts as 1."""
    right, bottom = width - 1 - x, height - 1 - y
    return {2: (right, y), 3: (right, bottom), 4: (x, bottom), 5: (y, x), 6: (bottom, x), 7: (bottom, right), 8: (y, right)}.get(orientation, (x, y))
