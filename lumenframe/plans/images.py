"""Queries over images: pixel arithmetic, stencils, statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..operators import metrics, stencil, warp
from ..sources.fixtures import HEIGHT, WIDTH, pixels, table, triples
from .registry import query

BLACK = [512, 520, 516, 524]
WHITE = 60000
# Camera to working space and working space to output space of the example rendering.
CAMERA = [[0.8, 0.15, 0.05], [0.1, 0.85, 0.05], [0.02, 0.08, 0.9]]
FINAL = [[1.2, -0.15, -0.05], [-0.1, 1.2, -0.1], [0.0, -0.1, 1.1]]
CAMERA_WHITE = [0.9, 1.0, 0.8]
HUES, SATS, VALS = 6, 4, 3
CUBE = [((3 * h + 5 * s + 7 * v) % 11 - 5, 1 + ((h + 2 * s + v) % 5 - 2) / 20, 1 + ((2 * h + s + 3 * v) % 7 - 3) / 50) for v in range(VALS) for h in range(HUES) for s in range(SATS)]
# The canonical 6 x 6 mosaic of a colour filter with 20 green, 8 red and 8 blue sites (1 green, 0 red, 2 blue).
SIX_BY_SIX = [1, 1, 0, 1, 1, 2, 1, 1, 2, 1, 1, 0, 2, 0, 1, 0, 2, 1, 1, 1, 2, 1, 1, 0, 1, 1, 0, 1, 1, 2, 0, 2, 1, 2, 0, 1]
RADIAL, TANGENTIAL = [1.0, -0.05, 0.02, -0.005], [0.001, -0.0005]

_V = "CAST(least(greatest(floor((CAST({} AS DOUBLE) + 1) * 32767.5 + 0.5), 0), 65535) AS INT)"
PX = f"px AS (SELECT vec_id // 50 AS frame_id, CAST(vec_id % 50 AS INT) AS y, CAST(i - 1 AS INT) AS x, {_V.format('embedding[i]')} AS v FROM embeddings, range(1, 65) t(i))"
RGB = f"rgb AS (SELECT vec_id // 50 AS frame_id, CAST(vec_id % 50 AS INT) AS y, CAST(i AS INT) AS x, {_V.format('embedding[3 * i + 1]')} AS r, {_V.format('embedding[3 * i + 2]')} AS g, {_V.format('embedding[3 * i + 3]')} AS b FROM embeddings, range(0, 21) t(i))"
UNIT = RGB + ", unit AS (SELECT frame_id, y, x, r / 65535.0::DOUBLE AS r, g / 65535.0::DOUBLE AS g, b / 65535.0::DOUBLE AS b FROM rgb)"


def unit(spark, d) -> DataFrame:
    """Linear RGB as DOUBLE in [0, 1]."""
    return triples(spark, d).select("frame_id", "y", "x", *[(F.col(c) / 65535.0).alias(c) for c in "rgb"])


def rgb_columns() -> tuple:
    return F.col("r"), F.col("g"), F.col("b")


def with_rgb(df: DataFrame, rgb) -> DataFrame:
    return df.select("frame_id", "y", "x", *[c.alias(k) for c, k in zip(rgb, "rgb", strict=True)])


# samples


@query("SELECT p_partkey AS k, CASE WHEN p_retailprice - greatest(p_size, p_size * 2, 100) > 0 THEN 65535.0::DOUBLE / (p_retailprice - greatest(p_size, p_size * 2, 100)) ELSE 1.0 END AS inverse FROM part")
def q_inv_range(spark, d):
    black = F.array(F.col("p_size").cast("double"), F.col("p_size") * 2.0, F.lit(100.0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), px.inverse_range(black, F.col("p_retailprice")).alias("inverse"))


_F32 = "greatest(0::FLOAT, least(65535::FLOAT, (v::FLOAT - (CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 512 WHEN y % 2 = 0 THEN 520 WHEN x % 2 = 0 THEN 516 ELSE 524 END)::FLOAT) * (65535.0::DOUBLE / (60000 - 524))::FLOAT))"


def normalised_mosaic(spark, d) -> DataFrame:
    black = F.get(F.lit(BLACK), ((F.col("y") % 2) * 2 + F.col("x") % 2).cast("int"))
    inverse = px.inverse_range(F.lit([float(b) for b in BLACK]), F.lit(float(WHITE)))
    return pixels(spark, d).withColumn("v", px.normalised(F.col("v"), black, inverse, rounded=False))


@query(f"WITH {PX} SELECT frame_id, y, x, CAST(trunc({_F32}) AS INT) AS v FROM px")
def q_normalize_cfa(spark, d):
    return normalised_mosaic(spark, d)


LINEAR_SQL = (
    ", n AS (SELECT frame_id, y, x, "
    + ", ".join(f"CAST(floor(greatest(0::FLOAT, least(65535::FLOAT, ({c}::FLOAT - {b}::FLOAT) * (65535.0::DOUBLE / (60000 - 520))::FLOAT)) + 0.5::FLOAT) AS INT) AS {c}" for c, b in zip("rgb", (512, 516, 520), strict=True))
    + " FROM rgb)"
)


@query(f"WITH {RGB}{LINEAR_SQL} SELECT * FROM n")
def q_normalize_linear(spark, d):
    inverse = px.inverse_range(F.lit([512.0, 516.0, 520.0]), F.lit(float(WHITE)))
    return with_rgb(triples(spark, d), [px.normalised(c, F.lit(b), inverse, rounded=True) for c, b in zip(rgb_columns(), (512, 516, 520), strict=True)])


_POLY = "CAST(floor(greatest(0.0, least(1.0, {c0} + ({v} / 65535.0::DOUBLE) * ({c1} + ({v} / 65535.0::DOUBLE) * ({c2} + ({v} / 65535.0::DOUBLE) * {c3})))) * 65535.0 + 0.5) AS INT)"
POLYNOMIALS = [[0.01, 0.9, 0.2, -0.1], [0.0, 1.1, -0.05, -0.02], [0.02, 0.8, 0.1, 0.05]]


def _poly(v: str, c: list[float]) -> str:
    return _POLY.format(v=v, **{f"c{i}": f"({x}::DOUBLE)" for i, x in enumerate(c)})


@query(f"WITH {PX} SELECT frame_id, y, x, {_poly('v', POLYNOMIALS[0])} AS v FROM px")
def q_map_polynomial(spark, d):
    return pixels(spark, d).withColumn("v", px.polynomial(F.col("v"), POLYNOMIALS[0]))


@query("WITH " + RGB + " SELECT frame_id, y, x, " + ", ".join(f"{_poly(c, p)} AS {c}" for c, p in zip("rgb", POLYNOMIALS, strict=True)) + " FROM rgb")
def q_map_polynomial3(spark, d):
    return with_rgb(triples(spark, d), [px.polynomial(c, p) for c, p in zip(rgb_columns(), POLYNOMIALS, strict=True)])


# rendering


def wb_clip(rgb):
    return tuple(F.least(c, F.lit(w)) for c, w in zip(rgb, CAMERA_WHITE, strict=True))


def tone_curve(x: float) -> float:
    return x**0.5 * (1 - 0.2 * x) + 0.2 * x


def ramp_curve(x: float) -> float:
    return min(1.0, max(0.0, (x - 0.002) / 0.9))


def curve(f):
    return lambda v: px.interpolated(v, px.listed(px.lut(f)))


GAMMA, TONE, RAMP = px.srgb_encode, tone_curve, ramp_curve
_TONE = "(sqrt({x}) * (1 - 0.2::DOUBLE * {x}) + 0.2::DOUBLE * {x})"
_RAMP = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({x} - 0.002::DOUBLE) / 0.9::DOUBLE))"
_GAMMA = "(CASE WHEN {x} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {x} ELSE 1.055::DOUBLE * pow({x}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)"


def _lerp(f: str, v: str) -> str:
    y = f"(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v})) * 4096)"
    at = lambda k: f.format(x=f"(least(floor({y}) + {k}, 4096) / 4096.0::DOUBLE)")
    return f"({at(0)} * (1 - ({y} - floor({y}))) + {at(1)} * ({y} - floor({y})))"


def hsv_step(df: DataFrame) -> DataFrame:
    h, s, v = px.to_hsv(*rgb_columns())
    return df.select("frame_id", "y", "x", h.alias("h"), s.alias("s"), v.alias("v"))


def cube_step(df: DataFrame) -> DataFrame:
    h, s, v = px.hsv_mapped(F.col("h"), F.col("s"), F.col("v"), CUBE, HUES, SATS, VALS)
    hue = F.when(F.col("h") < 0, F.col("h") + 6).when(F.col("h") >= 6, F.col("h") - 6).otherwise(F.col("h"))
    return px.apart(df.select("frame_id", "y", "x", h.alias("h"), s.alias("s"), v.alias("v"))).withColumn("h", hue)


def rgb_step(df: DataFrame) -> DataFrame:
    return with_rgb(df, px.to_rgb(F.col("h"), F.col("s"), F.col("v")))


def tone_step(df: DataFrame) -> DataFrame:
    """The ends of the range go through the curve once per pixel, in a step of their own."""
    hi, lo = F.greatest(*rgb_columns()), F.least(*rgb_columns())
    ends = px.apart(df.select("frame_id", "y", "x", "r", "g", "b", hi.alias("hi"), lo.alias("lo")))
    ends = px.apart(ends.withColumns({"hi_t": curve(TONE)(F.col("hi")), "lo_t": curve(TONE)(F.col("lo"))}))
    return with_rgb(ends, [px.toned_channel(c, F.col("hi"), F.col("lo"), F.col("hi_t"), F.col("lo_t")) for c in rgb_columns()])


STEPS = [
    lambda df: with_rgb(df, wb_clip(rgb_columns())),
    lambda df: with_rgb(df, px.matrix(rgb_columns(), CAMERA)),
    lambda df: rgb_step(px.apart(cube_step(px.apart(hsv_step(df))))),
    lambda df: with_rgb(df, [curve(RAMP)(c) for c in rgb_columns()]),
    tone_step,
    lambda df: with_rgb(df, px.matrix(rgb_columns(), FINAL)),
    lambda df: with_rgb(df, [px.encode8(c, curve(GAMMA)) for c in rgb_columns()]),
]


def stages(start: DataFrame, upto: int = 7) -> DataFrame:
    """The rendering chain: 1 white clip, 2 camera matrix, 3 HSV cube, 4 exposure ramp, 5 tone, 6 output matrix,
    7 eight-bit encoding. upto stops it early. The steps are kept apart, so that no expression holds another's
    text several times over; all of them run in one stage without a shuffle."""
    for step in STEPS[:upto]:
        start = px.apart(step(start))
    return start


CLIP = UNIT + ", clip AS (SELECT frame_id, y, x, least(r, 0.9::DOUBLE) AS r, least(g, 1.0::DOUBLE) AS g, least(b, 0.8::DOUBLE) AS b FROM unit)"


def _matrix(name: str, source: str, m: list[list[float]]) -> str:
    rows = ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (r * {a}::DOUBLE + g * ({b}::DOUBLE)) + b * ({c}::DOUBLE))) AS {k}" for k, (a, b, c) in zip("rgb", m, strict=True))
    return f", {name} AS (SELECT frame_id, y, x, {rows} FROM {source})"


CAM = CLIP + _matrix("cam", "clip", CAMERA)
_HSV = """, {out}0 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS gap FROM {src}),
{out} AS (SELECT frame_id, y, x, CASE WHEN gap <= 0 THEN 0.0 WHEN r = mx THEN CASE WHEN (g - b) / gap < 0 THEN (g - b) / gap + 6 ELSE (g - b) / gap END
  WHEN g = mx THEN 2 + (b - r) / gap ELSE 4 + (r - g) / gap END::DOUBLE AS h, CASE WHEN gap <= 0 THEN 0.0 ELSE gap / mx END::DOUBLE AS s, mx AS v FROM {out}0)"""
_RGB_OF = """, {out}0 AS (SELECT *, floor(h) AS i, v * (1 - s) AS p, v * (1 - s * (h - floor(h))) AS q, v * (1 - s * (1 - (h - floor(h)))) AS t FROM {src}),
{out} AS (SELECT frame_id, y, x, CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS r,
  CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END AS g, CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS b FROM {out}0)"""
HSV = CAM + _HSV.format(out="hsv", src="cam")


def _cube(k: int) -> str:
    f = ["((3 * {h} + 5 * {s} + 7 * {v}) % 11 - 5)", "(1 + ((({h} + 2 * {s} + {v}) % 5) - 2) / 20.0::DOUBLE)", "(1 + (((2 * {h} + {s} + 3 * {v}) % 7) - 3) / 50.0::DOUBLE)"][k]
    at = lambda v, h, s: f.format(v=v, h=h, s=s)
    plane = lambda v: f"((1 - fs) * ((1 - fh) * {at(v, 'h0', 's0')} + fh * {at(v, 'h1', 's0')}) + fs * ((1 - fh) * {at(v, 'h0', '(s0 + 1)')} + fh * {at(v, 'h1', '(s0 + 1)')}))"
    return f"((1 - fv) * {plane('v0')} + fv * {plane('(v0 + 1)')})"


MAPPED = (
    HSV
    + """, cell AS (SELECT *, CAST(greatest(0, least(5, floor(h))) AS INT) AS h0, CAST(greatest(0, least(2, floor(s * 3))) AS INT) AS s0, CAST(greatest(0, least(1, floor(v * 2))) AS INT) AS v0 FROM hsv),
place AS (SELECT *, CASE WHEN h0 >= 5 THEN 0 ELSE h0 + 1 END AS h1, h - h0 AS fh, s * 3 - s0 AS fs, v * 2 - v0 AS fv FROM cell),"""
    + f" moved AS (SELECT frame_id, y, x, h + {_cube(0)} * (6.0::DOUBLE / 360) AS h, least(s * {_cube(1)}, 1.0::DOUBLE) AS s, greatest(0.0::DOUBLE, least(1.0::DOUBLE, v * {_cube(2)})) AS v FROM place),"
    + " turned AS (SELECT frame_id, y, x, CASE WHEN h < 0 THEN h + 6 WHEN h >= 6 THEN h - 6 ELSE h END AS h, s, v FROM moved)"
)
MAPPED_RGB = MAPPED + _RGB_OF.format(out="mapped", src="turned")
RAMPED = MAPPED_RGB + ", ramped AS (SELECT frame_id, y, x, " + ", ".join(f"{_lerp(_RAMP, c)} AS {c}" for c in "rgb") + " FROM mapped)"
TONED = (
    RAMPED
    + f", ends AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, {_lerp(_TONE, 'greatest(r, g, b)')} AS hi_t, {_lerp(_TONE, 'least(r, g, b)')} AS lo_t FROM ramped)"
    + ", toned AS (SELECT frame_id, y, x, " + ", ".join(f"CASE WHEN {c} = hi THEN hi_t WHEN {c} = lo THEN lo_t ELSE lo_t + (hi_t - lo_t) * ({c} - lo) / (hi - lo) END AS {c}" for c in "rgb") + " FROM ends)"
)
OUT = TONED + _matrix("final", "toned", FINAL)
BYTES = OUT + ", bytes AS (SELECT frame_id, y, x, " + ", ".join(f"CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {_lerp(_GAMMA, c)} * 255 + 0.5))) AS INT) AS {c}" for c in "rgb") + " FROM final)"


@query(f"WITH {CLIP} SELECT * FROM clip")
def q_wb_clip(spark, d):
    return stages(unit(spark, d), 1)


@query(f"WITH {CAM} SELECT * FROM cam")
def q_cam_to_rgb(spark, d):
    return stages(unit(spark, d), 2)


@query(f"WITH {HSV} SELECT * FROM hsv")
def q_rgb_to_hsv(spark, d):
    return hsv_step(stages(unit(spark, d), 2))


@query(f"WITH {HSV}{_RGB_OF.format(out='back', src='hsv')} SELECT * FROM back")
def q_hsv_to_rgb(spark, d):
    return rgb_step(px.apart(q_rgb_to_hsv(spark, d)))


@query(f"WITH {MAPPED} SELECT * FROM turned")
def q_hsv_map(spark, d):
    return cube_step(px.apart(q_rgb_to_hsv(spark, d)))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_size / 10.0::DOUBLE % 6 END AS h, 0.5::DOUBLE AS s, 0.25::DOUBLE AS v FROM part")
def q_hsv_identity(spark, d):
    cube = [(0.0, 1.0, 1.0)] * 8
    h = F.when(F.col("p_partkey") % 7 == 0, 0.0).otherwise(F.col("p_size") / 10.0 % 6)
    m = px.hsv_mapped(h, F.lit(0.5), F.lit(0.25), cube, 2, 2, 2)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), *[c.alias(n) for c, n in zip(m, "hsv", strict=True)])


@query(f"WITH {RAMPED} SELECT * FROM ramped")
def q_exposure_ramp(spark, d):
    return stages(unit(spark, d), 4)


@query(f"WITH {TONED} SELECT * FROM toned")
def q_rgb_tone(spark, d):
    return stages(unit(spark, d), 5)


@query(f"WITH {OUT} SELECT * FROM final")
def q_rgb_to_final(spark, d):
    return stages(unit(spark, d), 6)


@query(f"WITH {UNIT} SELECT frame_id, y, x, CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {_lerp(_GAMMA, 'g')} * 255 + 0.5))) AS INT) AS v FROM unit")
def q_encode8(spark, d):
    return unit(spark, d).select("frame_id", "y", "x", px.encode8(F.col("g"), curve(GAMMA)).alias("v"))


@query(f"WITH {UNIT} SELECT frame_id, y, x, {_lerp(_TONE, 'r')} AS v FROM unit")
def q_lut_interp(spark, d):
    return unit(spark, d).select("frame_id", "y", "x", curve(TONE)(F.col("r")).alias("v"))


@query(f"SELECT CAST(i AS INT) AS i, {_TONE.format(x='(least(i, 4096) / 4096.0::DOUBLE)')} AS v FROM range(0, 4098) t(i)")
def q_lut_build(spark, d):
    x = F.least("i", F.lit(4096)) / 4096.0
    return spark.range(4098).select(F.col("id").cast("int").alias("i")).select("i", (F.sqrt(x) * (1 - 0.2 * x) + 0.2 * x).alias("v"))


@query(f"WITH {BYTES} SELECT frame_id, y, x, r, g, b, 255 AS a FROM bytes")
def q_render_stage4(spark, d):
    return stages(unit(spark, d)).withColumn("a", F.lit(255))


SPLIT = BYTES + ", s1 AS (SELECT 1 AS stage, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM clip UNION ALL SELECT 2, sum(r), sum(g), sum(b) FROM cam UNION ALL SELECT 5, sum(r), sum(g), sum(b) FROM toned UNION ALL SELECT 7, CAST(sum(r) AS DOUBLE), CAST(sum(g) AS DOUBLE), CAST(sum(b) AS DOUBLE) FROM bytes)"


@query(f"WITH {SPLIT} SELECT stage, round(r, 3) AS r, round(g, 3) AS g, round(b, 3) AS b FROM s1")
def q_render_stage4_split(spark, d):
    sums = None
    for k in (1, 2, 5, 7):
        one = stages(unit(spark, d), k).agg(*[F.round(F.sum(F.col(c)).cast("double"), 3).alias(c) for c in "rgb"]).select(F.lit(k).alias("stage"), "r", "g", "b")
        sums = one if sums is None else sums.unionByName(one)
    return sums


@query(
    """SELECT p_partkey AS k, 1 / greatest(0.001::DOUBLE, least(1.0::DOUBLE, (p_size + 10) / 60.0::DOUBLE)) AS gain, pow(2, -greatest(0, (p_partkey % 5) - 1)) AS white,
least((p_partkey % 20) * 0.001::DOUBLE, 0.99::DOUBLE * pow(2, -greatest(0, (p_partkey % 5) - 1))) AS black FROM part"""
)
def q_render_params(spark, d):
    white = F.pow(F.lit(2.0), -F.greatest(F.lit(0), F.col("p_partkey") % 5 - 1))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), (1 / px.clamp((F.col("p_size") + 10) / 60.0, 0.001, 1.0)).alias("gain"), white.alias("white"), F.least((F.col("p_partkey") % 20) * 0.001, 0.99 * white).alias("black"))


_ORIENT = ["x, y", "63 - x, y", "63 - x, 49 - y", "x, 49 - y", "y, x", "49 - y, x", "49 - y, 63 - x", "y, 63 - x"]


@query(f"WITH {PX} " + " UNION ALL ".join(f"SELECT {k + 1} AS orientation, frame_id, {e.split(',')[0]} AS x, {e.split(',')[1]} AS y, v FROM px" for k, e in enumerate(_ORIENT)))
def q_orient(spark, d):
    every = pixels(spark, d)
    out = None
    for k in range(1, 9):
        x, y = px.oriented(F.col("x"), F.col("y"), WIDTH, HEIGHT, k)
        part = every.select(F.lit(k).alias("orientation"), "frame_id", x.alias("x"), y.alias("y"), "v")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT p_partkey AS k, CASE WHEN m = 0 OR m >= l THEN w ELSE CAST(greatest(1, floor(w * (m / l::DOUBLE) + 0.5)) AS BIGINT) END AS width, CASE WHEN m = 0 OR m >= l THEN h ELSE CAST(greatest(1, floor(h * (m / l::DOUBLE) + 0.5)) AS BIGINT) END AS height FROM (SELECT p_partkey, p_size * 100::BIGINT AS w, p_partkey % 3000 + 1 AS h, greatest(p_size * 100, p_partkey % 3000 + 1) AS l, p_partkey % 9 * 200 AS m FROM part)")
def q_scaled_extent(spark, d):
    w, h, m = F.col("p_size").cast("long") * 100, F.col("p_partkey") % 3000 + 1, F.col("p_partkey") % 9 * 200
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), px.scaled(w, F.greatest(w, h), m).alias("width"), px.scaled(h, F.greatest(w, h), m).alias("height"))


# luma and chroma

YCC = RGB + """, b8 AS (SELECT frame_id, y, x, r >> 8 AS r, g >> 8 AS g, b >> 8 AS b FROM rgb),
ycc AS (SELECT frame_id, y, x, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS luma, (-11059 * r - 21709 * g + 32768 * b + 8421375) >> 16 AS cb, (32768 * r - 27439 * g - 5329 * b + 8421375) >> 16 AS cr FROM b8)"""


def ycc(spark, d) -> DataFrame:
    b = with_rgb(triples(spark, d), [F.shiftright(c, 8) for c in rgb_columns()])
    return b.select("frame_id", "y", "x", *[px.weighed(*rgb_columns(), w).alias(n) for n, w in (("luma", px.LUMA), ("cb", px.CB), ("cr", px.CR))])


@query(f"WITH {YCC} SELECT * FROM ycc")
def q_luma_chroma(spark, d):
    return ycc(spark, d)


HALF = YCC + """, taps AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, cb, cr, CASE WHEN x = 20 THEN 2 ELSE 1 END AS w FROM ycc),
half AS (SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST((sum(cb * w) + 1 + x % 2)::BIGINT >> 2 AS INT) AS cb, CAST((sum(cr * w) + 1 + x % 2)::BIGINT >> 2 AS INT) AS cr FROM taps GROUP BY frame_id, y, x)"""


@query(f"WITH {HALF} SELECT * FROM half")
def q_chroma_subsample(spark, d):
    return stencil.halved_chroma(ycc(spark, d), WIDTH // 3, HEIGHT)


@query(f"WITH {HALF} SELECT 'y' AS plane, frame_id, y, x, luma AS v FROM ycc UNION ALL SELECT 'cb', frame_id, y, x, cb FROM half UNION ALL SELECT 'cr', frame_id, y, x, cr FROM half")
def q_yuv_planes(spark, d):
    full, half = ycc(spark, d), q_chroma_subsample(spark, d)
    plane = lambda df, name, c: df.select(F.lit(name).alias("plane"), "frame_id", "y", "x", F.col(c).alias("v"))
    return plane(full, "y", "luma").unionByName(plane(half, "cb", "cb")).unionByName(plane(half, "cr", "cr"))


_B = "greatest(0, least(255, {}))"


@query(
    f"""WITH {HALF}, j AS (SELECT c.frame_id, c.y, c.x, luma, h.cb - 128 AS u, h.cr - 128 AS w FROM ycc c JOIN half h ON c.frame_id = h.frame_id AND c.y // 2 = h.y AND c.x // 2 = h.x)
SELECT frame_id, y, x, {_B.format('luma + ((w * 91881 + 32768) >> 16)')} AS r, {_B.format('luma + ((u * -22554 + w * -46802 + 32768) >> 16)')} AS g, {_B.format('luma + ((u * 116130 + 32768) >> 16)')} AS b FROM j"""
)
def q_yuv_to_rgba(spark, d):
    half = q_chroma_subsample(spark, d).select(F.col("frame_id").alias("f"), F.col("y").alias("hy"), F.col("x").alias("hx"), "cb", "cr")
    full = ycc(spark, d).drop("cb", "cr")
    both = full.join(half, (F.col("frame_id") == F.col("f")) & (F.shiftright("y", 1) == F.col("hy")) & (F.shiftright("x", 1) == F.col("hx")))
    return with_rgb(both, px.from_ycc(F.col("luma"), F.col("cb"), F.col("cr")))


@query(
    f"WITH {BYTES}, yc AS (SELECT frame_id, y, x, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS luma, (-11059 * r - 21709 * g + 32768 * b + 8421375) >> 16 AS cb, (32768 * r - 27439 * g - 5329 * b + 8421375) >> 16 AS cr FROM bytes) SELECT frame_id, CAST(sum(luma) AS BIGINT) AS luma, CAST(sum(cb) AS BIGINT) AS cb, CAST(sum(cr) AS BIGINT) AS cr FROM yc GROUP BY frame_id"
)
def q_render_yuv420(spark, d):
    bytes_ = stages(unit(spark, d))
    full = bytes_.select("frame_id", *[px.weighed(*rgb_columns(), w).alias(n) for n, w in (("luma", px.LUMA), ("cb", px.CB), ("cr", px.CR))])
    return full.groupBy("frame_id").agg(*[F.sum(c).alias(c) for c in ("luma", "cb", "cr")])


# stencils


@query(
    "WITH c AS (SELECT CAST(i AS INT) AS c, CAST(n AS INT) AS n, CAST(r AS INT) AS r FROM range(-8, 20) a(i), (VALUES (8), (12)) b(n), (VALUES (2), (6)) e(r)) SELECT c, n, r, CASE WHEN c < 0 THEN ((c % r) + r) % r WHEN c >= n THEN (n - r) + (c - (n - r)) % r ELSE c END AS w FROM c"
)
def q_repeat_wrap(spark, d):
    c = spark.range(-8, 20).select(F.col("id").cast("int").alias("c"), F.explode(F.lit([8, 12])).alias("n")).select("c", "n", F.explode(F.lit([2, 6])).alias("r"))
    w2, w6 = stencil.wrapped(F.col("c"), F.col("n"), 2), stencil.wrapped(F.col("c"), F.col("n"), 6)
    return c.select("c", "n", "r", F.when(F.col("r") == 2, w2).otherwise(w6).alias("w"))


def _wrap(c: str, n: int, r: int) -> str:
    return f"(CASE WHEN {c} < 0 THEN (({c}) % {r} + {r}) % {r} WHEN {c} >= {n} THEN {n - r} + ({c} - {n - r}) % {r} ELSE {c} END)"


TAPS = f"""taps AS (SELECT a.frame_id, a.y, a.x, dy, dx, b.v FROM cfa a, range(-1, 2) t(dy), range(-1, 2) u(dx), cfa b
  WHERE b.frame_id = a.frame_id AND b.y = {_wrap('(a.y + dy)', HEIGHT, 2)} AND b.x = {_wrap('(a.x + dx)', WIDTH, 2)})"""
_NORMAL = f", cfa AS (SELECT frame_id, y, x, CAST(trunc({_F32}) AS INT) AS v FROM px)"
_SUM = "CAST(sum(v) FILTER ({}) AS INT)"
BAYER = PX + _NORMAL + ", " + TAPS + f""", sums AS (SELECT frame_id, y, x, {_SUM.format('dy = 0 AND dx = 0')} AS c, {_SUM.format('dy = 0 AND dx <> 0')} AS hor, {_SUM.format('dx = 0 AND dy <> 0')} AS ver,
  {_SUM.format('abs(dx) + abs(dy) = 1')} AS cross4, {_SUM.format('dx <> 0 AND dy <> 0')} AS diag FROM taps GROUP BY 1, 2, 3),
dem AS (SELECT frame_id, y, x, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN c WHEN y % 2 = 0 THEN (hor + 1) >> 1 WHEN x % 2 = 0 THEN (ver + 1) >> 1 ELSE (diag + 2) >> 2 END AS r,
  CASE WHEN y % 2 = x % 2 THEN (cross4 + 2) >> 2 ELSE c END AS g, CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN c WHEN y % 2 = 1 THEN (hor + 1) >> 1 WHEN x % 2 = 1 THEN (ver + 1) >> 1 ELSE (diag + 2) >> 2 END AS b FROM sums)"""


def demosaiced(spark, d) -> DataFrame:
    return stencil.bayer_bilinear(stencil.scan_lines(normalised_mosaic(spark, d)), height=HEIGHT)


@query(f"WITH {BAYER} SELECT * FROM dem")
def q_bayer_bilinear(spark, d):
    return demosaiced(spark, d)


_SITES = "[" + ", ".join(map(str, SIX_BY_SIX)) + "]"


SIX_SQL = (
    f"""{PX}, taps AS (SELECT a.frame_id, a.y, a.x, a.v AS own, b.v, 1.0::DOUBLE / (1 + dx * dx + dy * dy) AS w,
{_SITES}[CAST(((a.y + dy) % 6 + 6) % 6 * 6 + ((a.x + dx) % 6 + 6) % 6 + 1 AS INT)] AS site, {_SITES}[CAST(a.y % 6 * 6 + a.x % 6 + 1 AS INT)] AS here
FROM px a, range(-2, 3) t(dy), range(-2, 3) u(dx), px b WHERE b.frame_id = a.frame_id AND b.y = {_wrap('(a.y + dy)', HEIGHT, 6)} AND b.x = {_wrap('(a.x + dx)', WIDTH, 6)}),
s AS (SELECT frame_id, y, x, any_value(own) AS own, any_value(here) AS here, sum(w * v) FILTER (site = 0) AS tr, sum(w) FILTER (site = 0) AS wr, sum(w * v) FILTER (site = 1) AS tg, sum(w) FILTER (site = 1) AS wg, sum(w * v) FILTER (site = 2) AS tb, sum(w) FILTER (site = 2) AS wb FROM taps GROUP BY 1, 2, 3),
six AS (SELECT frame_id, y, x, """
    + ", ".join(f"CASE WHEN here = {k} THEN own ELSE CAST(floor(round(coalesce(t{c}, 0) / greatest(coalesce(w{c}, 0), 0.000001), 6) + 0.5) AS INT) END AS {c}" for k, c in enumerate("rgb"))
    + " FROM s)"
)


@query(f"WITH {SIX_SQL} SELECT * FROM six")
def q_xtrans_demosaic(spark, d):
    return stencil.mosaic_average(stencil.scan_lines(pixels(spark, d)), SIX_BY_SIX, HEIGHT)


def _warp_places(spark, d) -> DataFrame:
    sx, sy = stencil.warp_source(F.col("x").cast("double"), F.col("y").cast("double"), WIDTH, HEIGHT, RADIAL, TANGENTIAL)
    return pixels(spark, d).select("frame_id", "y", "x", sx.alias("sx"), sy.alias("sy"))


_CX, _CY = (WIDTH - 1) / 2, (HEIGHT - 1) / 2
_RADIUS = (_CX * _CX + _CY * _CY) ** 0.5
WARP = f"""{PX}, n AS (SELECT frame_id, y, x, (x - {_CX}::DOUBLE) / {_RADIUS!r}::DOUBLE AS nx, (y - {_CY}::DOUBLE) / {_RADIUS!r}::DOUBLE AS ny FROM px),
rr AS (SELECT *, least(nx * nx + ny * ny, 1.0::DOUBLE) AS rr FROM n),
place AS (SELECT frame_id, y, x, {_CX}::DOUBLE + {_RADIUS!r}::DOUBLE * (nx * ratio + (-0.0005::DOUBLE * (rr + 2 * nx * nx) + 2 * 0.001::DOUBLE * nx * ny)) AS sx,
  {_CY}::DOUBLE + {_RADIUS!r}::DOUBLE * (ny * ratio + (0.001::DOUBLE * (rr + 2 * ny * ny) + 2 * (-0.0005::DOUBLE) * nx * ny)) AS sy
  FROM (SELECT *, 1.0::DOUBLE + rr * (-0.05::DOUBLE + rr * (0.02::DOUBLE + rr * (-0.005::DOUBLE))) AS ratio FROM rr)),
bounds AS (SELECT frame_id, y // 25 AS ty, x // 32 AS tx, min(floor(sx)) FILTER (x % 32 = 0) - 2 AS x_lo, max(ceil(sx)) FILTER (x % 32 = 31) - 2 AS x_hi,
  min(floor(sy)) FILTER (y % 25 = 0) - 2 AS y_lo, max(ceil(sy)) FILTER (y % 25 = 24) - 2 AS y_hi FROM place GROUP BY 1, 2, 3)"""


@query(f"WITH {WARP} SELECT * FROM place")
def q_warp_coords(spark, d):
    return _warp_places(spark, d)


@query(f"WITH {WARP} SELECT frame_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, CAST(x_lo AS BIGINT) AS x_lo, CAST(x_hi AS BIGINT) AS x_hi, CAST(y_lo AS BIGINT) AS y_lo, CAST(y_hi AS BIGINT) AS y_hi FROM bounds")
def q_warp_tile_bounds(spark, d):
    return stencil.tile_bounds(_warp_places(spark, d), stencil.tile_side(WIDTH, 32), stencil.tile_side(HEIGHT, 32), WIDTH, HEIGHT)


_CUBIC = "(CASE WHEN abs({d}) >= 2 THEN 0.0 WHEN abs({d}) >= 1 THEN ((-0.75::DOUBLE * abs({d}) + 3.75::DOUBLE) * abs({d}) - 6.0::DOUBLE) * abs({d}) + 3.0::DOUBLE ELSE (1.25::DOUBLE * abs({d}) - 2.25::DOUBLE) * abs({d}) * abs({d}) + 1.0::DOUBLE END)"


_SUMMED = "CAST(floor(greatest(0.0, least(65535.0, round(sum(wx * wy * v) / sum(wx * wy), 6) + 0.5))) AS INT) AS v"


def _bicubic(source: str, value: str) -> str:
    return WARP + f""", base AS (SELECT p.frame_id, p.y, p.x, floor(sx) - 1 AS rx, floor(sy) - 1 AS ry, least(31, floor((sx - floor(sx)) * 32)) / 32.0::DOUBLE AS px_, least(31, floor((sy - floor(sy)) * 32)) / 32.0::DOUBLE AS py_, x_lo, x_hi, y_lo, y_hi
  FROM place p JOIN bounds b ON p.frame_id = b.frame_id AND p.y // 25 = b.ty AND p.x // 32 = b.tx),
fit AS (SELECT frame_id, y, x, greatest(x_lo, least(x_hi, rx)) AS bx, greatest(y_lo, least(y_hi, ry)) AS by_, CASE WHEN rx BETWEEN x_lo AND x_hi THEN px_ ELSE 0.0 END AS fx, CASE WHEN ry BETWEEN y_lo AND y_hi THEN py_ ELSE 0.0 END AS fy FROM base),
tap AS (SELECT f.frame_id, f.y, f.x, {_CUBIC.format(d='(i - 1 - fx)')} AS wx, {_CUBIC.format(d='(j - 1 - fy)')} AS wy, s.{value} AS v FROM fit f, range(0, 4) a(i), range(0, 4) b(j), {source} s
  WHERE s.frame_id = f.frame_id AND s.x = greatest(0, least({WIDTH - 1}, bx + i)) AND s.y = greatest(0, least({HEIGHT - 1}, by_ + j))),
warped AS (SELECT frame_id, y, x, {_SUMMED} FROM tap GROUP BY 1, 2, 3)"""


@query(f"WITH {_bicubic('px', 'v')} SELECT * FROM warped")
def q_warp_bicubic(spark, d):
    return warp.pixels_of(warped(warp.plane_lines(pixels(spark, d), ["v"]), ["v"]), ["v"])


GEOMETRY = warp.Geometry(WIDTH, HEIGHT, stencil.tile_side(WIDTH, 32), stencil.tile_side(HEIGHT, 32), lost=65535)  # as in the SQL


def warped(lines: DataFrame, planes: list[str]) -> DataFrame:
    return warp.warp_lines(lines, planes, [*RADIAL, *TANGENTIAL], GEOMETRY)


@query(f"WITH {_bicubic('dem', 'g').replace(PX, BAYER, 1)} SELECT * FROM warped")
def q_demosaic_warp(spark, d):
    """Green of the demosaiced frames, warped: two operators in a row, without a step between them."""
    return warp.pixels_of(warped(warp.plane_lines(demosaiced(spark, d), ["g"]), ["g"]), ["g"]).withColumnRenamed("g", "v")


@query(f"WITH {_bicubic('dem', 'r, s.g, s.b').replace(PX, BAYER, 1).replace('AS v FROM fit f', 'AS b FROM fit f').replace(_SUMMED, ', '.join(_SUMMED.replace('* v)', f'* {c})').replace('AS v', f'AS {c}') for c in 'rgb'))} SELECT * FROM warped")
def q_demosaic_warp_rgb(spark, d):
    """All three planes of the demosaiced frames, warped from one band of lines."""
    return warp.pixels_of(warped(warp.plane_lines(demosaiced(spark, d), ["r", "g", "b"]), ["r", "g", "b"]), ["r", "g", "b"])


@query(f"WITH {BAYER} SELECT frame_id, y - 5 AS y, x - 3 AS x, r, g, b FROM dem WHERE x BETWEEN 3 AND 42 AND y BETWEEN 5 AND 34")
def q_crop(spark, d):
    """The crop comes after the demosaicing, whose taps reach outside it."""
    inside = demosaiced(spark, d).where(F.col("x").between(3, 42) & F.col("y").between(5, 34))
    return inside.select("frame_id", (F.col("y") - 5).alias("y"), (F.col("x") - 3).alias("x"), "r", "g", "b")


# downscaling

_CELL = "CAST((({c} + 1) * {n} - 1) // {e} AS INT)"
CELLS = f", cells AS (SELECT frame_id, {_CELL.format(c='y', n=17, e=50)} AS y, {_CELL.format(c='x', n=10, e=21)} AS x, r, g, b FROM {{src}})"


@query(f"WITH {UNIT}{CELLS.format(src='unit')} SELECT frame_id, y, x, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM cells GROUP BY 1, 2, 3")
def q_box_downscale_pre(spark, d):
    """The mean of each cell before any colour arithmetic, not rounded to samples."""
    return _cells(unit(spark, d)).agg(*[F.round(F.avg(c), 9).alias(c) for c in "rgb"])


@query(f"WITH {BYTES}{CELLS.format(src='bytes')} SELECT frame_id, y, x, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g, CAST(floor(avg(b) + 0.5) AS INT) AS b FROM cells GROUP BY 1, 2, 3")
def q_box_downscale_post(spark, d):
    """The mean of each cell after the rendering, rounded half up."""
    return _cells(stages(unit(spark, d))).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgb"])


def _cells(df: DataFrame):
    return df.groupBy("frame_id", stencil.box_cell(F.col("y"), HEIGHT, 17).alias("y"), stencil.box_cell(F.col("x"), WIDTH // 3, 10).alias("x"))


# comparison

PAIRS = RGB + """, other AS (SELECT frame_id, y, x, r + (x * 7 + y * 13) % 3 AS r, g, b + CASE WHEN x = 4 AND y = 2 THEN 9 ELSE 0 END AS b FROM rgb),
pairs AS (SELECT a.frame_id, a.y, a.x, 0 AS ch, a.r AS a, o.r AS b FROM rgb a JOIN other o USING (frame_id, y, x) UNION ALL SELECT a.frame_id, a.y, a.x, 1, a.g, o.g FROM rgb a JOIN other o USING (frame_id, y, x)
  UNION ALL SELECT a.frame_id, a.y, a.x, 2, a.b, o.b FROM rgb a JOIN other o USING (frame_id, y, x)), diff AS (SELECT *, CAST(abs(a - b) AS DOUBLE) AS d FROM pairs)"""


def pairs(spark, d) -> DataFrame:
    a = triples(spark, d)
    b = a.select("frame_id", "y", "x", (F.col("r") + (F.col("x") * 7 + F.col("y") * 13) % 3).alias("r"), "g", (F.col("b") + F.when((F.col("x") == 4) & (F.col("y") == 2), 9).otherwise(0)).alias("b"))
    return metrics.paired(a, b)


_PSNR = "CASE WHEN {m} = 0 THEN 999.0 ELSE 10 * log10(65535.0 * 65535.0 / {m}) END"


@query(
    f"""WITH {PAIRS}, m AS (SELECT ch, avg(d * d) AS mse, avg(d) AS mae, max(d) AS max_abs, arg_max(y, (d, -frame_id, -y, -x)) AS at_y, arg_max(x, (d, -frame_id, -y, -x)) AS at_x FROM diff GROUP BY ch)
SELECT ch, mse, {_PSNR.format(m='mse')} AS psnr, mae, max_abs, at_y, at_x FROM m"""
)
def q_psnr(spark, d):
    return metrics.channel_psnr(pairs(spark, d), 65535.0)


@query(f"WITH {PAIRS} SELECT max(d) AS max_abs, avg(d) AS mean_abs, count(*) FILTER (d > 0) AS non_zero, {_PSNR.format(m='avg(d * d)')} AS psnr, quantile_cont(d, 0.999) AS p999 FROM diff")
def q_diff_stats(spark, d):
    return metrics.difference_stats(pairs(spark, d), 65535.0)


@query(f"WITH {PAIRS} SELECT frame_id, greatest(quantile_cont(d, 0.999), CASE WHEN quantile_cont(d, 0.999) = 0 THEN CASE WHEN max(d) = 0 THEN 1 ELSE max(d) END ELSE 0 END) AS vmax FROM diff GROUP BY frame_id")
def q_heatmap(spark, d):
    """The top of the scale of a difference map: the 99.9th percentile, else the maximum, else 1."""
    diff = F.abs(F.col("a") - F.col("b")).cast("double")
    s = pairs(spark, d).groupBy("frame_id").agg(F.percentile(diff, 0.999).alias("p"), F.max(diff).alias("m"))
    return s.select("frame_id", F.when(F.col("p") > 0, F.col("p")).when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("vmax"))


@query(f"WITH {PAIRS}, c AS (SELECT ch, count(*) FILTER (d > 0) AS mismatches, max(d) AS max_diff FROM diff GROUP BY ch) SELECT ch, mismatches, max_diff, (SELECT count(*) FROM rgb WHERE r = g) AS grey_left, (SELECT count(*) FROM other WHERE r = g) AS grey_right FROM c")
def q_channel_cmp(spark, d):
    p = pairs(spark, d)
    diff = F.abs(F.col("a") - F.col("b")).cast("double")
    per = p.groupBy("ch").agg(F.count_if(diff > 0).alias("mismatches"), F.max(diff).alias("max_diff"))
    wide = p.groupBy("frame_id", "y", "x").agg(*[F.max(F.when(F.col("ch") == k, F.col(s))).alias(f"{s}{k}") for s in "ab" for k in (0, 1)])
    grey = wide.agg(F.count_if(F.col("a0") == F.col("a1")).alias("grey_left"), F.count_if(F.col("b0") == F.col("b1")).alias("grey_right"))
    return per.join(F.broadcast(grey))


@query(f"WITH {PAIRS} SELECT frame_id, avg(d) AS mae, avg(d) <= 65535 * 2.0 / 255 AS pass FROM diff GROUP BY frame_id")
def q_mae(spark, d):
    diff = F.abs(F.col("a") - F.col("b")).cast("double")
    return pairs(spark, d).groupBy("frame_id").agg(F.avg(diff).alias("mae"), (F.avg(diff) <= 65535 * 2.0 / 255).alias("pass"))


@query(f"WITH {PAIRS} SELECT count(*) AS samples, count(*) FILTER (d = 0) AS same FROM diff")
def q_frame_compare(spark, d):
    return pairs(spark, d).agg(F.count("*").alias("samples"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


_HASH = "l AS (SELECT frame_id, y, sha256(string_agg(CAST(v AS VARCHAR), ';' ORDER BY x)) AS h FROM px GROUP BY 1, 2), f AS (SELECT frame_id, sha256(string_agg(h, '' ORDER BY y)) AS sha256 FROM l GROUP BY 1)"


@query(f"WITH {PX}, {_HASH} SELECT * FROM f")
def q_frame_hash(spark, d):
    return metrics.frame_hash(pixels(spark, d), ["v"])


@query(f"WITH {PX}, {_HASH} SELECT frame_id, CASE WHEN frame_id % 4 = 3 THEN 'NO' ELSE 'YES' END AS same FROM f WHERE frame_id % 5 < 4")
def q_baseline_join(spark, d):
    """Hashes of frames against a baseline, of which every fourth frame was changed."""
    p = pixels(spark, d)
    base = metrics.frame_hash(p, ["v"]).withColumnRenamed("sha256", "baseline")
    made = metrics.frame_hash(p.withColumn("v", F.when((F.col("frame_id") % 4 == 3) & (F.col("x") == 0), F.col("v") + 1).otherwise(F.col("v"))).where("frame_id % 5 < 4"), ["v"])
    return made.join(base, "frame_id", "left").select("frame_id", F.when(F.col("sha256") == F.col("baseline"), "YES").otherwise("NO").alias("same"))


@query(f"WITH {PX} SELECT frame_id, count(DISTINCT v) AS kinds, count(*) = 3200 AND count(DISTINCT v) >= 8 AS pass FROM px GROUP BY frame_id")
def q_nondegenerate(spark, d):
    return pixels(spark, d).groupBy("frame_id").agg(F.countDistinct("v").alias("kinds"), ((F.count("*") == WIDTH * HEIGHT) & (F.countDistinct("v") >= 8)).alias("pass"))


# auto exposure

SAMPLES = PX + ", smp AS (SELECT CASE WHEN (y // 4) % 2 = 0 AND (x // 4) % 2 = 0 THEN 0 WHEN (y // 4) % 2 = 1 AND (x // 4) % 2 = 1 THEN 2 ELSE 1 END AS ch, frame_id % 5 AS grp, v FROM px WHERE y % 2 = 0 AND x % 2 = 0)"


def _samples(spark, d) -> DataFrame:
    a, b = F.floor(F.col("y") / 4) % 2, F.floor(F.col("x") / 4) % 2
    ch = F.when((a == 0) & (b == 0), 0).when((a == 1) & (b == 1), 2).otherwise(1)
    return pixels(spark, d).where("y % 2 = 0 AND x % 2 = 0").select(ch.alias("ch"), (F.col("frame_id") % 5).alias("grp"), "v")


QUANT = SAMPLES + ", o AS (SELECT grp, ch, v, row_number() OVER (PARTITION BY grp, ch ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY grp, ch) AS n FROM smp), q AS (SELECT grp, ch, n, v AS q FROM o WHERE i = greatest(0, least(n - 1, floor(n * 0.99::DOUBLE))))"


@query(f"WITH {QUANT} SELECT grp, ch, n, q, CAST(greatest(0.0::FLOAT, (q::FLOAT - 512::FLOAT) / (60000::FLOAT - 512::FLOAT)) AS DOUBLE) AS h FROM q")
def q_ae_histogram(spark, d):
    q = metrics.class_quantile(_samples(spark, d), ["grp", "ch"], "v", 0.99)
    return q.withColumn("h", F.greatest(F.lit(0.0).cast("float"), (F.col("q").cast("float") - F.lit(512.0).cast("float")) / F.lit(60000.0 - 512.0).cast("float")).cast("double"))


@query(f"WITH {RGB}, f AS (SELECT frame_id, 0 AS ch, r AS v FROM rgb UNION ALL SELECT frame_id, 1, g FROM rgb UNION ALL SELECT frame_id, 2, b FROM rgb), o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, ch ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame_id, ch) AS n FROM f) SELECT frame_id, ch, n, v AS q FROM o WHERE i = floor(n * 0.99::DOUBLE)")
def q_ae_nth(spark, d):
    long = triples(spark, d).select("frame_id", F.posexplode(F.array("r", "g", "b")).alias("ch", "v"))
    return metrics.class_quantile(long, ["frame_id", "ch"], "v", 0.99)


@query(f"WITH {SAMPLES}, c AS (SELECT ch, v, count(*) AS n FROM smp GROUP BY 1, 2) SELECT ch, v, CAST(sum(n) OVER (PARTITION BY ch ORDER BY v) AS BIGINT) AS upto FROM c")
def q_cumulative_hist(spark, d):
    counts = _samples(spark, d).groupBy("ch", "v").agg(F.count("*").alias("n"))
    return counts.select("ch", "v", F.sum("n").over(Window.partitionBy("ch").orderBy("v")).alias("upto"))


SOLVE = QUANT + """, h AS (SELECT grp, max(q) / 65535.0::DOUBLE * (0.2 + 0.2 * grp)::DOUBLE AS h, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY grp),
b AS (SELECT grp, h, n, CASE WHEN sqrt(h) >= 1 THEN 0.0 WHEN sqrt(h * 4) < 1 THEN 2.0 ELSE log2(1 / h) END AS ev FROM h)"""


@query(f"WITH {SOLVE} SELECT grp, CASE WHEN n < 200 THEN 'too few samples' WHEN h <= 0 THEN 'degenerate' ELSE 'ok' END AS status, round(CASE WHEN n < 200 OR h <= 0 THEN 0 ELSE ev END, 6) AS ev FROM b")
def q_ae_solve(spark, d):
    """The exposure at which the brightest channel's 99th percentile reaches white, by bisection in the plan."""
    q = metrics.class_quantile(_samples(spark, d), ["grp", "ch"], "v", 0.99)
    h = q.groupBy("grp").agg((F.max("q") / 65535.0 * (0.2 + 0.2 * F.col("grp"))).alias("h"), F.sum("n").alias("n"))
    ev = metrics.bisected(lambda e: F.sqrt(F.col("h") * F.pow(F.lit(2.0), e)), 0.0, 2.0)
    status = F.when(F.col("n") < 200, "too few samples").when(F.col("h") <= 0, "degenerate").otherwise("ok")
    return h.select("grp", status.alias("status"), F.round(F.when(status == "ok", ev).otherwise(0.0), 6).alias("ev"))


@query("SELECT grp, h_bits FROM (SELECT l_orderkey % 10 AS grp, count(DISTINCT CAST(l_discount AS FLOAT)) AS h_bits FROM lineitem GROUP BY 1)")
def q_ev_bits(spark, d):
    """Values are told apart by their binary32 bits, never by decimal text."""
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 10).alias("grp")).agg(F.countDistinct(F.col("l_discount").cast("float")).alias("h_bits"))


# the whole decode


FULL = BAYER + ", unit AS (SELECT frame_id, y, x, r / 65535.0::DOUBLE AS r, g / 65535.0::DOUBLE AS g, b / 65535.0::DOUBLE AS b FROM dem)" + BYTES[len(UNIT):]


@query(f"WITH {FULL}, o AS (SELECT frame_id, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS luma FROM bytes WHERE x BETWEEN 2 AND 61 AND y BETWEEN 2 AND 47) SELECT frame_id, count(*) AS pixels, CAST(sum(luma) AS BIGINT) AS luma_sum, min(luma) AS luma_min, max(luma) AS luma_max FROM o GROUP BY frame_id")
def q_decode_full(spark, d):
    """Mosaic to picture: normalise, demosaic, render, crop, turn by 180 degrees, luma; summed up by frame."""
    linear = demosaiced(spark, d).select("frame_id", "y", "x", *[(F.col(c) / 65535.0).alias(c) for c in "rgb"])
    x, y = px.oriented(F.col("x"), F.col("y"), WIDTH, HEIGHT, 3)
    shown = stages(linear).where(F.col("x").between(2, 61) & F.col("y").between(2, 47)).select("frame_id", y.alias("y"), x.alias("x"), px.weighed(*rgb_columns(), px.LUMA).alias("luma"))
    return shown.groupBy("frame_id").agg(F.count("*").alias("pixels"), F.sum("luma").alias("luma_sum"), F.min("luma").alias("luma_min"), F.max("luma").alias("luma_max"))
