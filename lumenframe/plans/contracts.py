"""Queries over frame descriptions: layouts, contracts and derived metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..operators import contracts
from ..sources.fixtures import table
from .images import SIX_BY_SIX
from .registry import query

_TILE = "[" + ", ".join(map(str, SIX_BY_SIX)) + "]"
LAYOUT = f"""lay AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 3 THEN 'rgb' WHEN 4 THEN 'mono' ELSE 'cfa' END AS model, CASE WHEN p_partkey % 5 = 1 THEN 6 ELSE 2 END AS side,
  CASE WHEN p_partkey % 5 IN (3, 4) THEN NULL WHEN p_partkey % 5 = 1 THEN list_transform(range(36), lambda i: CASE WHEN p_size % 10 = 0 AND i = 0 THEN 2 ELSE {_TILE}[CAST((i // 6 + p_size) % 6 * 6 + (i % 6 + p_size % 7) % 6 + 1 AS INT)] END)
    ELSE CASE p_partkey % 4 WHEN 0 THEN [0, 1, 1, 2] WHEN 1 THEN [1, 0, 2, 1] WHEN 2 THEN [2, 1, 1, 0] ELSE CASE WHEN p_size % 3 = 0 THEN [0, 1, 2, 2] WHEN p_size % 3 = 1 THEN [0, 1, 9, 2] ELSE [1, 2, 0, 1] END END END AS pattern FROM part)"""


def layouts(spark, d) -> DataFrame:
    kind, size = F.col("p_partkey") % 5, F.col("p_size")
    six = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.when((size % 10 == 0) & (i == 0), 2).otherwise(F.get(F.lit(SIX_BY_SIX), (F.pmod(F.floor(i / 6) + size, F.lit(6)) * 6 + F.pmod(i % 6 + size % 7, F.lit(6))).cast("int"))))
    odd = F.when(size % 3 == 0, F.lit([0, 1, 2, 2])).when(size % 3 == 1, F.lit([0, 1, 9, 2])).otherwise(F.lit([1, 2, 0, 1]))
    two = F.when(F.col("p_partkey") % 4 == 0, F.lit([0, 1, 1, 2])).when(F.col("p_partkey") % 4 == 1, F.lit([1, 0, 2, 1])).when(F.col("p_partkey") % 4 == 2, F.lit([2, 1, 1, 0])).otherwise(odd)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("k"),
        F.when(kind == 3, "rgb").when(kind == 4, "mono").otherwise("cfa").alias("model"),
        F.when(kind == 1, 6).otherwise(2).alias("side"),
        F.when(kind.isin(3, 4), F.lit(None)).when(kind == 1, six).otherwise(two).alias("pattern"),
    )


_CANON = f"list_contains(list_transform(range(36), lambda s: list_transform(range(36), lambda i: {_TILE}[CAST((i // 6 + s // 6) % 6 * 6 + (i % 6 + s % 6) % 6 + 1 AS INT)])), pattern)"
CLASSED = LAYOUT + f""", cls AS (SELECT k, pattern, CASE model WHEN 'rgb' THEN 'linear_rgb' WHEN 'mono' THEN 'monochrome' ELSE CASE WHEN list_contains(pattern, 9) THEN 'invalid'
  WHEN side = 2 AND len(list_filter(pattern, lambda v: v = 0)) = 1 AND len(list_filter(pattern, lambda v: v = 2)) = 1 AND len(list_filter(pattern, lambda v: v = 1)) = 2 THEN 'bayer'
  WHEN side = 6 AND len(list_filter(pattern, lambda v: v = 1)) = 20 AND len(list_filter(pattern, lambda v: v = 0)) = 8 AND {_CANON} THEN 'xtrans' ELSE 'other_cfa' END END AS layout FROM lay)"""


def classed(spark, d) -> DataFrame:
    layout = contracts.layout_class(F.col("model"), F.col("side"), F.col("side"), F.col("pattern"), SIX_BY_SIX)
    return layouts(spark, d).withColumn("layout", layout)


@query(f"WITH {CLASSED} SELECT k, layout FROM cls")
def q_classify_layout(spark, d):
    return classed(spark, d).select("k", "layout")


@query(f"WITH {LAYOUT} SELECT k, {_CANON} AS canonical FROM lay WHERE side = 6")
def q_xtrans_canonical(spark, d):
    return layouts(spark, d).where("side = 6").select("k", contracts.is_shift_of(F.col("pattern"), SIX_BY_SIX).alias("canonical"))


@query(f"WITH {CLASSED} SELECT layout, count(*) AS n, layout IN ('bayer', 'xtrans', 'linear_rgb') AS production FROM cls GROUP BY layout")
def q_is_production(spark, d):
    return classed(spark, d).groupBy("layout").agg(F.count("*").alias("n")).withColumn("production", F.col("layout").isin(contracts.PRODUCTION))


@query(f"WITH {CLASSED} SELECT k, CASE list_position(pattern, 0) WHEN 1 THEN '00' WHEN 2 THEN '01' WHEN 3 THEN '10' ELSE '11' END AS phase FROM cls WHERE layout = 'bayer'")
def q_bayer_phase(spark, d):
    return classed(spark, d).where("layout = 'bayer'").select("k", contracts.red_phase(F.col("pattern")).alias("phase"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'GRBG' WHEN 2 THEN 'GBRG' ELSE 'BGGR' END AS phase, CASE p_partkey % 4 WHEN 0 THEN '0112' WHEN 1 THEN '1021' WHEN 2 THEN '1201' ELSE '2110' END AS sites FROM part")
def q_cfa_expand(spark, d):
    names = list(contracts.PHASES)
    phase = F.get(F.lit(names), (F.col("p_partkey") % 4).cast("int"))
    sites = F.get(F.lit(["".join(map(str, contracts.PHASES[n])) for n in names]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), phase.alias("phase"), sites.alias("sites"))


FRAME = CLASSED + """, fr AS (SELECT p.p_partkey AS k, CASE WHEN p_partkey % 41 = 0 THEN 2 ELSE 1 END AS planes, p_size * CASE WHEN p_partkey % 43 = 0 THEN 0 ELSE 100 END AS width, CAST(p_partkey % 4000 + 1 AS BIGINT) AS height,
  p_size * 200 - CASE WHEN p_partkey % 37 = 0 THEN 2 ELSE 0 END AS stride, layout, p_size * 20 AS black, 900 AS white, p_partkey % 6 <> 0 AS has_matrix FROM part p JOIN cls c ON c.k = p.p_partkey)"""


def described(spark, d) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").join(classed(spark, d), F.col("k") == key).select(
        "k",
        F.when(key % 41 == 0, 2).otherwise(1).alias("planes"),
        (size * F.when(key % 43 == 0, 0).otherwise(100)).alias("width"),
        (key % 4000 + 1).alias("height"),
        (size * 200 - F.when(key % 37 == 0, 2).otherwise(0)).alias("stride"),
        F.lit(2).alias("pixel_bytes"),
        (size.cast("long") * 200 * (key % 4000 + 1) - F.when(key % 31 == 0, 1000).otherwise(0)).alias("bytes"),
        F.when(key % 29 == 0, 5000).otherwise(0).alias("crop_x"),
        F.lit(0).alias("crop_y"),
        F.lit(50).alias("crop_w"),
        F.lit(1).alias("crop_h"),
        "layout",
        (size * 20).alias("black"),
        F.lit(900).alias("white"),
        (key % 6 != 0).alias("has_matrix"),
    )


_CHECKS = [
    ("k % 41 = 0", -202, "one plane is needed"),
    ("width <= 0 OR height <= 0", -203, "empty image"),
    ("width * height > 268435456", -203, "image above the ceiling"),
    ("stride < width * 2", -204, "row stride is too short"),
    ("width * 2 * height - CASE WHEN k % 31 = 0 THEN 1000 ELSE 0 END < (height - 1) * stride + width * 2", -204, "buffer ends before the last pixel"),
    ("CASE WHEN k % 29 = 0 THEN 5000 ELSE 0 END + 50 > width", -205, "crop is outside the image"),
    ("layout = 'invalid'", -206, "layout is invalid"),
    ("black >= white", -207, "black is not in [0, white)"),
    ("NOT has_matrix AND layout <> 'monochrome'", -208, "colour matrix is missing"),
    ("layout NOT IN ('bayer', 'xtrans', 'linear_rgb')", -209, "layout is not supported"),
]
_CODE = "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e, _ in _CHECKS) + " ELSE 0 END"
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in _CHECKS) + " END"


@query(f"WITH {FRAME} SELECT k, {_CODE} AS error_code, {_REASON} AS reason FROM fr")
def q_validate_input(spark, d):
    return contracts.frames_judged(described(spark, d)).select("k", "error_code", "reason")


@query(f"WITH {FRAME}, j AS (SELECT layout, {_CODE} AS error_code FROM fr) SELECT layout, count(*) AS frames, count(*) FILTER (error_code = 0) AS usable FROM j GROUP BY layout")
def q_adapter_build(spark, d):
    """Classification, metadata and contract in one plan: how many frames of each layout can be decoded."""
    return contracts.frames_judged(described(spark, d)).groupBy("layout").agg(F.count("*").alias("frames"), F.count_if(F.col("error_code") == 0).alias("usable"))


@query(f"WITH {FRAME} SELECT k, width, height FROM fr")
def q_open_meta(spark, d):
    """Sizes from the descriptions only; no samples are read."""
    return described(spark, d).select("k", "width", "height")


@query(f"WITH {FRAME}, s AS (SELECT k, width AS w, height AS h, greatest(width, height) AS l FROM fr WHERE width > 0), t AS (SELECT k, CASE WHEN 512 >= l THEN w ELSE greatest(1, floor(w * (512 / l::DOUBLE) + 0.5)) END AS w, CASE WHEN 512 >= l THEN h ELSE greatest(1, floor(h * (512 / l::DOUBLE) + 0.5)) END AS h FROM s) SELECT k, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(4 * w * h AS BIGINT) AS bytes FROM t")
def q_probe_size(spark, d):
    f = described(spark, d).where("width > 0")
    w, h = (px.scaled(F.col(c), F.greatest("width", "height"), F.lit(512)) for c in ("width", "height"))
    return f.select("k", w.alias("width"), h.alias("height")).withColumn("bytes", 4 * F.col("width") * F.col("height"))


@query("SELECT p_partkey AS k, p_size > 0 AND p_partkey % 50 + p_size <= 80 AND p_size * 2 <= 60 AS inside, p_size * 1000000::BIGINT * (p_partkey % 10) <= 268435456 AS below FROM part")
def q_rect_inside(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    inside = contracts.rect_inside(key % 50, size, size, size, F.lit(80), F.lit(60))
    return table(spark, d, "part").select(key.alias("k"), inside.alias("inside"), contracts.within_ceiling(size * 1000000, key % 10).alias("below"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS periodic FROM part")
def q_filters_periodic(spark, d):
    words = F.lit([0x94949494, 0x94949495, 0x61616161, 1])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), contracts.two_row_period(F.get(words, (F.col("p_partkey") % 4).cast("int"))).alias("periodic"))


@query("SELECT p_partkey AS k, CASE substr('RGBCMYWEX', CAST(p_partkey % 9 AS INT) + 1, 1) WHEN 'R' THEN 0 WHEN 'G' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'M' THEN 5 WHEN 'Y' THEN 6 WHEN 'W' THEN 7 WHEN 'E' THEN 8 ELSE 9 END AS key FROM part")
def q_color_key(spark, d):
    letter = F.substring(F.lit("RGBCMYWEX"), (F.col("p_partkey") % 9 + 1).cast("int"), F.lit(1))
    keys = F.create_map(*[F.lit(x) for kv in contracts.COLOUR_KEYS.items() for x in kv])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.coalesce(F.try_element_at(keys, letter), F.lit(contracts.UNKNOWN)).alias("key"))


@query(
    """WITH s AS (SELECT p_partkey AS k, p_size AS base, p_partkey % 3 AS mx, p_size % 3 AS my, i // 6 AS y, i % 6 AS x FROM part, range(36) t(i))
SELECT k, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(base + [10, 20, 30][[0, 1, 1, 2][CAST(y % 2 * 2 + x % 2 + 1 AS INT)] + 1] + [1, 2, 3, 4, 5, 6, 7, 8, 9][CAST((y + my) % 3 * 3 + (x + mx) % 3 + 1 AS INT)] AS INT) AS black FROM s"""
)
def q_black_merge(spark, d):
    merged = contracts.merged_black(F.col("p_size"), F.lit([10, 20, 30]), F.lit([0, 1, 1, 2]), F.lit(list(range(1, 10))), 2, 3, F.col("p_partkey") % 3, F.col("p_size") % 3)
    flat = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.posexplode(merged).alias("i", "black"))
    return flat.select("k", F.floor(F.col("i") / 6).cast("int").alias("y"), (F.col("i") % 6).cast("int").alias("x"), F.col("black").cast("int").alias("black"))


@query(
    """WITH w AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN [1.0, 1.0, 1.0] WHEN 1 THEN [p_size / 10.0, 1.0, 2.0] WHEN 2 THEN [2.0, 1.0, p_size / 5.0] ELSE [1.0, 1.0, 1.0] END AS m FROM part)
SELECT k, CAST(m[2] AS DOUBLE) / CAST(m[1] AS DOUBLE) AS red, CAST(m[2] AS DOUBLE) / CAST(m[3] AS DOUBLE) AS blue FROM w"""
)
def q_white_balance(spark, d):
    kind, size = F.col("p_partkey") % 4, F.col("p_size")
    shot = F.when(kind == 1, F.array(size / 10.0, F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    preset = F.when(kind == 2, F.array(F.lit(2.0), F.lit(1.0), size / 5.0))
    neutral = contracts.neutral_of(kind == 0, shot, preset)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), neutral.alias("n")).select("k", F.col("n")[0].alias("red"), F.col("n")[2].alias("blue"))


@query(
    """WITH m AS (SELECT p_partkey AS k, (p_size / 10.0 + 1)::DOUBLE AS a, 0.1::DOUBLE AS b, 0.2::DOUBLE AS c, 0.3::DOUBLE AS d, 1.5::DOUBLE AS e, (p_partkey % 7) / 10.0::DOUBLE AS f, 0.05::DOUBLE AS g, 0.1::DOUBLE AS h, 2.0::DOUBLE AS i FROM part),
t AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM m) SELECT k, round(det, 9) AS det, round((e * i - f * h) / det, 9) AS i00, round((a * i - c * g) / det, 9) AS i11, round((a * e - b * d) / det, 9) AS i22 FROM t"""
)
def q_camera_matrix(spark, d):
    m = [F.col("p_size") / 10.0 + 1, F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(1.5), (F.col("p_partkey") % 7) / 10.0, F.lit(0.05), F.lit(0.1), F.lit(2.0)]
    inverse, det = contracts.inverse3(m)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(det, 9).alias("det"), *[F.round(inverse[4 * j], 9).alias(f"i{j}{j}") for j in range(3)])


@query(
    """WITH r AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS has_mosaic, p_size % 2 AS filters, CAST(p_partkey % 4 AS INT) AS colours, p_partkey % 11 <> 0 AS ok FROM part),
m AS (SELECT *, has_mosaic AND NOT (filters = 0 AND colours <> 1) AND ok AS mosaic FROM r) SELECT k, CASE WHEN mosaic THEN 'mosaic' WHEN filters = 0 AND colours = 3 AND ok THEN 'colour3' ELSE 'unsupported' END AS kind FROM m"""
)
def q_layout_select(spark, d):
    key = F.col("p_partkey")
    kind = contracts.unpacked_layout(key % 2 == 0, F.col("p_size") % 2, key % 4, key % 11 != 0)
    return table(spark, d, "part").select(key.alias("k"), kind.alias("kind"))


@query("WITH c AS (SELECT s_suppkey AS k, i, CASE WHEN s_suppkey % 3 = 0 AND i = s_suppkey % 500 THEN i + 1 ELSE i END AS v FROM supplier, range(1000) t(i)) SELECT k, bool_or(v <> i) AS bent FROM c GROUP BY k")
def q_vendor_curve(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("i"))
    value = F.when((F.col("k") % 3 == 0) & (F.col("i") == F.col("k") % 500), F.col("i") + 1).otherwise(F.col("i"))
    return contracts.bends(c.withColumn("v", value), "k", "i", "v")


_ENC = [
    ("k % 19 = 0", -401, "no pixels"),
    ("k % 6 = 5", -402, "unknown format"),
    ("w > 65535", -403, "size out of range"),
    ("effort > 10", -404, "effort out of range"),
    ("NOT lossless AND (quality < 1 OR quality > 100)", -405, "quality out of range"),
    ("lossless AND k % 6 = 0", -406, "no lossless form of this format"),
    ("(k % 7 = 0) <> (k % 14 = 0)", -407, "metadata and length disagree"),
]


@query(
    "WITH r AS (SELECT p_partkey AS k, p_size * 1400 AS w, p_partkey % 12 AS effort, p_partkey % 110 AS quality, p_size % 5 = 0 AS lossless FROM part) SELECT k, CASE "
    + " ".join(f"WHEN {c} THEN {e}" for c, e, _ in _ENC) + " ELSE 0 END AS error_code, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in _ENC) + " END AS reason FROM r"
)
def q_encode_validate(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    fmt = F.get(F.lit([*contracts.ENCODE_FORMATS, "gif"]), (key % 6).cast("int"))
    r = table(spark, d, "part").select(key.alias("k"), (key % 19 != 0).alias("has_pixels"), fmt.alias("format"), (size * 1400).alias("width"), F.lit(10).alias("height"), (key % 12).alias("effort"), (key % 110).alias("quality"), (size % 5 == 0).alias("lossless"), F.when(key % 14 == 0, 9).otherwise(0).alias("metadata_length"), (key % 7 == 0).alias("has_metadata"))
    return contracts.encode_requests_judged(r).select("k", "error_code", "reason")


@query("SELECT p_partkey AS k, p_partkey % 6 <> 5 AND p_partkey % 6 <> 3 AS supported FROM part")
def q_encode_supports(spark, d):
    can = spark.createDataFrame([(f, f != "heic") for f in contracts.ENCODE_FORMATS], "format string, can boolean")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.get(F.lit([*contracts.ENCODE_FORMATS, "gif"]), (F.col("p_partkey") % 6).cast("int")).alias("format"))
    return asked.join(F.broadcast(can), "format", "left").select("k", F.coalesce("can", F.lit(False)).alias("supported"))


@query("WITH e AS (SELECT p_partkey AS k, p_size * 400::BIGINT AS w, p_partkey % 9000 + 1 AS h FROM part) SELECT k, 4 * w * h <= 1500000000 AS fits, CAST(greatest(1, floor(w * least(1, 2048 / greatest(w, h)::DOUBLE) + 0.5)) AS BIGINT) AS width, CAST(greatest(1, floor(h * least(1, 2048 / greatest(w, h)::DOUBLE) + 0.5)) AS BIGINT) AS height FROM e")
def q_heif_extent(spark, d):
    w, h = F.col("p_size").cast("long") * 400, F.col("p_partkey") % 9000 + 1
    side = lambda c: px.scaled(c, F.greatest(w, h), F.lit(2048))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), (4 * w * h <= 1500000000).alias("fits"), side(w).alias("width"), side(h).alias("height"))


@query(
    """WITH o AS (SELECT l_orderkey AS frame_id, l_linenumber * 100000 + l_partkey AS place, CASE l_partkey % 3 WHEN 0 THEN 'warp' WHEN 1 THEN 'polynomial' ELSE 'other' END AS handler FROM lineitem),
m AS (SELECT *, lag(handler) OVER (PARTITION BY frame_id ORDER BY place) AS before FROM o) SELECT frame_id, string_agg(handler, '>' ORDER BY place) AS plan FROM m WHERE before IS NULL OR before <> handler OR handler = 'warp' GROUP BY frame_id"""
)
def q_opcode3_apply(spark, d):
    opcode = F.get(F.lit([1, 8, 3]), (F.col("l_partkey") % 3).cast("int"))
    return contracts.opcode_order(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"), opcode.alias("opcode")))
