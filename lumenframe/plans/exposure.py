"""Queries of automatic exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exposure
from ..sources.fixtures import pixels
from . import images as im
from .registry import query

CHAIN = exposure.Chain(im.CAMERA_WHITE, im.CAMERA, im.FINAL)
#: 26 frames are sampled as one: a frame of 64 x 50 gives 208 samples at a stride of four, and 4096 are needed.
TOGETHER, BLACKS = 26, [512.0, 516.0, 524.0]
SITES = [0, 1, 1, 2]

# Sample classes by site of an RGGB mosaic; frames start their grid at different places, so that all colours are met.
STRIDED = (
    im.PX
    + f""", grid AS (SELECT frame_id // {TOGETHER} AS grp, y, x, CAST((y + frame_id % 2) AS INT) AS yy, CAST((x + frame_id // 2 % 2) AS INT) AS xx, v FROM px),
smp AS (SELECT grp, [0, 1, 1, 2][y % 2 * 2 + x % 2 + 1] AS ch, v FROM grid WHERE yy % 4 = 0 AND xx % 4 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY grp, ch ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY grp, ch) AS n FROM smp),
q AS (SELECT grp, ch, n, v AS q FROM o WHERE i = greatest(0, least(n - 1, floor(n * 0.99::DOUBLE)))),
hi AS (SELECT grp, CAST(sum(n) AS BIGINT) AS sampled, """
    + ", ".join(f"coalesce(max(greatest(0::FLOAT, (q::FLOAT - {b}::FLOAT) / ({im.WHITE}::FLOAT - {b}::FLOAT))) FILTER (ch = {k}), 0::FLOAT) AS h{k}" for k, b in enumerate(BLACKS))
    + " FROM q GROUP BY grp)"
)


def strided(spark, d):
    """Samples by group of frames. Frames start their grid at different places, so that all colours are met."""
    p = pixels(spark, d)
    moved = p.where(((F.col("y") + F.col("frame_id") % 2) % 4 == 0) & ((F.col("x") + F.expr("frame_id div 2") % 2) % 4 == 0))
    return exposure.samples(moved.withColumn("grp", F.expr(f"frame_id div {TOGETHER}")), "grp", SITES, 2, stride=1)


@query(f"WITH {STRIDED} SELECT grp, sampled, CAST(h0 AS DOUBLE) AS h0, CAST(h1 AS DOUBLE) AS h1, CAST(h2 AS DOUBLE) AS h2 FROM hi")
def q_ae_highlights(spark, d):
    """The exact 99th percentile of each colour class over a grid of every fourth line and column, in binary32."""
    h = exposure.highlights(strided(spark, d), "grp", BLACKS, float(im.WHITE))
    return h.select("grp", "sampled", *[F.col("h")[k].cast("double").alias(f"h{k}") for k in range(3)])


def _peak_sql(ev: str, h: list[str]) -> str:
    """Nested scalar subqueries, one for each step of the chain."""
    clip = ", ".join(f"least({c}, {w}::DOUBLE) AS {k}" for k, c, w in zip("rgb", h, im.CAMERA_WHITE, strict=True))
    rows = lambda m: ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (r * {a}::DOUBLE + g * ({b}::DOUBLE)) + b * ({c}::DOUBLE))) AS {k}" for k, (a, b, c) in zip("rgb", m, strict=True))
    white = f"pow(2.0::DOUBLE, -greatest(0.0::DOUBLE, {ev}))"
    black = f"least(0.005::DOUBLE, 0.99::DOUBLE * {white})"
    ramp = ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c} - {black}) / ({white} - {black}))) AS {c}" for c in "rgb")
    toned = ", ".join(f"CASE WHEN {c} = hi THEN th WHEN {c} = lo THEN tl ELSE tl + (th - tl) * ({c} - lo) / (hi - lo) END AS {c}" for c in "rgb")
    shown = "CAST(CAST(greatest(" + ", ".join(im._GAMMA.format(x=c) for c in "rgb") + ") AS FLOAT) AS DOUBLE)"
    tone = im._TONE
    return f"""(SELECT {shown} FROM (SELECT {rows(im.FINAL)} FROM (SELECT {toned} FROM (SELECT *, {tone.format(x='hi')} AS th, {tone.format(x='lo')} AS tl FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT {ramp} FROM (SELECT {rows(im.CAMERA)} FROM (SELECT {clip}))))))))"""


_H = [f"CAST(h{k} AS DOUBLE)" for k in range(3)]
SOLVED = (
    "RECURSIVE "
    + STRIDED
    + f""", fr AS (SELECT s.k, CASE WHEN s.k % 9 = 0 THEN 208 ELSE 4096 + s.k END AS sampled, h0 * s.f AS h0, h1 * s.f AS h1, h2 * s.f AS h2, s.k % 11 <> 0 AS layout_ok, s.k % 13 <> 0 AS has_chain, CASE WHEN s.k % 17 = 0 THEN 512.0 ELSE 60000.0 END::DOUBLE AS white
  FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 19 = 0 THEN 0::FLOAT ELSE (p_size / 50.0)::FLOAT END AS f FROM part) s, (SELECT * FROM hi WHERE grp = 0)),
ok AS (SELECT *, layout_ok AND sampled >= 4096 AND has_chain AND white > 524 AND greatest(h0, h1, h2) > 0 AS fine FROM fr),
ends AS (SELECT *, {_peak_sql('0.0::DOUBLE', _H)} AS f0, {_peak_sql('2.0::DOUBLE', _H)} AS f2 FROM ok),
half AS (SELECT k, h0, h1, h2, 0.0::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS step FROM ends WHERE fine AND f0 < 1 AND f2 >= 1
  UNION ALL SELECT k, h0, h1, h2, CASE WHEN f < 1 THEN mid ELSE lo END, CASE WHEN f < 1 THEN hi ELSE mid END, step + 1 FROM (SELECT *, (lo + hi) * 0.5 AS mid, {_peak_sql('((lo + hi) * 0.5)', _H)} AS f FROM half WHERE step < 30))
SELECT e.k, CASE WHEN NOT layout_ok THEN 'unsupported layout' WHEN sampled < 4096 THEN 'too few samples' WHEN NOT has_chain THEN 'no chain' WHEN white <= 524 OR NOT fine THEN 'degenerate' ELSE 'ok' END AS status,
  CASE WHEN NOT layout_ok THEN 'site table is missing or out of range' WHEN sampled < 4096 THEN 'fewer than 4096 samples' WHEN NOT has_chain THEN 'no rendering chain' WHEN white <= 524 THEN 'white is not above black'
    WHEN NOT fine THEN 'no highlight above zero' WHEN f0 >= 1 THEN 'already at white, no gain' END AS reason,
  round(CASE WHEN NOT fine OR f0 >= 1 THEN 0.0 WHEN f2 < 1 THEN 2.0 ELSE (lo + hi) * 0.5 END, 6) AS ev
FROM ends e LEFT JOIN (SELECT * FROM half WHERE step = 30) s ON s.k = e.k"""
)


@query(f"WITH {SOLVED}")
def q_ae_solve_rendered(spark, d):
    """The first group's highlights, dimmed in many ways by the frame descriptions, each solved through the whole chain."""
    h = exposure.highlights(strided(spark, d), "grp", BLACKS, float(im.WHITE)).where("grp = 0").select("h").scalar()  # one row
    k = F.col("p_partkey")
    dim = F.when(k % 19 == 0, F.lit(0.0).cast("float")).otherwise((F.col("p_size") / 50.0).cast("float"))
    frames = im.table(spark, d, "part").withColumn("h", h).select(
        k.alias("k"),
        (k % 11 != 0).alias("layout_ok"),
        F.when(k % 9 == 0, 208).otherwise(4096 + k).alias("sampled"),
        F.transform("h", lambda v: (v * dim).cast("float")).alias("h"),
        (k % 13 != 0).alias("has_chain"),
        F.lit(max(BLACKS)).alias("black"),
        F.when(k % 17 == 0, 512.0).otherwise(60000.0).alias("white"),
    )
    return exposure.solved(frames, CHAIN).select("k", "status", "reason", F.round("ev", 6).alias("ev"))
