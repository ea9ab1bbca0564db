"""Automatic exposure: highlight quantiles of strided samples by colour site, and the exposure at which the rendered highlight is white.

A frame's three quantiles are all that is rendered: root finding runs inside its row, 30 halvings folded by `aggregate`
over the real rendering chain (white clip, camera matrix, exposure ramp, tone, output matrix, gamma), whose curves depend on
the exposure that is sought. Frames that can't be solved come out as rows that say why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as px
from . import metrics

LEAST_SAMPLES, MOST_EV, STEPS = 4096, 2.0, 30


@dataclass(frozen=True)
class Chain:
    """camera_white, camera (to working space) and final (to output space) of a rendering."""

    camera_white: list[float]
    camera: list[list[float]]
    final: list[list[float]]


def samples(mosaic: DataFrame, key: str, pattern: list[int], side: int, stride: int = 4) -> DataFrame:
    """key, ch, v: every stride-th sample of every stride-th line, by the colour of its site; greens of either kind are one class."""
    site = (F.col("y") % side) * side + F.col("x") % side
    ch = F.get(F.lit([c if c in (0, 1, 2) else 1 for c in pattern]), site.cast("int"))
    return mosaic.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).select(key, ch.alias("ch"), "v")


def highlights(sampled: DataFrame, key: str, black: list[float], white: float, share: float = 0.99) -> DataFrame:
    """key, sampled (their number), h (three values in binary32: the exact quantiles above black, as a share of white above black;
    0 for a class without samples)."""
    q = metrics.class_quantile(sampled, [key, "ch"], "v", share)
    level = F.get(F.lit(black), F.col("ch")).cast("float")
    above = F.greatest(F.lit(0.0).cast("float"), (F.col("q").cast("float") - level) / (F.lit(white).cast("float") - level)).cast("float")  # Spark divides in DOUBLE
    of = lambda k: F.coalesce(F.max(F.when(F.col("ch") == k, above)), F.lit(0.0).cast("float"))
    return q.groupBy(key).agg(F.sum("n").alias("sampled"), F.array(of(0), of(1), of(2)).alias("h"))


def ramp(v: Column, ev: Column) -> Column:
    """The exposure ramp at a candidate exposure: linear between black and white, straight clipped."""
    white = F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), ev))
    black = F.least(F.lit(0.005), 0.99 * white)
    return px.clamp((v - black) / (white - black), 0.0, 1.0)


def tone(v: Column) -> Column:
    return F.sqrt(v) * (1 - 0.2 * v) + 0.2 * v


def gamma(v: Column) -> Column:
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def let(values: list[Column], body) -> Column:
    """body of values that are worked out once: a fold over one element, whose accumulator holds them."""
    packed = F.array(*values)
    return F.get(F.transform(F.array(packed), lambda a: body([F.get(a, k) for k in range(len(values))])), 0)


def rendered_peak(h: list[Column], ev: Column, chain: Chain) -> Column:
    """The largest channel of a colour after the whole chain at an exposure, in binary32 (the encoding of 1 is a little under 1 in DOUBLE).
    It never falls with the exposure."""
    clipped = [F.least(c, F.lit(w)) for c, w in zip(h, chain.camera_white, strict=True)]

    def toned(r: list[Column]) -> Column:
        hi, lo = F.greatest(*r), F.least(*r)
        return let([hi, lo, tone(hi), tone(lo), *r], lambda v: F.array(*[px.toned_channel(c, *v[:4]) for c in v[4:]]))

    ramped = lambda rgb: let([ramp(c, ev) for c in rgb], toned)
    shown = lambda t: F.greatest(*[gamma(c) for c in px.matrix(tuple(F.get(t, k) for k in range(3)), chain.final)])
    lit = let(list(px.matrix(tuple(clipped), chain.camera)), ramped)
    return F.get(F.transform(F.array(lit), shown), 0).cast("float").cast("double")


def solved(frames: DataFrame, chain: Chain) -> DataFrame:
    """frames with status, reason and ev. Columns read: layout_ok (the site table is sound), sampled, h, has_chain, black, white.

    Guards in order: layout, fewer than 4096 samples, no rendering chain, white not above black, no highlight above zero. Then: at or above
    white without gain is 0; below it at two stops is two stops; else the exposure between, by 30 halvings. ev is 0 where status is not ok.
    """
    h = [F.get("h", k).cast("double") for k in range(3)]
    peak = lambda ev: rendered_peak(h, ev, chain)
    finite = F.forall("h", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    checks = [
        (F.col("layout_ok"), "unsupported layout", "site table is missing or out of range"),
        (F.col("sampled") >= LEAST_SAMPLES, "too few samples", "fewer than 4096 samples"),
        (F.col("has_chain"), "no chain", "no rendering chain"),
        (~F.isnan(F.col("white")) & (F.col("white") != float("inf")) & (F.col("white") > F.col("black")), "degenerate", "white is not above black"),
        (finite & F.exists("h", lambda v: v > 0), "degenerate", "no highlight above zero"),
    ]
    status, reason = F.lit("ok"), F.lit(None).cast("string")
    for holds, name, said in reversed(checks):
        bad = ~F.coalesce(holds, F.lit(False))
        status, reason = F.when(bad, name).otherwise(status), F.when(bad, said).otherwise(reason)
    judged = px.apart(frames.withColumns({"status": status, "reason": reason}))
    # frames with the same highlights have the same exposure, which is sought once
    colours = px.apart(judged.where("status = 'ok'").select("h").distinct())
    colours = px.apart(colours.withColumns({"at_none": peak(F.lit(0.0)), "at_most": peak(F.lit(MOST_EV))}))
    between = metrics.bisected(peak, 0.0, MOST_EV, STEPS)
    sought = F.when(F.col("at_none") >= 1.0, 0.0).when(F.col("at_most") < 1.0, MOST_EV).otherwise(between)
    found = px.apart(colours.select(F.col("h").alias("of_h"), "at_none", sought.alias("ev")))
    both = judged.join(found, (F.col("status") == "ok") & (F.col("h") == F.col("of_h")), "left")
    said = F.when(F.col("at_none") >= 1.0, "already at white, no gain").otherwise(F.col("reason"))
    return both.select(*[c for c in judged.columns if c != "reason"], said.alias("reason"), F.coalesce("ev", F.lit(0.0)).alias("ev"))
