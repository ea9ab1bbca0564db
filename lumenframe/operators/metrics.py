"""Comparison of two images, and statistics over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME_DB = 999.0


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """frame_id, y, x, ch, a, b: two images, one row per sample; a sample that one lacks is null there."""
    long = lambda d, name: d.select("frame_id", "y", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("ch"), F.col(c).alias(name)) for k, c in enumerate("rgb")])).alias("s")).select("frame_id", "y", "x", "s.ch", f"s.{name}")
    return long(left, "a").join(long(right, "b"), ["frame_id", "y", "x", "ch"], "full")


def psnr_of(mse: Column, top: float) -> Column:
    return F.when(mse == 0, F.lit(SAME_DB)).otherwise(10.0 * F.log10(F.lit(top * top) / mse))


def channel_psnr(pairs: DataFrame, top: float) -> DataFrame:
    """ch, mse, psnr, mae, max_abs, at_y, at_x (first largest difference in row-major order of the first frame)."""
    d = F.abs(F.col("a") - F.col("b")).cast("double")
    first = F.max_by(F.struct("frame_id", "y", "x"), F.struct(d, -F.col("frame_id"), -F.col("y"), -F.col("x")))
    stats = pairs.groupBy("ch").agg(F.avg(d * d).alias("mse"), F.avg(d).alias("mae"), F.max(d).alias("max_abs"), first.alias("at"))
    return stats.select("ch", "mse", psnr_of(F.col("mse"), top).alias("psnr"), "mae", "max_abs", F.col("at.y").alias("at_y"), F.col("at.x").alias("at_x"))


def difference_stats(pairs: DataFrame, top: float) -> DataFrame:
    d = F.abs(F.col("a") - F.col("b")).cast("double")
    stats = pairs.agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.count_if(d > 0).alias("non_zero"), F.avg(d * d).alias("mse"), F.percentile(d, 0.999).alias("p999"))
    return stats.select("max_abs", "mean_abs", "non_zero", psnr_of(F.col("mse"), top).alias("psnr"), "p999")


def class_quantile(samples: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, n, q: the exact order statistic floor(share n), by counts per value.

    The counts are bounded by the number of values (65,536 for 16-bit samples), whatever the number of samples.
    """
    counts = samples.groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    running = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    index = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share))))
    return running.where(F.col("upto") > index).groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("q"))


def bisected(f, lo: float, hi: float, steps: int = 30) -> Column:
    """The place in [lo, hi] where a rising function passes 1; lo if it is there at once, hi if it never is."""
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) * 0.5
        below = f(mid) < 1.0
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: (a["lo"] + a["hi"]) * 0.5)
    return F.when(f(F.lit(lo)) >= 1.0, lo).when(f(F.lit(hi)) < 1.0, hi).otherwise(found)


def frame_hash(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """frame_id, sha256 of the frame's samples in row-major order.

    Lines are hashed one by one and the frame's hash is that of its lines' hashes in order, so no row holds a frame.
    """
    by_line = pixels.groupBy("frame_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", *columns))).alias("s"))
    said = F.array_join(F.transform("s", lambda s: F.concat_ws(",", *[s[c].cast("string") for c in columns])), ";")
    lines = by_line.select("frame_id", "y", F.sha2(said, 256).alias("h"))
    return lines.groupBy("frame_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda s: s["h"]), ""), 256).alias("sha256"))
