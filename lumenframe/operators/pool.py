"""Job-pool semantics over a submission log: coalescing, generations, sizes, buffers, idle sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL_LIMIT = 1 << 28


def dealt(rows: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """rows dealt out by keys to as many tasks as leave each about `most` rows, so that a task's memory does not grow with the table."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // most)), *keys)


def coalesce_jobs(jobs: DataFrame, keys: list[str], order: str, flight: int) -> DataFrame:
    """keys, run, first_seq, joined, generation: a job joins the one in flight with the same key.

    A job is in flight until flight later sequence numbers have passed since the last one that joined it; the run's
    generation is the largest that joined.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    runs = dealt(jobs.select(*keys, order, "generation"), keys).withColumn("__new", F.coalesce(F.col(order) - F.lag(order).over(w) > flight, F.lit(True)).cast("long"))
    runs = runs.withColumn("run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "run").agg(F.min(order).alias("first_seq"), F.count("*").alias("joined"), F.max("generation").alias("generation"))


def current_results(jobs: DataFrame, key: str, order: str, exempt: Column) -> DataFrame:
    """jobs that are not stale: of the largest generation submitted so far (ties in order included) for their key, or exempt."""
    w = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return jobs.withColumn("__newest", F.max("generation").over(w)).where(exempt | (F.col("generation") >= F.col("__newest"))).drop("__newest")


def output_bytes(width: Column, height: Column, fmt: Column) -> Column:
    """Bytes of an output image: 4 a pixel for rgba, a full and two halved planes for yuv420, else -1."""
    w, h = width.cast("long"), height.cast("long")
    chroma = 2 * F.floor((w + 1) / 2) * F.floor((h + 1) / 2)
    return F.when(fmt == "rgba", 4 * w * h).when(fmt == "yuv420", w * h + chroma).otherwise(F.lit(-1)).cast("long")


def attempt_outcome(need: Column, have: Column, resized: Column) -> Column:
    """What a decode into a caller's buffer comes to: one resize, then the decoder's own allocation."""
    return F.when(need < 0, "error").when(need <= have, "ok").when(need <= resized, "ok after resize").otherwise("own allocation")


def slots_for_pixels(pixels: Column, memory: int, fixed: int = 512 << 20) -> Column:
    """Decoders that fit in memory: 10 bytes a pixel rounded up to 128 MiB, and a fixed part; 1 to 16."""
    unit = 128 << 20
    each = F.ceil(pixels * 10 / unit) * unit + fixed
    budget = max(2 << 30, memory - (4 << 30))
    return F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.lit(budget) / each))).cast("long")


def idle_sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, opened, closed, n: spans of activity that end after a quiet gap, when a pool would shrink."""
    s = F.session_window(time, gap)
    return events.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n")


def buffer_pool(requests: DataFrame, key: str, order: str, size: str, hold: int, most: int, cap: int, align: int = 4096) -> DataFrame:
    """key, n, reused, grown, evicted, waited, unpooled per pool, by replaying its requests in order.

    A request takes the first idle buffer that is large enough; else the pool grows up to most buffers; else the
    oldest idle one makes way; else it waits for the oldest in use. A buffer is in use for hold further requests.
    Sizes are rounded up to align; what is above cap is never pooled. The replay is sequential by nature, so each
    pool is one group; pools are independent.
    """

    def replay(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        state: list[list[int]] = []  # size, free from request, given back at
        n = reused = grown = evicted = waited = unpooled = 0
        for raw in f[size]:
            n += 1
            need = -(-int(raw) // align) * align
            if need > cap:
                unpooled += 1
                continue
            idle = [b for b in state if b[1] <= n]
            fit = next((b for b in idle if b[0] >= need), None)
            if fit is not None:
                reused += 1
            elif len(state) < most:
                state.append(fit := [need, 0, 0])
                grown += 1
            elif idle:
                fit = min(idle, key=lambda b: b[2])
                fit[0] = need
                evicted += 1
            else:
                fit = min(state, key=lambda b: b[1])
                fit[0] = max(fit[0], need)
                waited += 1
            fit[1] = fit[2] = n + hold
        return pd.DataFrame([[f[key].iloc[0], n, reused, grown, evicted, waited, unpooled]], columns=[key, "n", "reused", "grown", "evicted", "waited", "unpooled"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, order, size).groupBy(key).applyInPandas(replay, f"{key} {kind}, n long, reused long, grown long, evicted long, waited long, unpooled long")


def probe_outcome(width: Column, height: Column, failed: Column) -> Column:
    """Whether a size probe opens the pooled route."""
    pixels = width.cast("long") * height.cast("long")
    return F.when(failed | (width <= 0) | (height <= 0) | (pixels > PIXEL_LIMIT), "no pooled route").otherwise("pooled")


def trusted_orientation(asked: Column, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    """The orientation that a decode carried out, told from its extent; -1 for a broken contract."""
    swapped = (out_width == height) & (out_height == width)
    return F.when(asked == 1, 1).when(asked < 5, asked).when(width.isNull() | height.isNull(), asked).when(swapped, asked).otherwise(-1).cast("long")
