"""Timing-log analytics over (lane, submission, start_us, end_us, busy_ms, valid) records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_cold(log: DataFrame, lane: str = "lane", order: str = "submission") -> DataFrame:
    """log without the first record of each lane."""
    w = Window.partitionBy(lane).orderBy(order)
    return log.withColumn("__rank", F.row_number().over(w)).where("__rank > 1").drop("__rank")


def interval_union(log: DataFrame, keys: list[str], start: str = "start_us", end: str = "end_us", span: int = 3_600_000_000) -> DataFrame:
    """keys, islands, union_us: the length covered by intervals. Touching intervals belong together.

    An interval opens a new island if it starts behind everything before it in the order of starts, and adds what it reaches beyond that. A sweep of two
    levels: the furthest end of each time slice of span, the furthest end of all slices before it, then the order inside a slice. So a busy
    key is swept by as many tasks as it has slices; intervals that start at one instant are one before that.
    """
    one = log.groupBy(*keys, start).agg(F.max(end).alias("__end")).withColumn("__slice", F.floor(F.col(start) / span))
    slices = one.groupBy(*keys, "__slice").agg(F.max("__end").alias("__high"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    reached = slices.select(*keys, "__slice", F.max("__high").over(earlier).alias("__reached"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    swept = one.join(reached, [*keys, "__slice"]).withColumn("__before", F.greatest("__reached", F.max("__end").over(inside)))  # greatest skips nulls
    opens = F.coalesce(F.col(start) > F.col("__before"), F.lit(True))
    gained = F.greatest(F.lit(0), F.col("__end") - F.greatest(start, "__before"))
    return swept.groupBy(*keys).agg(F.sum(opens.cast("long")).alias("islands"), F.sum(gained).alias("union_us"))


def stage_medians(log: DataFrame) -> DataFrame:
    """stage (3 for even submissions, 4 for odd), n, median_ms."""
    return log.groupBy((F.lit(3) + F.col("submission") % 2).alias("stage")).agg(F.count("busy_ms").alias("n"), F.median("busy_ms").alias("median_ms"))


def summarise(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: records kept and dropped as cold, lanes, valid and invalid ones, median; void without valid records."""
    w = Window.partitionBy(*keys, "lane").orderBy("submission")
    ranked = log.withColumn("__rank", F.row_number().over(w))
    warm = F.col("__rank") > 1
    return ranked.groupBy(*keys).agg(
        F.count_if(warm).alias("kept"),
        F.count_if(~warm).alias("cold"),
        F.countDistinct("lane").alias("lanes"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.median(F.when(warm & F.col("valid"), F.col("busy_ms"))).alias("median_ms"),
        (F.count_if(F.col("valid") & warm) == 0).alias("void"),
    )


def inflation(summary: DataFrame, arm: str, width: str, metric: str) -> DataFrame:
    """summary with metric divided by the same arm's metric at width 1; null without such a baseline."""
    base = F.max(F.when(F.col(width) == 1, F.col(metric))).over(Window.partitionBy(arm))
    return summary.withColumn("inflation", F.when(base > 0, F.col(metric) / base))


def ratio_verdict(ratio: Column, staircase: float = 4.0, overlapped: float = 2.5) -> Column:
    return F.when(ratio.isNull() | (ratio <= 0), "INCONCLUSIVE").when(ratio >= staircase, "STAIRCASE").when(ratio < overlapped, "OVERLAPPED").otherwise("INCONCLUSIVE")


def parallel_ratio(walls: DataFrame, width: str, wall: str, wide: int = 5) -> DataFrame:
    """serial, wide, ratio of the median walls, verdict: one row."""
    medians = walls.agg(F.median(F.when(F.col(width) == 1, F.col(wall))).alias("serial_ms"), F.median(F.when(F.col(width) == wide, F.col(wall))).alias("wide_ms"))
    ratio = F.when(F.col("serial_ms") > 0, F.col("wide_ms") / F.col("serial_ms"))
    return medians.withColumn("ratio", ratio).withColumn("verdict", ratio_verdict(F.col("ratio")))


def high_water(log: DataFrame, keys: list[str], span: int = 3_600_000_000) -> DataFrame:
    """keys, high_water: the most intervals open at once; at one instant ends come before starts.

    Starts and ends of an instant are added up first, as only their sum can raise the number. Then a sweep of two levels, as in interval_union:
    sums of time slices, sums of all slices before, the order inside a slice.
    """
    ends = F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))
    steps = log.select(*keys, F.explode(ends).alias("s")).groupBy(*keys, F.col("s.t").alias("t")).agg(F.sum("s.d").alias("d")).withColumn("__slice", F.floor(F.col("t") / span))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = steps.groupBy(*keys, "__slice").agg(F.sum("d").alias("d")).select(*keys, "__slice", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__slice").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = steps.join(before, [*keys, "__slice"]).withColumn("__open", F.col("__before") + F.sum("d").over(inside))
    return swept.groupBy(*keys).agg(F.max("__open").alias("high_water"))


def slow_latch(log: DataFrame, threshold: float) -> DataFrame:
    """lane, latch: the first even submission from which on all even ones are above threshold, null if none.

    The least latch of the lanes is what a run is judged by. This is the engine's own rule.
    """
    even = log.where("submission % 2 = 0")
    last_calm = even.groupBy("lane").agg(F.max(F.when(F.col("busy_ms") <= threshold, F.col("submission"))).alias("calm"))
    later = even.join(last_calm, "lane").where(F.col("calm").isNull() | (F.col("submission") > F.col("calm")))
    found = later.groupBy("lane").agg(F.min("submission").alias("latch"))
    return last_calm.select("lane").join(found, "lane", "left")


def completion_offsets(log: DataFrame, batch: str) -> DataFrame:
    """batch, place, offset_us: ends after the batch's first start, in order."""
    whole, order = Window.partitionBy(batch), Window.partitionBy(batch).orderBy("end_us", "event_id")
    return log.select(batch, (F.row_number().over(order) - 1).cast("long").alias("place"), (F.col("end_us") - F.min("start_us").over(whole)).alias("offset_us"))


def first_seen_ids(log: DataFrame, key: str, order: str, slices: int = 1024) -> DataFrame:
    """key, first_seen, dense_id: ids from 0 in the order in which keys are first seen. Null orders count as the first.

    The range of orders is cut into slices; keys are numbered inside a slice, from the number of keys in all slices before it. Only the slices'
    counts, a bounded number, ever meet in one row.
    """
    first = log.groupBy(key).agg(F.min(order).alias("first_seen"))
    ends = first.agg(F.min("first_seen").alias("lo"), F.max("first_seen").alias("hi"))
    lo, hi = (ends.select(c).scalar().cast("decimal(20,0)") for c in ("lo", "hi"))
    at = F.floor((F.col("first_seen").cast("decimal(20,0)") - lo) * slices / (hi - lo + 1)).cast("int")
    placed = first.withColumn("__slice", F.coalesce(at, F.lit(-1)))
    counts = placed.groupBy("__slice").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("__slice", "n"))).alias("c"))
    before = F.aggregate(F.slice("c", 1, F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    offsets = counts.select("c", F.posexplode("c").alias("pos", "s")).select(F.col("s.__slice").alias("__slice"), before.alias("__offset"))
    inside = Window.partitionBy("__slice").orderBy("first_seen", key)
    return placed.join(offsets, "__slice").select(key, "first_seen", (F.col("__offset") + F.row_number().over(inside) - 1).alias("dense_id"))


def uploads(submissions: DataFrame, slot: str, order: str, digest: Column) -> DataFrame:
    """slot, hits, uploads: a submission whose parameters equal the previous one's of its slot is a hit."""
    w = Window.partitionBy(slot).orderBy(order)
    seen = submissions.withColumn("__digest", digest).withColumn("__hit", F.coalesce(F.lag("__digest").over(w) == F.col("__digest"), F.lit(False)))
    return seen.groupBy(slot).agg(F.count_if("__hit").alias("hits"), F.count_if(~F.col("__hit")).alias("uploads"))


def stage_of_line(lines: DataFrame, run: str, order: str, header: Column) -> DataFrame:
    """lines with stage: the last header seen at or above each line of its run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("stage", F.last(header, ignorenulls=True).over(w))
