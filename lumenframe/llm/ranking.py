"""Positions in a global order, without a task that sees all rows.

Rows are cut into ranges of the order. Weights are summed per range, the ranges' running sums give each range its
offset, and a window inside a range does the rest. Only one narrow row per range ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, within: list[str], span: str, order: list[str | Column], weight: str, opened: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with start (the weights of all rows before it in its group) and total (of its whole group).

    within: columns of a group, none of them null; empty for one global order. span: a column, not null, that cuts a group into
    ranges and agrees with the order; it should have many values, each with few rows. opened, if given, is applied to the rows of a
    range once they are together (a row of weight w may become w rows there); the weight of each row is 1 after it.
    """
    rows = rows.repartition(*within, span)
    sums = rows.groupBy(*within, span).agg(F.sum(weight).alias("sum_of_range"))
    ranges = Window.partitionBy(*(within or [F.lit(0)]))
    offsets = sums.select(
        *within,
        span,
        F.coalesce(F.sum("sum_of_range").over(ranges.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"),
        F.sum("sum_of_range").over(ranges).cast("long").alias("total"),
    )
    joined = rows.join(offsets, [*within, span])
    each = F.col(weight)
    if opened is not None:
        joined, each = opened(joined), F.lit(1)
    inside = Window.partitionBy(*within, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("start", F.col("offset") + F.coalesce(F.sum(each).over(inside), F.lit(0))).drop("offset")


def rows_of(docs: DataFrame, keys: dict[str, Column], assigned: DataFrame, new: list[str]) -> DataFrame:
    """A row of docs, with all its columns, for each row of assigned, with the columns new of it (docs' own of these names give way).

    keys: the columns of assigned that tell documents apart, and what they are in docs. Documents that are equal in all keys are
    written with the columns of one of them.
    """
    kept = [c for c in docs.columns if c not in new]
    one = docs.select(*[c.alias(f"key_{k}") for k, c in enumerate(keys.values())], F.struct(*[F.col(f"`{c}`").alias(f"column_{k}") for k, c in enumerate(kept)]).alias("row"))
    one = one.groupBy(*[f"key_{k}" for k in range(len(keys))]).agg(F.first("row").alias("row"))
    named = assigned.select(*[F.col(c).alias(f"with_{k}") for k, c in enumerate(keys)], *[F.col(c).alias(f"new_{k}") for k, c in enumerate(new)])
    same = [F.col(f"key_{k}").eqNullSafe(F.col(f"with_{k}")) for k in range(len(keys))]
    return one.join(named, same).select(*[F.col(f"row.column_{k}").alias(c) for k, c in enumerate(kept)], *[F.col(f"new_{k}").alias(c) for k, c in enumerate(new)])
