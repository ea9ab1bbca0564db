"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. A source's documents are range-partitioned by the leading hex
digits of that key, token counts are summed for each range, and the running sums of the ranges plus a
running sum inside each range give every document its position in the source's random order. The
source's budget is cut at exactly that position; whole epochs come before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import by_place, cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Target words of each source.

    sizes: one row per source (src_null boolean, src string, source_size long). Weights repeat over the
    sources in code point order, null last. The total of all sizes is shared by weight; no target exceeds
    max_epochs * source_size, and what is above goes to the others by weight (water filling: sorted by
    cap / weight, a source is capped while its ratio is below the level that the rest would get).
    The two windows without keys see one row per source, never a row per document.
    """
    by_name = Window.orderBy("src_null", "src")
    level = Window.orderBy("ratio", "src_null", "src")
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("capped", F.col("ratio") * F.col("weight_from") <= F.col("total") - F.col("cap_before"))
        .withColumn("capped_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("open_weight", F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything))
    )
    share = F.col("weight") * (F.col("total") - F.col("capped_sum")) / F.col("open_weight")
    return s.select("src_null", "src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(share, F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, key_digits: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and epochs) for every row of docs.

    The random key is the MD5 of doc_id, so reruns agree; equal keys are ordered by doc_id and size.
    A null text has size 0, a null doc_id takes part with the key of the empty string, a null source is
    a source of its own (last in order). Repeated rows each count. An empty table gives no rows. Columns
    other than doc_id, text, source and those in carry are ignored. key_digits: 16 ** key_digits ranges per source; at
    3 digits a range of the largest source of 10 ** 10 documents is about 10 ** 6 narrow rows.
    """
    sized = cut(
        docs.select(
            "doc_id",
            *carry,
            F.col("source").isNull().alias("src_null"),
            F.coalesce(F.col("source"), F.lit("")).alias("src"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        ).withColumn("range", F.substring("key", 1, key_digits))
    )
    ranges = sized.groupBy("src_null", "src", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("src_null", "src").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("src_null", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    cuts = cut(
        ranges.withColumn("before", before)
        .join(targets, ["src_null", "src"])
        .withColumn("epochs", epochs)
        .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("src_null", "src", "range", "before", "source_size", "target", "epochs", "budget")
    )
    inside = Window.partitionBy("src_null", "src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        sized.join(cuts, ["src_null", "src", "range"])
        .withColumn("start", start)
        .select(
            "doc_id",
            *carry,
            F.when(F.col("src_null"), F.lit(None).cast("string")).otherwise(F.col("src")).alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("budget") - F.col("start"), F.col("size")))).cast("long").alias("taken"),
        )
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns, that the mix takes words of; beside them size, source_size, target, taken.

    Columns of docs with one of those four names give way to the new; others may have any name. Null doc_ids, texts and sources are
    as in mix; a row of no words is left out. Repeated rows share what they were given, rounded down for each.
    """
    new = ("size", "source_size", "target", "taken")
    given = [c for c in docs.columns if c not in new]
    docs = by_place(docs.select(*[F.col(f"`{c}`") for c in given]), ("doc_id", "text", "source"))
    rows = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("__body"))
    plan = mix(rows, carry=("__body",), **options).where("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("__id"), "__body", F.col("source").alias("__source")).agg(
        F.struct(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("rows")).alias("__mix")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__body")) & F.col("source").eqNullSafe(F.col("__source"))
    # repeated rows share what they were given
    taken = (F.col("__mix.taken") / F.col("__mix.rows")).cast("long").alias("taken")
    return docs.join(plan, same).select(*docs.columns, *[F.col(f"__mix.{c}").alias(c) for c in new[:3]], taken).toDF(*given, *new)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
         CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM per_source
), levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM weighted
), marked AS (
  SELECT *, cap / w * weight_from <= total - cap_before AS capped FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, w
           * (total - (SELECT coalesce(sum(cap), 0) FROM marked WHERE capped)) / (SELECT sum(w) FROM marked WHERE NOT capped)) END AS target
  FROM marked
), placed AS (
  SELECT doc_id, s.source, size, source_size, target,
         CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(CAST(round(target - epochs * source_size) AS BIGINT) - start, size)) AS BIGINT) AS taken
FROM placed
"""
