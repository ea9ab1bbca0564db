"""Shards that all have the mixture of the whole: proportional stratified interleaving.

The rows of each source are put into a seeded random order. Row r (from 0) of a source of n rows stands at the fraction
(r + 1/2) / n of it; sorting all rows by these fractions deals every source out evenly over the whole order, and
cutting that order into pieces of equal counts gives each shard each source's share, to within one row or so.

No step sees a whole source: random keys and fractions are both spread evenly, so their leading parts cut the
rows into ranges of about equal size. Equal rows are counted and not carried, and a group of them that reaches over many ranges is
opened range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rows_of, running
from .storage import cut

KEYS = ["doc_id", "source", "size", "text_crc32"]


def text_of() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def interleave(docs: DataFrame, shards: int = 16, seed: str = "2024", ranges: int = 4096) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard, slot for every row of docs; counts of shards differ by one at most.

    size: UTF-8 bytes of the text plus one. slot: the row's place in its shard, from 0, without gaps; reading a shard in that
    order meets the sources in proportion all along. The random order follows from the seed, the doc_id and the text's CRC, so reruns
    agree. A null text counts as an empty one; a null source is a source of its own, last in order; null doc_ids take part, told
    apart by their texts. Rows equal in doc_id, text and source are counted, each gets a place of its own. Texts of any length are only
    hashed. Fewer rows than shards leave shards empty; an empty table gives no rows. Columns other than doc_id, text and source
    are ignored. ranges: pieces of the whole order that are sorted apart; 4096 pieces of 10 ** 10 rows are 2.4 million narrow rows each.
    """
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select(
        "doc_id",
        F.col("source").isNull().alias("src_null"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    ).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), id_text, F.col("text_crc32").cast("string"))))
    rows = cut(sized.groupBy(*sized.columns).agg(F.count("*").alias("copies")).withColumn("lead", F.substring("key", 1, 3)))
    ranked = running(rows, ["src_null", "src"], "lead", ["key", "doc_id", "size", "text_crc32"], "copies")

    # Rank r of n lies in piece (2 r + 1) * ranges div (2 n); a group of equal rows is cut where pieces begin.
    piece = lambda r: F.expr(f"(2 * ({r}) + 1) * {ranges} div (2 * total)")
    begin = lambda p: F.expr(f"(2 * total * ({p}) + {ranges - 1}) div {2 * ranges}")
    parts = (
        ranked.withColumn("piece", F.explode(F.sequence(piece("start"), piece("start + copies - 1"))))
        .withColumn("first", F.greatest("start", begin("piece")))
        .withColumn("n", F.least(F.col("start") + F.col("copies"), begin("piece + 1")) - F.col("first"))
        .where("n > 0")  # where pieces are finer than ranks, some have none of the group
    )
    parts = cut(parts.select("doc_id", "src_null", "src", "size", "text_crc32", "piece", "first", "n", F.col("total").alias("of_source")))

    def opened(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.explode(F.sequence(F.col("first"), F.expr("first + n - 1")))).withColumn("fraction", (F.col("rank") + 0.5) / F.col("of_source"))

    placed = running(parts, [], "piece", ["fraction", "src_null", "src", "rank"], "n", opened)
    shard = F.expr(f"start * {shards} div total")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        F.when(~F.col("src_null"), F.col("src")).alias("source"),
        "size",
        "text_crc32",
        "fraction",
        "shard",
        F.expr(f"start - (shard * total + {shards - 1}) div {shards}").alias("slot"),
    )


def sharded(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The rows of docs with all columns, and shard and slot. Rows equal in doc_id, text and source get the columns of one of them."""
    keys = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": (F.octet_length(text_of()) + 1).cast("long"), "text_crc32": F.crc32(text_of().cast("binary"))}
    return rows_of(docs, keys, interleave(docs, shards, **options), ["shard", "slot"])


def write_shards(docs: DataFrame, path: str, shards: int = 16, files: int = 1, **options) -> None:
    """Write the shards as Parquet below path, a folder shard=k each, with its rows in slot order over about `files` files."""
    placed = sharded(docs, shards, **options)
    placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: CRC-32 of a list of bytes as a fold over a table of 256 numbers, itself a fold: polynomial 0xEDB88320, eight steps for each.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(k))
)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a SQL string; CRC_TABLE must be among the tables read."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {digits}), lambda a, b: xor(t[xor(a % 256, b) + 1], a // 256)))"


ORACLE = f"""
WITH {CRC_TABLE}, sized AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('2024:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)),
         doc_id, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, source NULLS LAST, rank) - 1 AS pos, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(pos * 16 // total AS INT) AS shard,
       CAST(pos - (pos * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""
