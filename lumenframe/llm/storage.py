"""Where intermediate tables go: the reliable checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, but only where Spark runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lumenframe-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and return the stored copy, without df's lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: smaller than cut()'s files, and not partitioned by any key."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for table in tables:
        if files := table.inputFiles():
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def membership(ids: DataFrame, column: str, bits: int = 23) -> DataFrame:
    """One row with a bitmap (array of longs, 2 ** bits bits) of 64-bit ids, for may_hold().

    Its size does not depend on the ids; the more there are, the fewer rows a test against it leaves out.
    """
    spark = ids.sparkSession
    part = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = ids.select(F.shiftright(part, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = spark.range(1 << (bits - 6)).join(words, F.col("id") == F.col("w"), "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x"))
    return cut(listed.select(F.col("x.b").alias("bitmap")))


def may_hold(bitmap: DataFrame, id_: str, bits: int = 23) -> Column:
    """Whether an id can be among those of a bitmap: true for all that are, and for some others."""
    word = F.get(bitmap.scalar(), F.shiftright(F.col(id_).bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, cast({id_} & 63 as int))")) != 0


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text (by its hash, body) are in gone."""
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("body").alias("__gone_body"))
    named = by_place(docs, ("doc_id", "text"))
    return named.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_body")), "left_anti").toDF(*docs.columns)


def by_place(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """rows with all columns but those of keep named by their places, so that no name of theirs meets a new column."""
    return rows.toDF(*[c if c in keep else f"at_{k}" for k, c in enumerate(rows.columns)])
