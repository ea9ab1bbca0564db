"""File heads as a source, file sets as a sink, reports."""

import os

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import report
from lumenframe.sources import files, probe


def names(folder):
    return sorted(f for _, _, fs in os.walk(folder) for f in fs if not f.startswith("."))


def test_only_heads_are_read(spark, tmp_path):
    """A sparse file of a terabyte: reading it whole could not end."""
    with open(tmp_path / "big.arw", "wb") as f:
        f.write(b"FUJIFILMCCD-RAW " + b"x" * 600)
        f.truncate(1 << 40)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"FOVb....")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jpg").write_bytes(bytes.fromhex("FFD8FFE0") + bytes(20))
    got = {os.path.basename(r["path"]): (r["length"], r["route"], r["still"]) for r in probe.probe_files(spark, str(tmp_path)).collect()}
    assert got == {"big.arw": (1 << 40, "generic", "unknown"), "empty.bin": (0, "error", "unknown"), "a.jpg": (24, "error", "jpeg")}
    heads = spark.read.format("file_heads").option("bytes", 10).option("files", 1).load(str(tmp_path))
    assert heads.rdd.getNumPartitions() == 3 and {r["path"].rsplit("/", 1)[1]: len(r["head"]) for r in heads.collect()}["big.arw"] == 10


def test_no_files(spark, tmp_path):
    files.register(spark)
    assert spark.read.format("file_heads").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("file_heads").load(str(tmp_path / "nowhere")).count()


def test_set_is_replaced_as_a_whole(spark, tmp_path):
    files.register(spark)
    df = lambda n: spark.range(n).repartition(3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    folder = str(tmp_path / "set")
    for n in (20, 20, 7):
        df(n).write.format("file_set").mode("overwrite").save(folder)
        assert names(folder) == sorted(f"f{k}" for k in range(n))
    back = spark.read.format("file_heads").load(folder)
    assert sorted(bytes(r["head"]).decode() for r in back.collect()) == sorted(str(k) for k in range(7))
    spark.createDataFrame([("g", "text"), ("h", None)], "name string, content string").write.format("file_set").mode("append").save(folder)
    assert names(folder) == sorted([*[f"f{k}" for k in range(7)], "g", "h"])
    # a job that fails leaves what was there, and nothing of its own
    bad = spark.createDataFrame([("x", "1"), ("a/b", "2")], "name string, content string").coalesce(1)
    with pytest.raises(Exception, match="not a new file name"):
        bad.write.format("file_set").mode("overwrite").save(folder)
    assert names(folder) == sorted([*[f"f{k}" for k in range(7)], "g", "h"]) and not [x for x in os.listdir(folder) if x.startswith("_staging")]


def test_markdown(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, "x|y"), ("b", 3, "z")], "k string, n int, s string")
    got = {r["name"]: r["content"] for r in report.markdown(rows, F.col("k"), ["n", "s"], ["n"]).collect()}
    assert got == {"a": "| n | s |\n|---|---|\n| 1 | x\\|y |\n| 2 | - |\n", "b": "| n | s |\n|---|---|\n| 3 | z |\n"}
