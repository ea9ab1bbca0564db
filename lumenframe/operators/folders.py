"""The folder for checkpoints and streaming state."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, but only where Spark runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lumenframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named
