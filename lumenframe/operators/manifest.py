"""Corpus manifests: nested JSON documents, and every rule of their schema and coverage that is broken, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that each sample must have, and what enumerated ones may hold.
REQUIRED = "id path sha256 vendor camera extension expect_route expect_layout expect_backend expect_error license".split()
LAYOUTS = "bayer2x2 xtrans6x6 monochrome linear_rgb linear_ycbcr other_cfa layered multi_frame unsupported".split()
BACKENDS = "rawspeed3 libraw_native dng_sdk unknown".split()
SAMPLE = ", ".join(f"{k}: STRING" for k in REQUIRED)
SCHEMA = f"STRUCT<samples: ARRAY<STRUCT<{SAMPLE}>>, _corrupt: STRING>"


def samples(manifests: DataFrame, text: str = "text", key: str = "manifest_id") -> DataFrame:
    """manifest_id, place, corrupt, sample, present (the keys it has): one row per sample, and one for a manifest that is no JSON or has no samples."""
    parsed = F.from_json(text, SCHEMA, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    raw = F.from_json(F.get_json_object(text, "$.samples"), "ARRAY<STRING>")
    read = manifests.select(F.col(key).alias("manifest_id"), parsed.alias("m"), raw.alias("raw"))
    rows = read.select("manifest_id", (F.col("m._corrupt").isNotNull() | F.col("m.samples").isNull()).alias("corrupt"), F.posexplode_outer(F.arrays_zip(F.col("m.samples").alias("s"), F.col("raw").alias("raw"))).alias("place", "z"))
    return rows.select("manifest_id", "place", "corrupt", F.col("z.s").alias("sample"), F.json_object_keys(F.col("z.raw")).alias("present"))


def schema_findings(samples: DataFrame, errors: list[str]) -> DataFrame:
    """manifest_id, id, finding for every broken rule of samples: missing keys, ids told twice, values that are not enumerated, paths that leave the corpus."""
    s = lambda k: F.col(f"sample.{k}")
    no = lambda k, allowed: ~F.coalesce(s(k).isin(allowed), F.lit(False))
    path = F.coalesce(s("path"), F.lit(""))
    said: list[Column] = [F.when(~F.array_contains("present", k), F.lit(f"missing {k}")) for k in REQUIRED]
    said += [
        F.when(no("expect_layout", LAYOUTS), F.concat(F.lit("bad layout "), F.coalesce(s("expect_layout"), F.lit("-")))),
        F.when(no("expect_backend", BACKENDS), F.concat(F.lit("bad backend "), F.coalesce(s("expect_backend"), F.lit("-")))),
        F.when(no("expect_error", errors), F.concat(F.lit("bad error "), F.coalesce(s("expect_error"), F.lit("-")))),
        F.when(path.startswith("/") | path.contains(".."), F.lit("path escapes")),
    ]
    whole = samples.where(F.col("sample").isNotNull())
    each = whole.select("manifest_id", s("id").alias("id"), F.explode(F.array_compact(F.array(*said))).alias("finding"))
    counted = whole.groupBy("manifest_id", F.coalesce(s("id"), F.lit("")).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    twice = counted.select("manifest_id", "id", F.explode(F.expr("array_repeat('duplicate id', int(n - 1))")).alias("finding"))
    broken = samples.where("corrupt").select("manifest_id", F.lit(None).cast("string").alias("id"), F.lit("not a manifest").alias("finding")).distinct()
    return each.unionByName(twice).unionByName(broken)


def coverage_findings(samples: DataFrame, success: str, unsupported: str) -> DataFrame:
    """manifest_id, finding for every minimum of coverage that a manifest misses."""
    s = lambda k: F.col(f"sample.{k}")
    of = lambda layout, k: F.count_distinct(F.when(s("expect_layout") == layout, s(k)))
    counts = samples.groupBy("manifest_id").agg(
        of("bayer2x2", "vendor").alias("bayer_vendors"),
        F.count_if(s("expect_layout") == "xtrans6x6").alias("xtrans"),
        of("xtrans6x6", "camera").alias("xtrans_cameras"),
        F.count_if((s("expect_backend") == "libraw_native") & (s("expect_error") == success)).alias("fallbacks"),
        F.count_if(s("expect_error") == unsupported).alias("unsupported"),
        F.count_if(s("id").startswith("malformed_")).alias("malformed"),
        F.count_if(s("expect_backend") == "rawspeed3").alias("fast"),
    )
    least = {"bayer_vendors": 3, "xtrans": 2, "xtrans_cameras": 2, "fallbacks": 1, "unsupported": 1, "malformed": 3, "fast": 1}
    said = [F.when(F.col(c) < n, F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(f" of {n}"))) for c, n in least.items()]
    return counts.select("manifest_id", F.explode(F.array_compact(F.array(*said))).alias("finding"))
