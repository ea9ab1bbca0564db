"""Queries over corpus manifests: JSON documents made of parts, a manifest per brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest
from ..sources.fixtures import table
from .registry import query

ERRORS = ["success", "probe_failed", "parse_failed", "unpack_failed", "layout_unsupported", "metadata_invalid"]


def manifests(spark, d):
    """manifest_id, text: 2000 numbers' parts of a brand as samples of a manifest; some brands' texts are cut short."""
    c, k, size = F.col, F.col("p_partkey"), F.col("p_size")
    layout = F.get(F.lit([*manifest.LAYOUTS, "hexagonal"]), (size % 10).cast("int"))
    sample = F.struct(
        F.concat(F.when(size > 45, "malformed_").otherwise("s"), F.floor(k / 2).cast("string")).alias("id"),
        F.concat(F.when(size == 7, "/abs/").when(size == 9, "a/../b/").otherwise("raw/"), k.cast("string")).alias("path"),
        F.when(size != 11, F.md5(k.cast("string"))).alias("sha256"),
        c("p_type").alias("vendor"),
        F.when(size != 13, c("p_name")).alias("camera"),
        F.lit("raw").alias("extension"),
        F.lit("generic").alias("expect_route"),
        layout.alias("expect_layout"),
        F.get(F.lit([*manifest.BACKENDS, "magic"]), (size % 5).cast("int")).alias("expect_backend"),
        F.get(F.lit([*ERRORS, "odd"]), (size % 7).cast("int")).alias("expect_error"),
        F.lit("cc0").alias("license"),
    )
    listed = table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", F.floor(k / 2000).cast("string")).alias("manifest_id"), "p_brand").agg(F.array_sort(F.collect_list(F.struct(k, sample.alias("s")))).alias("all"))
    text = F.to_json(F.struct(F.col("all.s").alias("samples")))
    return listed.select("manifest_id", F.when(F.col("p_brand").endswith("5"), F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))).otherwise(text).alias("text"))


_LIST = lambda v: "[" + ", ".join(repr(x) for x in v) + "]"
_ID = "p_brand || '/' || CAST(p_partkey // 2000 AS VARCHAR)"
SAMPLES = f"""s AS (SELECT {_ID} AS manifest_id, CASE WHEN p_size > 45 THEN 'malformed_' ELSE 's' END || CAST(p_partkey // 2 AS VARCHAR) AS id, p_size AS size, p_type AS vendor, CASE WHEN p_size <> 13 THEN p_name END AS camera,
  {_LIST([*manifest.LAYOUTS, 'hexagonal'])}[p_size % 10 + 1] AS layout, {_LIST([*manifest.BACKENDS, 'magic'])}[p_size % 5 + 1] AS backend, {_LIST([*ERRORS, 'odd'])}[p_size % 7 + 1] AS error FROM part WHERE NOT ends_with(p_brand, '5'))"""


@query(
    f"""WITH {SAMPLES}, f AS (SELECT manifest_id, id, 'missing sha256' AS finding FROM s WHERE size = 11 UNION ALL SELECT manifest_id, id, 'missing camera' FROM s WHERE camera IS NULL
UNION ALL SELECT manifest_id, id, 'bad layout hexagonal' FROM s WHERE layout = 'hexagonal' UNION ALL SELECT manifest_id, id, 'bad backend magic' FROM s WHERE backend = 'magic' UNION ALL SELECT manifest_id, id, 'bad error odd' FROM s WHERE error = 'odd'
UNION ALL SELECT manifest_id, id, 'path escapes' FROM s WHERE size IN (7, 9) UNION ALL SELECT manifest_id, id, 'duplicate id' FROM (SELECT manifest_id, id, count(*) AS n FROM s GROUP BY 1, 2), range(1000) t(i) WHERE i < n - 1
UNION ALL SELECT DISTINCT {_ID}, NULL, 'not a manifest' FROM part WHERE ends_with(p_brand, '5')) SELECT * FROM f"""
)
def q_manifest_findings(spark, d):
    """Every broken rule of every sample of every manifest."""
    return manifest.schema_findings(manifest.samples(manifests(spark, d)), ERRORS)


_MIN = {"bayer_vendors": 3, "xtrans": 2, "xtrans_cameras": 2, "fallbacks": 1, "unsupported": 1, "malformed": 3, "fast": 1}


@query(
    f"""WITH {SAMPLES}, c AS (SELECT manifest_id, count(DISTINCT vendor) FILTER (layout = 'bayer2x2') AS bayer_vendors, count(*) FILTER (layout = 'xtrans6x6') AS xtrans, count(DISTINCT camera) FILTER (layout = 'xtrans6x6') AS xtrans_cameras,
  count(*) FILTER (backend = 'libraw_native' AND error = 'success') AS fallbacks, count(*) FILTER (error = 'layout_unsupported') AS unsupported, count(*) FILTER (id LIKE 'malformed_%') AS malformed, count(*) FILTER (backend = 'rawspeed3') AS fast FROM s GROUP BY 1
  UNION ALL SELECT DISTINCT {_ID}, 0, 0, 0, 0, 0, 0, 0 FROM part WHERE ends_with(p_brand, '5'))
"""
    + " UNION ALL ".join(f"SELECT manifest_id, '{c} ' || CAST({c} AS VARCHAR) || ' of {n}' AS finding FROM c WHERE {c} < {n}" for c, n in _MIN.items())
)
def q_manifest_minima(spark, d):
    """Every minimum of coverage that a manifest misses; one that can't be read misses all."""
    s = manifest.samples(manifests(spark, d))
    whole = s.withColumn("sample", F.when(~F.col("corrupt"), F.col("sample")))
    return manifest.coverage_findings(whole, "success", "layout_unsupported")
