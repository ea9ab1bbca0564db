"""Queries over files: heads of files that are written from documents, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import report
from ..operators.folders import work_folder
from ..sources import files, probe
from ..sources.fixtures import MAGICS, decode_log, headers
from .logs import LOG
from .registry import query

#: Documents whose header bytes make up one file.
PER_FILE = 64


def _num(h: str, at: str, n: int) -> str:
    """n bytes of hexadecimal text as a number in the byte order that the first two bytes tell."""
    digits = lambda k: f"substr({h}, CAST(2 * ({at} + {k}) + 1 AS INT), 2)"
    turned, plain = " || ".join(digits(k) for k in reversed(range(n))), " || ".join(digits(k) for k in range(n))
    return f"CAST('0x0' || CASE WHEN {h} LIKE '4949%' THEN {turned} ELSE {plain} END AS BIGINT)"


# Files, their first 512 bytes, and the route and format that stand in these bytes.
FILES_SQL = f"""b AS (SELECT doc_id, {MAGICS!r}[CAST(doc_id % {len(MAGICS)} AS INT) + 1] || substr(hex(substr(text, 1, 60)), 1, 120) AS h FROM documents),
f AS (SELECT doc_id // {PER_FILE} AS k, string_agg(h, '' ORDER BY doc_id) AS whole FROM b GROUP BY 1),
g AS (SELECT k, length(whole) // 2 AS length, substr(whole, 1, 1024) AS h FROM f),
t AS (SELECT *, length(h) // 2 AS n, (h LIKE '49492A00%' OR h LIKE '4D4D002A%') AS tiff FROM g),
d AS (SELECT *, CASE WHEN tiff AND n >= 8 THEN {_num('h', '4', 4)} END AS first FROM t),
e AS (SELECT *, CASE WHEN first + 2 <= n THEN {_num('h', 'first', 2)} ELSE 0 END AS entries FROM d),
tag AS (SELECT k, bool_or({_num('h', '(first + 2 + 12 * i)', 2)} = 50706) AS has FROM e, range(42) r(i) WHERE i < entries AND first + 2 + 12 * i + 12 <= n GROUP BY k),
s AS (SELECT k, h, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS box, list_transform([8, 16, 20, 24, 28], lambda p: {{'p': p, 'b': substr(h, 2 * p + 1, 8)}}) AS found FROM e WHERE n >= 12),
brand AS (SELECT k, list_filter(found, lambda x: x.b IN ('61766966', '61766973', '68656963', '68656978', '6D696631', '6D736631') AND (x.p = 8 OR x.p + 4 <= least(n, 32, box))) AS known FROM s)
SELECT e.k, e.length, CASE WHEN n < 8 THEN 'error' WHEN {' OR '.join(f"h LIKE '{probe.hexed(m)}%'" for m in probe.RAW_MAGICS)} OR substr(h, 9, 14) IN ({', '.join(repr(probe.hexed(m)) for m in probe.RAW_BRANDS)}) THEN 'generic'
    WHEN NOT tiff THEN 'error' WHEN tag.has THEN 'dng' ELSE 'generic' END AS route,
  CASE WHEN n < 12 THEN 'unknown' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '52494646________57454250%' THEN 'webp' WHEN h LIKE 'FF0A%' OR h LIKE '0000000C4A584C200D0A870A%' THEN 'jxl'
    WHEN substr(h, 9, 8) = '66747970' THEN CASE WHEN known[1].b IN ('61766966', '61766973') THEN 'avif' ELSE 'heic' END ELSE 'unknown' END AS still
FROM e LEFT JOIN tag ON tag.k = e.k LEFT JOIN brand ON brand.k = e.k"""


@query(f"WITH {FILES_SQL}")
def q_probe_file(spark, d):
    """The headers of every 64 documents are written as one file; the files are then probed by their first bytes."""
    files.register(spark)
    folder = f"{work_folder(spark)}/heads-{uuid.uuid4().hex}"
    grouped = headers(spark, d).groupBy(F.expr(f"doc_id div {PER_FILE}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "hex"))).alias("s"))
    content = F.unhex(F.array_join(F.transform("s", lambda s: s["hex"]), ""))
    grouped.select(F.concat(F.col("k").cast("string"), F.lit(".bin")).alias("name"), content.alias("content")).write.format("file_set").mode("overwrite").save(folder)
    return probe.probe_files(spark, folder).select(F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("k"), "length", "route", "still")


@query(
    f"""WITH {LOG}, m AS (SELECT lane, date_trunc('day', make_timestamp(start_us)) AS day, count(*) AS records, count(*) FILTER (NOT valid) AS failed, max(busy_ms) AS peak_ms FROM log GROUP BY 1, 2)
SELECT 'lane-' || CAST(lane AS VARCHAR) || '.md' AS name, '| day | records | failed | peak |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || strftime(day, '%Y-%m-%d') || ' | ' || CAST(records AS VARCHAR) || ' | '
  || CAST(failed AS VARCHAR) || ' | ' || CAST(CAST(floor(peak_ms) AS BIGINT) AS VARCHAR) || ' |', chr(10) ORDER BY day) || chr(10) AS content FROM m GROUP BY lane"""
)
def q_report_sink(spark, d):
    """A report per lane with a line per day, written twice over the same folder and read back: one set of files is left."""
    files.register(spark)
    folder = f"{work_folder(spark)}/reports-{uuid.uuid4().hex}"
    daily = decode_log(spark, d).groupBy("lane", F.to_date(F.timestamp_micros("start_us")).alias("day")).agg(F.count("*").alias("records"), F.count_if(~F.col("valid")).alias("failed"), F.floor(F.max("busy_ms")).alias("peak"))
    made = report.markdown(daily, F.concat(F.lit("lane-"), F.col("lane").cast("string"), F.lit(".md")), ["day", "records", "failed", "peak"], ["day"])
    for _ in range(2):
        made.write.format("file_set").mode("overwrite").save(folder)
    back = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return back.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
