"""Importance resampling towards a target distribution, over hashed runs of words.

Word runs (n-grams) are counted by hash bucket in the documents and in a target text collection; a document's weight is its runs' mean
log ratio of the two smoothed bucket frequencies. Weights with Gumbel noise rank the documents, so that taking the best k draws
k of them without replacement in proportion to the weights' exponentials.

Runs are found with suffix arrays: the texts of a piece become word ids, their suffixes are sorted, and where neighbours share their
first k words (the longest common prefix is k or more) a run of k words repeats. Each run is hashed once for all its
places, and its bucket is scattered back to them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sharding, tokens
from .ranking import rows_of, running
from .storage import cut


@dataclass(frozen=True)
class Plan:
    """shortest, longest: words of a run. buckets: hash buckets, which bounds what is counted and broadcast. percent: share of the
    eligible documents that is drawn, those with least_words words or more. seed: of the noise."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids from 1, starts, ends, first) of the words of texts: where they are in data, and each text's first word."""
    inside = tokens.ALNUM[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    opens[heads], closes[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = tokens.split_words(data, offsets, tokens.ALNUM).hashes
    return np.unique(hashes, return_inverse=True)[1] + 1, starts, ends, np.searchsorted(starts, offsets)


def suffix_array(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted by their first `longest` words, and how many of these each shares with the one before it.

    left: words from each place to the end of its text, where its suffix ends.
    """
    n = len(ids)
    keys = [np.where(left > j, ids[np.minimum(np.arange(n) + j, n - 1)], 0) for j in range(longest)]
    order = np.lexsort(keys[::-1])
    lcp, alike = np.zeros(n, np.int64), np.ones(n, bool)
    alike[:1] = False
    for key in keys:
        s = key[order]
        alike[1:] &= (s[1:] == s[:-1]) & (s[1:] > 0)
        lcp += alike
    return order, lcp


def run_buckets(data: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(first, [(places, buckets), ...]): each text's first word, and for each length of run where runs begin and their buckets."""
    if not len(data):
        return np.zeros(len(offsets), np.int64), []
    ids, starts, ends, first = word_ids(data, offsets)
    if not len(ids):
        return first, []
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(ids))
    order, lcp = suffix_array(ids, left, plan.longest)
    low = tokens._LOWER[data].tobytes()
    found = []
    for k in range(plan.shortest, plan.longest + 1):
        whole = left[order] >= k
        places, opens = order[whole], (lcp < k)[whole]
        if not len(places):
            break
        heads = places[opens]  # one place of each distinct run
        if k == 1:
            sums = [zlib.crc32(low[a:b]) for a, b in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)]
        else:
            sums = [zlib.crc32(b" ".join(low[starts[p + j] : ends[p + j]] for j in range(k))) for p in heads.tolist()]
        found.append((places, (np.array(sums, np.int64) % plan.buckets)[np.cumsum(opens) - 1]))
    return first, found


def bucket_counts(texts: DataFrame, plan: Plan) -> DataFrame:
    """bucket, n of all runs of the column text. A task sums over all its rows before it sends anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(plan.buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in tokens.pieces(batch.column("text")):
                for _, buckets in run_buckets(data, offsets, plan)[1]:
                    counts += np.bincount(buckets, minlength=plan.buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, plan: Plan) -> np.ndarray:
    """A bucket's gain: 1000 times the log of its smoothed frequency in target over that in docs, rounded down."""
    source, wanted = np.zeros(plan.buckets), np.zeros(plan.buckets)
    for counts, texts in ((source, docs), (wanted, target)):
        for r in bucket_counts(texts, plan).collect():  # a row per bucket at most
            counts[r["bucket"]] = r["n"]
    of_source, of_target = source.sum() + plan.buckets, wanted.sum() + plan.buckets
    return np.array([math.floor(1000 * math.log((t + 1) * of_source / ((s + 1) * of_target))) for s, t in zip(source.tolist(), wanted.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, plan: Plan) -> DataFrame:
    """doc_id, body (hash of the text), n_words, n_features, weight for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, data, offsets in tokens.pieces(batch.column("text")):
                first, found = run_buckets(data, offsets, plan)
                words[lo:hi] = np.diff(first)
                for places, buckets in found:
                    each = np.zeros(first[-1] + 1, np.int64)
                    each[places + 1] = 1
                    features[lo:hi] += np.diff(np.cumsum(each)[first])
                    each[places + 1] = shared.value[buckets]
                    sums[lo:hi] += np.diff(np.cumsum(each)[first])
            weight = np.floor_divide(sums, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), *map(pa.array, (words, features, weight))], ["doc_id", "body", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, f"doc_id {kind}, body long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, body, n_words, n_features, weight, score, rank for every row of docs; rank is null where a row is not drawn.

    A null or empty text has no words, weight 0 and is never drawn (nor is any with fewer than least_words); a null doc_id has the noise of
    the empty string and comes after others in ties. Equal scores go to the smaller doc_id; rows equal in doc_id and text each have a
    rank of their own. An empty table gives no rows; an empty target makes all its frequencies equal. A long text is one piece. Columns
    other than doc_id and text (target: text) are ignored. The driver gets one number per bucket of either collection.
    """
    weighed = weights(docs, gains(docs, target, plan), plan)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    chance = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(chance))))
    # equal rows are counted: a crowd of them is one row until its ranks are known
    rows = scored.groupBy(*scored.columns).agg(F.count("*").alias("copies"))
    rows = cut(rows.withColumn("fit", F.when(F.col("n_words") >= plan.least_words, F.col("copies")).otherwise(0)).withColumn("down", -F.col("score")))
    ranked = running(rows, [], "down", [F.col("doc_id").isNull(), "doc_id", "n_features", "body"], "fit")
    # and is opened in blocks that other tasks share
    ranked = ranked.withColumn("block", F.explode(F.expr("sequence(0L, copies - 1, 4096L)"))).repartition("doc_id", "body", "block")
    each = ranked.withColumn("at", F.explode(F.expr("sequence(block, least(block + 4095, copies - 1))")))
    rank = F.when(F.col("fit") > 0, F.col("start") + F.col("at") + 1)
    return each.select("doc_id", "body", "n_words", "n_features", "weight", "score", F.when(rank <= F.expr(f"total * {plan.percent} div 100"), rank).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The drawn rows of docs with all columns, weight and rank. Rows equal in doc_id and text get the columns of one of them."""
    ranked = resample(docs, target, plan).where("rank IS NOT NULL")
    return rows_of(docs, {"doc_id": F.col("doc_id"), "body": F.xxhash64("text")}, ranked, ["weight", "rank"])


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH {sharding.CRC_TABLE}, words AS (
  SELECT d.rowid AS r, w, count(*) AS k FROM (SELECT row_number() OVER () AS rowid, text FROM documents) d, unnest({_WORDS}) u(w) GROUP BY 1, 2
), wanted AS (
  SELECT w, count(*) AS k FROM benchmark, unnest({_WORDS}) u(w) GROUP BY 1
), known AS (
  SELECT w, {sharding.crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words UNION SELECT w FROM wanted), crc
), source AS (
  SELECT bucket, sum(k) AS s FROM words JOIN known USING (w) GROUP BY 1
), target AS (
  SELECT bucket, sum(k) AS t FROM wanted JOIN known USING (w) GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(k) FROM words) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(k), 0) FROM wanted) + 10000)::DOUBLE))) AS g
  FROM source LEFT JOIN target USING (bucket)
), weighed AS (
  SELECT r, sum(k) AS n, floor(sum(k * g) / sum(k)) AS weight FROM words JOIN known USING (w) JOIN gain USING (bucket) GROUP BY 1
), scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
         + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN weighed USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND k <= 10 * fit // 100 THEN k END AS BIGINT) AS rank FROM ranked
"""
