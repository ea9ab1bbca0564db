"""Near-duplicate documents by MinHash with odd sketches.

A document's set is its distinct word shingles. MinHash samples of the set are cut into bands; documents
that agree in a band are candidates. The samples, folded into a parity bitmap (odd sketch), give an
estimate of a candidate pair's similarity from the population count of the bitmaps' XOR, which is precise
where similarities are high; pairs that it places far below the threshold are dropped. What remains is
confirmed on the full sets. Documents with equal sets are one node from the start, so a group of copies
never makes pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .graph import crowds, dealt_join, linked_components
from .storage import cut, may_hold, membership, store, without


@dataclass(frozen=True)
class Plan:
    """shingle: words in a shingle. threshold: least Jaccard similarity, in hundredths. A pair at 0.8 agrees
    in none of 24 bands of 4 samples with a probability of 3e-6. sketch_words: 64-bit words of the bitmap.
    slack: standard deviations of the sketch's estimate by which a pair may miss the threshold."""

    shingle: int = 5
    threshold: int = 80
    bands: int = 24
    rows: int = 4
    sketch_words: int = 4
    slack: float = 5.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_bits(self) -> int:
        """XOR population count up to which a pair passes on to the full sets."""
        n, k, j = 64 * self.sketch_words, self.samples, self.threshold / 100
        low = max(0.0, j - self.slack * math.sqrt(j * (1 - j) / k))
        differing = 2 * k * (1 - low)
        mean = n * (1 - (1 - 2 / n) ** differing) / 2
        return min(n, int(mean + self.slack * math.sqrt(n) / 4))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows; of the whole sequence if it is shorter, none if empty."""
    n = len(words)
    if not n:
        return words
    take = min(k, n)
    h = np.full(n - take + 1, np.uint64(take), np.uint64)
    for i in range(take):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : n - take + 1 + i]
    return np.unique(tokens.mix(h))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(97).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(band keys as int64, sketch words as int64) of a set that is not empty."""
    factors = _multipliers(plan.samples)
    least = np.full(plan.samples, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (factors[:, None] * shingles[None, at : at + 2048]).min(axis=1))
    samples = tokens.mix(least + np.arange(plan.samples, dtype=np.uint64))
    bands = np.zeros(plan.bands, np.uint64)
    for i in range(plan.rows):
        bands = bands * np.uint64(0xD6E8FEB86659FD93) + samples[i :: plan.rows]
    bands = tokens.mix(bands + np.arange(plan.bands, dtype=np.uint64))
    bits = (samples % np.uint64(64 * plan.sketch_words)).astype(np.int64)
    parity = np.bincount(bits, minlength=64 * plan.sketch_words) & 1
    sketch = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
    return bands.view(np.int64), sketch


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes) of each text of a batch."""
    for lo, hi, data, offsets in tokens.pieces(batch.column("text")):
        words = tokens.split_words(data, offsets, tokens.NOT_SPACE)
        for row in range(lo, hi):
            yield row, shingle_hashes(words.hashes[words.first[row - lo] : words.first[row - lo + 1]], k)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(shingles.sum(dtype=np.uint64)).to_bytes(8, "big") + int(tokens.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)).to_bytes(8, "big")


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, body (hash of the text), n_shingles, node (fingerprint of the set; null if empty), bands, sketch for every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for _, s in _sets(batch, plan.shingle):
                sizes.append(len(s))
                b, o = signature(s, plan) if len(s) else (None, None)
                nodes.append(fingerprint(s) if len(s) else None)
                bands.append(b)
                sketches.append(o)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "body", "n_shingles", "node", "bands", "sketch"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, f"doc_id {id_type}, body long, n_shingles long, node binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """node, shingles: the sorted 64-bit hashes of the set, for every row with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for _, s in _sets(batch, plan.shingle):
                if len(s):
                    nodes.append(fingerprint(s))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "node binary, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= plan.threshold * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = dealt_join(pairs.withColumn("node", F.col("a")), sets, "node").select("l.a", "l.b", F.col("r.shingles").alias("left"))
    both = dealt_join(first.withColumn("node", F.col("b")), sets, "node").select("l.a", "l.b", "l.left", F.col("r.shingles").alias("right"))
    return both.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, body, n_shingles, component_id, kept for every row of docs. body is a hash of the text.

    component_id is the smallest doc_id that can be reached over links, kept says that it is the row's own.
    A null or empty text, or one of white space, has an empty set, is linked with nothing and kept. Rows
    with the same doc_id are told apart by their sets: equal texts share a component, so exact repeated
    rows are both kept as one document. A null doc_id takes part in links; it is the component_id only where
    no other is reached. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    signed = store(signatures(docs, plan))
    nodes = store(
        signed.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).getField("body").alias("body"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    members = nodes.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    crowd = store(crowds(members))
    chosen = cut(crowd.select("node").distinct().join(nodes, "node").select("node", "least_id", "body", "n", "sketch"))
    # One text of each node: told by its hash, which a bitmap of bounded size tests before anything is shuffled.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("body")).where(may_hold(membership(chosen, "body"), "body"))
    texts = texts.join(chosen.select("body", F.col("least_id").alias("doc_id")).distinct(), ["body", "doc_id"], "left_semi").unionByName(texts.where(F.col("doc_id").isNull()).select("body", "doc_id", "text"))
    sets = full_sets(texts, plan)
    sets = store(sets.join(chosen.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))
    most, t = plan.most_bits(), plan.threshold

    def near(left, right) -> Column:
        bits = sum((F.bit_count(left("sketch")[i].bitwiseXOR(right("sketch")[i])) for i in range(plan.sketch_words)), F.lit(0))
        return (100 * left("n") >= t * right("n")) & (100 * right("n") >= t * left("n")) & (bits <= most)

    def refine(rows: DataFrame) -> DataFrame:
        """Leave out nodes of which too many shingles are in no other node: whatever the partner, at most the others are
        shared, and a link needs t (n + n_partner) / (100 + t) of them. What stays brings its set along."""
        rows = store(rows)
        mine = sets.join(rows.select("node").distinct(), "node", "left_semi")
        once = mine.select("node", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.first("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("alone"))
        usable = rows.join(once, "node", "left").withColumn("usable", F.col("n") - F.coalesce("alone", F.lit(0)))
        least = usable.groupBy("bucket").agg(F.min("n").alias("least_n"))
        fit = dealt_join(usable, least, "bucket").where((100 + t) * F.col("l.usable") >= t * (F.col("l.n") + F.greatest(F.col("r.least_n"), F.col("l.n") * t / 100))).select("l.*").drop("deal", "alone", "usable")
        return dealt_join(fit, sets, "node").select("l.*", "r.shingles").drop("deal")

    def exact(left, right) -> Column:
        shared = F.size(F.array_intersect(left("shingles"), right("shingles")))
        return (100 + t) * shared >= t * (left("n") + right("n"))

    stars = linked_components(crowd, chosen.select("node", "n", "sketch"), near, lambda pairs: confirmed(pairs, sets, plan), refine, exact)
    if stars is None:
        stars = nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    roots = nodes.select("node", "least_id").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(roots.join(roots.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "component_id").where("component_id IS NOT NULL"))
    out = dealt_join(signed.select("doc_id", "body", "n_shingles", "node"), named, "node", "left").select("l.doc_id", "l.body", "l.n_shingles", F.when(F.col("l.node").isNull(), F.col("l.doc_id")).otherwise(F.col("r.component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs, with all columns, less those that another document of their component stands for."""
    return without(docs, near_duplicates(docs, plan).where("NOT kept"))
