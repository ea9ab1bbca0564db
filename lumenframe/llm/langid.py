"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte n-grams of a text's words are hashed to buckets; the mean of the buckets' embeddings goes through a linear
layer and a softmax. Embeddings and layer are trained together by stochastic gradient descent in numpy. The
probabilities are calibrated by a temperature, and a score below a calibrated limit marks the prediction as
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Bytes of words: ASCII letters and all beyond ASCII; everything else parts words.
_CLASS = np.where((np.arange(256) >= 128) | np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]), np.arange(256), 32).astype(np.uint32)
_CLASS[65:91] += 32
_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the rows that the classifier is fitted on; they are chosen by a hash of doc_id, as many from
    each language as there are, up to equal shares. Their whole texts are used."""

    buckets: int = 1 << 13
    size: int = 16
    max_rows: int = 2000
    epochs: int = 12
    rate: float = 40.0
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return softmax((features @ self.embedding @ self.layer + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subword_shares(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """For each text the shares of its subwords (2 to 4 bytes, a word's edge counting as one) in the buckets."""
    n_docs = len(offsets) - 1
    counts = np.zeros(n_docs * buckets)
    c = _CLASS[data]
    n, doc = len(c), np.repeat(np.arange(n_docs), np.diff(offsets))
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    gram = c.copy()
    for size in (2, 3, 4):
        if n < size:
            break
        gram = (gram[:-1] << np.uint32(8)) | c[size - 1 :]
        last = n - size + 1
        ok = doc[:last] == doc[size - 1 :]
        if size == 2:
            ok &= (c[:last] != 32) | (c[1:] != 32)
        for i in range(1, size - 1):
            ok &= c[i : i + last] != 32
        slot = ((gram ^ np.uint32(size * 0x1F3D5B79 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> shift
        counts += np.bincount(doc[:last][ok] * buckets + slot[ok], minlength=n_docs * buckets)
    shares = counts.reshape(n_docs, buckets).astype(np.float32)
    return shares / np.maximum(1, shares.sum(axis=1, keepdims=True))


def _features(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in tokens.pieces(texts, 1 << 19):
        for a in range(0, hi - lo, 128):
            b = min(a + 128, hi - lo)
            own, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
            yield lo + a, lo + b, part, own, subword_shares(part, own, buckets)


def sample_features(docs: DataFrame, use: Column, s: Settings) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, shares) of at most s.max_rows rows. First only ids and languages are read, then the
    texts of the chosen rows are turned into features on the executors."""
    rows = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return []
    place = (F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)) * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("lang")), F.lit(0))
    ids = [r["doc_id"] for r in rows.where(F.col("lang").isin(list(sizes))).orderBy(place, "doc_id").limit(s.max_rows).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for _, _, _, _, x in _features(batch.column("text"), s.buckets):
                for row in x:
                    k = np.flatnonzero(row)
                    at.append(k.astype(np.int32).tobytes())
                    share.append(row[k].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["lang", "at", "share"])

    chosen = docs.where(use & F.col("lang").isin(list(sizes)) & F.col("doc_id").isin(ids)).select("text", "lang").limit(s.max_rows)
    found = chosen.mapInArrow(run, "lang string, at binary, share binary").collect()
    return sorted((r["lang"], bytes(r["at"]), bytes(r["share"])) for r in found)


def train(sample: list[tuple[str, bytes, bytes]], s: Settings) -> Model | None:
    if not sample:
        return None
    languages = sorted({x[0] for x in sample})
    index = {k: i for i, k in enumerate(languages)}
    features = np.zeros((len(sample), s.buckets), np.float32)
    for i, (_, at, share) in enumerate(sample):
        features[i, np.frombuffer(at, np.int32)] = np.frombuffer(share, np.float32)
    y = np.array([index[x[0]] for x in sample])
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    fit = order[len(y) // 5 :]
    m = Model(languages, rng.normal(0, 1 / s.size, (s.buckets, s.size)).astype(np.float32), np.zeros((s.size, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, 0.0)
    m.layer += rng.normal(0, 0.3, m.layer.shape).astype(np.float32)
    steps, step, batch = s.epochs * -(-len(fit) // 16), 0, 16
    for _ in range(s.epochs):
        mixed = rng.permutation(fit)
        for a in range(0, len(mixed), batch):
            rows = mixed[a : a + batch]
            x = features[rows]
            mean = x @ m.embedding
            p = softmax(mean @ m.layer + m.bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            rate = s.rate * (1 - step / steps)
            back = p @ m.layer.T
            m.layer -= (rate / 40) * (mean.T @ p)
            m.bias -= (rate / 400) * p.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            m.embedding[used] -= rate * (x[:, used].T @ back)
            step += 1
    if len(held):
        z = features[held] @ m.embedding @ m.layer + m.bias
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        m.temperature = float(min(np.geomspace(0.1, 10, 60), key=loss))
        p = softmax(z / m.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        # the least limit above which at most 1 in 200 of the calibration rows is wrong
        at = np.argsort(-top)
        wrong = np.cumsum(~right[at]) / np.arange(1, len(at) + 1)
        good = np.flatnonzero(wrong <= 0.005)
        m.reject_below = float(top[at[good[-1]]]) if len(good) else 1.0
    return m


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, use: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs.

    The model is fitted on rows of docs where use holds (all but every fifth by the CRC-32 of doc_id, unless given)
    and text and lang are not null. lang_pred is a learned language, or und for a text that is null or has no letter
    (score 0, rejected), and for all rows if nothing could be learned. Repeated rows get the same answer, an empty
    table gives no rows, columns other than doc_id, text and lang are ignored.
    """
    model = train(sample_features(docs, ~is_held_out(F.col("doc_id")) if use is None else use, settings), settings)
    # a plain tuple of arrays: an executor needs no copy of this package to read it
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)) if model else None)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value) if shared.value else None
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            texts = batch.column("text")
            for lo, hi, data, offsets, x in _features(texts, settings.buckets):
                p = m.probabilities(x) if m else np.zeros((hi - lo, 1))
                best = p.argmax(axis=1)
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                plain = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in range(hi - lo):
                    known = m is not None and (plain[i] or any(ch.isalpha() for ch in texts[lo + i].as_py() or ""))
                    names.append(m.languages[best[i]] if known else "und")
                    scores.append(float(p[i, best[i]]) if known else 0.0)
            refused = [s < (m.reject_below if m else 1.0) or s == 0.0 for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")
