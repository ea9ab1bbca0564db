"""Benchmark decontamination with suffix arrays of the training texts.

The documents are cut into shards of bounded size. A shard's suffix array lists, in lexicographic order,
the word suffixes that can hold a benchmark window: words outside the benchmark's vocabulary end every
match, so a suffix in front of such a word is left out when it is too short. Every benchmark suffix is
binary-searched in every shard; matches on one diagonal are joined to the longest verbatim passages, with
their places in the document and in the item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens


@dataclass
class TestSuffixes:
    """A block of benchmark items. words: sorted hashes of its vocabulary (a word's id is its index + 1).
    keys: distinct windows as bytes (big-endian ids), padded with zeros to the full window; lengths: their
    words. uses: for window k the rows first[k]:first[k+1] of (item, place), the items that hold it."""

    window: int
    items: list[str]
    words: np.ndarray
    keys: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    use_item: np.ndarray
    use_place: np.ndarray


def _key_bytes(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort like the rows."""
    rows = np.ascontiguousarray(ids.astype(">u4"))
    return rows.view(f"S{4 * ids.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{4 * ids.shape[1]}")


def test_suffixes(items: list[tuple[str, str | None]], window: int) -> TestSuffixes:
    texts = pa.array([t for _, t in items], pa.large_string())
    hashes: list[np.ndarray] = []
    for lo, hi, data, offsets in tokens.pieces(texts):
        w = tokens.split_words(data, offsets, tokens.ALNUM)
        hashes += [w.hashes[w.first[i] : w.first[i + 1]] for i in range(hi - lo)]
    words = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    rows, lengths, owners, places = [], [], [], []
    for k, h in enumerate(hashes):
        if not len(h):
            continue
        ids = np.searchsorted(words, h) + 1
        size = min(window, len(ids))
        for p in range(len(ids) - size + 1):
            rows.append(np.pad(ids[p : p + size], (0, window - size)))
            lengths.append(size)
            owners.append(k)
            places.append(p)
    if not rows:
        return TestSuffixes(window, [i for i, _ in items], words, _key_bytes(np.zeros((0, window))), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, group = np.unique(_key_bytes(np.array(rows)), return_inverse=True)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(len(keys) + 1))
    size_of = np.zeros(len(keys), np.int64)
    size_of[group] = lengths
    return TestSuffixes(window, [i for i, _ in items], words, keys, size_of, first, np.array(owners)[order], np.array(places)[order])


def _upper_bounds(test: TestSuffixes) -> np.ndarray:
    """The keys with their unused places set to the largest id: an upper bound of all suffixes that start so."""
    wide = np.frombuffer(test.keys.tobytes().ljust(len(test.keys) * 4 * test.window, b"\0"), ">u4").reshape(-1, test.window).copy()
    wide[np.arange(test.window)[None, :] >= test.lengths[:, None]] = 0xFFFFFFFF
    return _key_bytes(wide)


def search_shard(ids: np.ndarray, test: TestSuffixes, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the shard, window) of every occurrence. ids: word ids, 0 where no match can pass."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    if not n or not len(test.keys):
        return none, none
    stops = np.flatnonzero(ids == 0)
    reach = np.append(stops, n)[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    shortest = int(test.lengths.min())
    places = np.flatnonzero(reach >= shortest)
    if not len(places):
        return none, none
    steps = np.arange(test.window)
    at = places[:, None] + steps[None, :]
    rows = np.where(steps[None, :] < reach[places][:, None], ids[np.minimum(at, n - 1)], 0)
    suffixes = _key_bytes(rows)
    order = np.argsort(suffixes, kind="stable")
    array = suffixes[order]
    lo, hi = np.searchsorted(array, test.keys, "left"), np.searchsorted(array, upper, "right")
    count = hi - lo
    hit = np.flatnonzero(count)
    if not len(hit):
        return none, none
    spread = np.repeat(lo[hit] - np.cumsum(count[hit]) + count[hit], count[hit]) + np.arange(count[hit].sum())
    return places[order[spread]], np.repeat(hit, count[hit])


def _blocks(benchmark: DataFrame, max_block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        block.append((r["item_id"] or "", r["text"]))
        size += len(r["text"] or "")
        if size >= max_block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, carry: tuple[str, ...] = ("doc_id",), shard_bytes: int = 1 << 20, max_block_bytes: int = 1 << 22) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of its longest
    verbatim match longest_words, longest_item, longest_doc_word, longest_item_word (null without a match).

    A document is contaminated if words are hit and share * n_hit >= n_words. The benchmark is read once in
    blocks of max_block_bytes characters; each block is broadcast by itself and a task holds one at a time,
    so a task's memory is bounded by a block and a shard however large either table grows (an executor keeps all blocks,
    in memory or on disk, as Spark does with broadcasts). Very long texts are a shard of their own. A null or empty text has no
    words and no hits; a null or empty item has no windows; a null item_id counts as the empty string and
    repeated items as one item_id. Equal longest matches: the first in the document, then the smallest
    item_id. Repeated documents are judged each for itself, an empty table gives no rows. carry: the columns of
    docs that pass through (one named like a new column gives way); others are ignored.
    """
    sc = docs.sparkSession.sparkContext
    # plain tuples of arrays: an executor needs no copy of this package to read them
    shared = [sc.broadcast(tuple(getattr(t, f.name) for f in fields(t))) for t in (test_suffixes(b, window) for b in _blocks(benchmark, max_block_bytes))]

    def judge_shard(data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        words = tokens.split_words(data, offsets, tokens.ALNUM)
        first, n_docs = words.first, len(offsets) - 1
        n = len(words.hashes)
        hit = np.zeros(n + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(n_docs)]
        best: list[tuple | None] = [None] * n_docs
        doc_of = np.repeat(np.arange(n_docs), np.diff(first))
        for b in shared:
            # several blocks are read from the executor's copy by turns, so that a task holds one
            test = TestSuffixes(*(b.value if len(shared) == 1 or not getattr(b, "_path", None) else b.load_from_path(b._path)))
            if not len(test.keys):
                continue
            at = np.searchsorted(test.words, words.hashes)
            known = test.words[np.minimum(at, len(test.words) - 1)] == words.hashes
            ids = np.where(known, at + 1, 0)
            # a stop after every text keeps matches inside it
            stops = np.zeros(n + n_docs, np.int64)
            own = np.arange(n) + doc_of
            stops[own] = ids
            back = np.full(n + n_docs, -1, np.int64)
            back[own] = np.arange(n)
            places, window_of = search_shard(stops, test, _upper_bounds(test))
            if not len(places):
                continue
            places = back[places]
            sizes = test.lengths[window_of]
            np.add.at(hit, places, 1)
            np.add.at(hit, places + sizes, -1)
            uses = test.first[window_of + 1] - test.first[window_of]
            use = np.repeat(test.first[window_of] - np.cumsum(uses) + uses, uses) + np.arange(uses.sum())
            p, size = np.repeat(places, uses), np.repeat(sizes, uses)
            item, q = test.use_item[use], test.use_place[use]
            doc = doc_of[p]
            for d, i in np.unique(np.stack([doc, item], 1), axis=0):
                items[d].add(test.items[i])
            # consecutive windows on one diagonal of one document and item make one passage
            order = np.lexsort((p, p - q, item, doc))
            p, q, item, doc, size = p[order], q[order], item[order], doc[order], size[order]
            opens = np.ones(len(p), bool)
            opens[1:] = (np.diff(p) != 1) | (np.diff(q) != 1) | (np.diff(item) != 0) | (np.diff(doc) != 0)
            heads = np.flatnonzero(opens)
            tails = np.append(heads[1:], len(p)) - 1
            for h, t in zip(heads, tails, strict=True):
                d = doc[h]
                found = (-int(p[t] - p[h] + size[t]), int(p[h] - first[d]), test.items[item[h]], int(q[h]))
                if best[d] is None or found < best[d]:
                    best[d] = found
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)]) if n else np.zeros(1, np.int64)
        out = []
        for d in range(n_docs):
            size, hits = int(first[d + 1] - first[d]), int(covered[first[d + 1]] - covered[first[d]])
            longest = (-best[d][0], best[d][2], best[d][1], best[d][3]) if best[d] else (None,) * 4
            digest = hashlib.sha256(",".join(sorted(items[d])).encode()).hexdigest()
            out.append((size, hits, len(items[d]), digest, hits > 0 and share * hits >= size, *longest))
        return out

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_item", "longest_doc_word", "longest_item_word"]

    passed = [c for c in carry if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for _, _, data, offsets in tokens.pieces(batch.column("text"), shard_bytes):
                rows += judge_shard(data, offsets)
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*passed, *names])

    before = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed]
    schema = ", ".join(before) + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item string, longest_doc_word long, longest_item_word long"
    return docs.select(*dict.fromkeys([*passed, "text"])).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns and whatever their names, that are not contaminated.

    A null or empty text has no words and stays, as do repeated rows of a clean document; an empty table gives no rows.
    """
    other = {c: f"__in_{k}" for k, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in other.items()])
    judged = contamination(renamed, benchmark, carry=("text", *other.values()), **options).where("NOT contaminated")
    return judged.select(*[F.col("text") if c == "text" else F.col(other[c]).alias(c) for c in docs.columns])
