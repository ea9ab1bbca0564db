"""Sharding, whitening and resampling against brute force, and on odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ALNUM_WORD, LOWER, odd_rows
from test_operators import SCHEMA as ODD

from lumenframe.llm import queries, resample, sharding, tokens, whitening


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def brute_shards(rows, shards):
    """rows: (doc_id, text, source). Positions by one big sort."""
    made = []
    for i, t, s in rows:
        b = (t or "").encode()
        crc = zlib.crc32(b)
        made.append((s is None, s or "", hashlib.md5(f"2024:{'' if i is None else i}:{crc}".encode()).hexdigest(), -1 if i is None else i, len(b) + 1, crc))
    made.sort()
    sources = Counter(m[:2] for m in made)
    seen, placed = Counter(), []
    for m in made:
        r = seen[m[:2]]
        seen[m[:2]] += 1
        placed.append(((r + 0.5) / sources[m[:2]], *m[:2], r, m))
    placed.sort()
    out, n = [], len(placed)
    for p, x in enumerate(placed):
        k = p * shards // n
        out.append((None if x[4][3] == -1 else x[4][3], None if x[1] else x[2], x[4][4], x[4][5], k, p - -(-k * n // shards)))
    return sorted(out, key=str)


def test_shards_by_brute_force(spark, docs, odd):
    crowd = spark.createDataFrame([(None, "same text", "hot")] * 700 + [(k, f"text {k}", f"s{k % 7}") for k in range(500)] + [(5, "text 5", "s5")] * 3, "doc_id long, text string, source string")
    for table in (docs.select("doc_id", "text", "source"), odd.select("doc_id", "text", "source"), crowd, crowd.limit(3)):
        rows = [tuple(r) for r in table.collect()]
        for shards in (16, 3):
            got = sharding.interleave(spark.createDataFrame(rows, table.schema), shards).select("doc_id", "source", "size", "text_crc32", "shard", "slot").collect()
            assert sorted(map(tuple, got), key=str) == brute_shards(rows, shards)


def test_shards_match_the_mixture(docs):
    placed = sharding.interleave(docs, 5).toPandas()
    counts = placed.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    each = placed.groupby(["source", "shard"], dropna=False).size().unstack(fill_value=0)
    assert (each.max(axis=1) - each.min(axis=1) <= 2).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in placed.groupby("shard"))


def test_shards_written(spark, odd, tmp_path):
    named = odd.withColumn("shard", F.lit("mine")).withColumn("key", F.lit(7)).withColumn("piece", F.lit(8))
    sharding.write_shards(named, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*named.columns, "slot"} and back.count() == odd.count()
    want = {(r["doc_id"], r["source"], r["size"], r["shard"], r["slot"]) for r in sharding.interleave(odd, 4).collect()}
    got = {(r["doc_id"], r["source"], len((r["text"] or "").encode()) + 1, r["shard"], r["slot"]) for r in back.collect()}
    assert got == want
    assert sharding.interleave(odd.limit(0)).count() == 0 == sharding.sharded(odd.limit(0)).count()


def brute_whitening(vectors, components=32):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    far = x * n - s
    v = (far / n).T @ (far / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return (far.astype(object) ** 2).sum(axis=1), (far / n) @ u / np.sqrt(e), e / np.trace(v)


def table_of(df, width):
    rows = df.toPandas().sort_values(["vec_id", "component"])
    return rows, rows.whitened.to_numpy().reshape(-1, width)


def test_whitening_by_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute_whitening(np.stack(table.orderBy("vec_id").toPandas().embedding))
    got, w = table_of(queries.op12_whiten(spark, sf_dir), 32)
    signs = np.sign((w * want[1]).sum(axis=0))
    assert np.abs(w - want[1] * signs).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(-1, 32)[:, 0] == want[0].astype(np.int64)).all()
    assert np.allclose(got.explained.to_numpy()[:32], want[2], rtol=1e-9) and (got.n == table.count()).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9
    again, w2 = table_of(whitening.whiten(table.repartition(7)), 32)
    assert (again.deviation.to_numpy() == got.deviation.to_numpy()).all() and np.abs(w - w2).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=3).tolist(), 1, "x") for k in range(40)]
    bad = [(100, None, 1, "x"), (101, [1.0, None, 2.0], 1, None), (102, [1.0, math.nan, 2.0], None, "x"), (103, [math.inf, 0.0, 0.0], 1, "x"), (104, [0.0, -math.inf, 0.0], 1, "x"), (105, [], 1, "x"), (106, [0.5, 0.5], 1, "x")]
    rows = [*good, *bad, good[3], (None, good[4][1], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 3 * 42 and set(got.component) == {1, 2, 3} and got.vec_id.isna().sum() == 3 and (got.vec_id == 3).sum() == 6 and not (got.vec_id >= 100).any()
    kept = np.array([r[1] for r in [*good, good[3], rows[-1]]], np.float32)
    assert sorted(set(got.deviation)) == sorted(set(brute_whitening(kept)[0].astype(np.int64)))
    # equal rows have no component; rows on a line have one
    flat = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<float>")
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id string, embedding array<float>")
    assert whitening.whiten(flat).count() == 0 == whitening.whiten(df.limit(0)).count()
    assert whitening.whiten(line).count() == 5 and dict(whitening.whiten(line).dtypes)["vec_id"] == "string"


def test_deviation_beyond_floats():
    x = np.array([[2**31, 0], [0, 2**31]], np.int64)
    model = whitening.Whitening(1, np.zeros(2, np.int64), np.eye(2), np.ones(2), 2.0)
    assert whitening.squares(x, model).tolist() == [2**62, 2**62]
    with pytest.raises(OverflowError):
        whitening.squares(x * 4, model)


def brute_resample(rows, items, plan):
    def runs(t):
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[p : p + k]).encode()) % plan.buckets for k in range(plan.shortest, plan.longest + 1) for p in range(len(w) - k + 1)]

    found = [(i, *runs(t)) for i, t in rows]
    s = Counter(b for *_, r in found for b in r)
    t = Counter(b for x in items for b in runs(x)[1])
    big, small = sum(s.values()) + plan.buckets, sum(t.values()) + plan.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in s}
    out = []
    for i, n, r in found:
        w = sum(gain[b] for b in r) // len(r) if r else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(r), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= plan.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: plan.percent * len(fit) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("plan", [resample.Plan(), resample.Plan(1, 3, 500, 30, 5), resample.Plan(2, 4, 97, 100, 0, "x")])
def test_resampling_by_brute_force(spark, docs, odd, sf_dir, plan):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    crowd = spark.createDataFrame([(None, "some words that stand for many " * 5)] * 5000 + [(k, f"other words {k} " * 9) for k in range(40)], "doc_id long, text string")
    for table in (docs, odd, crowd):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        got = resample.resample(table, bench, plan).select("doc_id", "n_features", "weight", "score", "rank").collect()
        want = brute_resample(rows, [r["text"] for r in bench.collect()], plan)
        assert sorted(map(tuple, got), key=str) == want


def test_resampled_rows(spark, odd, sf_dir):
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    named = odd.withColumn("weight", F.lit("w")).withColumn("rank", F.lit("r")).withColumn("score", F.lit("s"))
    plan = resample.Plan(percent=100, least_words=1)
    out = resample.drawn(named, bench, plan)
    assert set(out.columns) == set(named.columns)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 1 + sum(r["n_words"] > 0 for r in resample.resample(named, bench, plan).collect())))
    assert resample.resample(odd.limit(0), bench).count() == 0 == resample.drawn(odd.limit(0), bench).count()
    assert resample.resample(odd, bench.limit(0)).count() == odd.count()


def test_suffix_array():
    text = pa.array(["b a b a", "", "A b a c", "ba"], pa.large_string())
    _, _, data, offsets = next(tokens.pieces(text))
    ids, starts, ends, first = resample.word_ids(data, offsets)
    words = ["b", "a", "b", "a", "a", "b", "a", "c", "ba"]
    assert first.tolist() == [0, 4, 4, 8, 9] and [bytes(data[a:b]).decode().lower() for a, b in zip(starts, ends, strict=True)] == words
    left = np.repeat(first[1:], np.diff(first)) - np.arange(9)
    order, lcp = resample.suffix_array(ids, left, 3)
    suffix = [tuple(ids[p : p + min(3, left[p])].tolist()) for p in range(9)]
    assert [suffix[p] for p in order] == sorted(suffix)
    for k in range(1, 9):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert lcp[k] == next((j for j in range(3) if j >= len(a) or j >= len(b) or a[j] != b[j]), 3)


def test_same_as_sql(spark, duck, sf_dir):
    from lumenframe.llm.queries import oracle_sql

    for f in (queries.op11_shards, queries.op13_resample):
        ours, sql = f(spark, sf_dir).toPandas(), duck.execute(oracle_sql()[f.__name__]).df()
        assert sorted(ours.columns) == sorted(sql.columns)
        plain = lambda d: sorted(tuple("-" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in d[sorted(d.columns)].itertuples(index=False))
        assert plain(ours) == plain(sql)
