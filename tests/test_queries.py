"""Every query with a SQL counterpart gives the same rows as that SQL in another engine."""

import pandas as pd
import pytest

from lumenframe.plans import all_queries, all_sql


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6).map(lambda x: "null" if pd.isna(x) else repr(float(x) + 0.0))
        else:
            df[c] = df[c].map(lambda x: "null" if x is None or x is pd.NA or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    ours, theirs = normal(all_queries()[name](spark, sf_dir).toPandas()), normal(duck.execute(all_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_comparison_can_fail(spark, duck, sf_dir):
    """A perturbed row must be seen."""
    ours = normal(all_queries()["q_counters"](spark, sf_dir).toPandas())
    theirs = normal(duck.execute(all_sql()["q_counters"]).df())
    theirs.loc[0, "records"] = "-1"
    assert not ours.equals(theirs)


def test_streams_agree_with_batch(spark, sf_dir):
    q = all_queries()
    a = normal(q["q_stream_generation"](spark, sf_dir).toPandas())
    assert a.equals(normal(q["q_batch_generation"](spark, sf_dir).toPandas()))
    live, batch = q["q_stream_idle_shrink"](spark, sf_dir).toPandas(), q["q_idle_shrink"](spark, sf_dir).toPandas()
    assert 0 < len(live) <= len(batch)  # sessions behind the last watermark are still open


def test_buffer_pool_counts_every_request(spark, sf_dir):
    r = all_queries()["q_buffer_pool"](spark, sf_dir).toPandas()
    assert (r.n == r.reused + r.grown + r.evicted + r.waited + r.unpooled).all()
    assert (r.grown <= 4).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_probe_rules(spark):
    """The first known brand decides; under 12 bytes nothing is known; of a repeated key the last value counts."""
    from pyspark.sql import functions as F

    from lumenframe.sources import probe

    box = lambda major, *brands: "0000002C" + f"ftyp{major}".encode().hex().upper() + "00000000" + "".join(b.encode().hex().upper() for b in brands) + "00" * 20
    rows = [box("mif9", "heic", "avif"), box("mif9", "avif", "heic"), box("mif1", "avif"), box("avis", "heic"), box("zzzz", "qt  ", "mp41", "isom", "zzzz", "avif"), "FFD8FFE0", "FFD8FFE0" + "00" * 8, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, h string")
    got = [r[0] for r in df.orderBy("k").select(probe.still_format(F.col("h"))).collect()]
    assert got == ["heic", "avif", "heic", "avif", "heic", "unknown", "jpeg", "unknown"]
    assert not any(r[0] for r in df.select(probe.has_tag(F.col("h"), probe.DNG_VERSION_TAG)).collect())
    lines = spark.createDataFrame([("x a=1 b=2 a=3 c d==",), ("",)], "line string").select(probe.key_values(F.col("line")).alias("m")).collect()
    assert [r["m"] for r in lines] == [{"a": "3", "b": "2", "d": "="}, {}]
