"""Tables whose last frames lack lines and whose texts are short or absent, against the SQL of the queries."""

import duckdb
import pytest
from test_queries import normal

from lumenframe.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
FRAMES = "q_bayer_bilinear q_crop q_decode_full q_fused_bayer_yuv420 q_xtrans_demosaic q_fused_xtrans q_warp_bicubic q_demosaic_warp q_demosaic_warp_rgb q_opcode3_pixels".split()
TEXTS = ["q_probe_raw", "q_tiff_ifd_walk"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    # a whole frame, one of six lines, of one, without its last, with a gap, only the middle, without single lines
    some = "vec_id // 50 = 0 OR vec_id // 50 = 1 AND vec_id % 50 < 6 OR vec_id = 100 OR vec_id // 50 = 3 AND vec_id % 50 < 49 OR vec_id // 50 = 4 AND vec_id % 50 NOT BETWEEN 9 AND 13 OR vec_id // 50 = 5 AND vec_id % 50 BETWEEN 20 AND 40 OR vec_id // 50 = 6 AND vec_id % 50 NOT IN (24, 25, 30)"
    con.execute(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' WHERE {some}) TO '{folder}/embeddings.parquet'")
    con.execute(f"COPY (SELECT * FROM '{DATA}/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    con.execute(f"COPY (SELECT d.* REPLACE (CASE WHEN doc_id < 40 THEN substr('a b', 1, CAST(doc_id % 4 AS INT)) WHEN doc_id < 80 THEN NULL ELSE text END AS text) FROM '{DATA}/documents.parquet' d) TO '{folder}/documents.parquet'")
    for t in ("embeddings", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", FRAMES + TEXTS)
def test_same_as_sql(spark, odd, name):
    folder, con = odd
    ours, theirs = normal(all_queries()[name](spark, folder).toPandas()), normal(con.execute(all_sql()[name]).df())
    assert ours.equals(theirs)
