"""Opcode plans against the query's SQL where places are missing, repeated or shared."""

import __spark_entry__
from lumenframe.operators import contracts

LINES = [
    (1, 1, 0), (1, None, 1), (1, 2, 2),
    (2, 1, None), (2, 2, 3), (2, 3, 4),
    (None, 1, 1), (None, None, 3), (None, 2, 2),
    (3, 1, -1), (3, 2, -3), (3, -2, 4), (3, 2, -3),
    (4, 1, 5), (4, 1, 5), (4, 2, 7),
]


def test_missing_places_come_last_as_in_sql(spark, duck, tmp_path):
    columns = "l_orderkey bigint, l_linenumber int, l_partkey bigint"
    spark.createDataFrame(LINES, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = con.execute(__spark_entry__.oracle_sql()["q_opcode3_apply"]).fetchall()
    got = __spark_entry__.queries()["q_opcode3_apply"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_neighbours_of_one_place_are_merged(spark):
    """Whatever way the rows of one place are given, the plan is that of one order."""
    rows = [(f, 1, 3) for f in range(4)] + [(f, 2, op) for f in range(4) for op in ([8, 3], [3, 8])[f % 2]] + [(f, 3, 8) for f in range(4)]
    got = contracts.opcode_order(spark.createDataFrame(rows, "frame_id int, place int, opcode int")).collect()
    assert {r["plan"] for r in got} == {"other>polynomial"}
