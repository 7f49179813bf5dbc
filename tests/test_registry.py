import re

import duckdb
import pytest

import __spark_entry__ as entry
from larkspan.registry import Tables, load_all
from tools.check import NAMES, rows_of

SMOKE = [
    "facet_counts", "merge_feeds", "match_files", "evict_plan", "drop_repeats", "proximity_anti", "fallback_tiers", "gap_nearest_centre", "communities", "active_requests",
]


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 190
    assert not [n for n in load_all() if re.match(r"op\d|.*pipeline", n)]


def test_flagship(spark, data):
    rows = entry.load_all()[entry.FLAGSHIP].run(Tables(spark, data)).collect()
    assert rows and {"category", "n"} == set(rows[0].asDict())


@pytest.mark.parametrize("name", SMOKE)
def test_query_equals_its_sql(spark, data, name):
    q = load_all()[name]
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"create view {n} as select * from '{data}/{n}.parquet'")
    df = q.run(Tables(spark, data))
    rel = con.execute(q.sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in rel.description], rel.fetchall())


def test_first_valid_method_ranks_large_part_keys_and_ties(spark, tmp_path):
    """A part key above a million does not outweigh the line number; lines that share both go by date."""
    rows = [(1, 1, 2_500_000, "R", 9), (1, 2, 5, "R", 3), (2, 1, 7, "R", 8), (2, 1, 7, "R", 4), (2, 1, 7, "R", 6), (3, 1, 1, "A", 1), (4, 1, 1, "A", 1), (4, 3, 1, "R", 2)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, day int"
    table = spark.createDataFrame(rows, cols).selectExpr("* except (day)", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, day) as l_shipdate")
    table.repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    q = load_all()["first_valid_method"]
    got = {r.l_orderkey: r.shipped and r.shipped.day for r in q.run(Tables(spark, str(tmp_path))).collect()}
    assert got == {1: 10, 2: 5, 3: None, 4: 3}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert {k: v and v.day for k, v in con.execute(q.sql).fetchall()} == got
