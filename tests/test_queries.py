import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from gaugework import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(columns), sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    result = oracle.execute(queries.ORACLE[name])
    assert got == plain(result.fetchall(), [d[0] for d in result.description])


def test_casts_to_whole_numbers_round_as_the_sql_does(spark, tmp_path):
    prices = [32767.0, 32767.4, 32767.5, 32767.9, 32768.0, -32768.4, -32768.5, -32768.9, 1e300, math.nan, math.inf, 0.5, None]
    spark.createDataFrame([(p,) for p in prices], "l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([("abc",), (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("click",), ("search",)], "event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in queries.cast_losses(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.ORACLE["cast_losses"]).fetchall()) and ("lineitem.l_extendedprice", "smallint", 8) in got


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.verdict for r in rows} == {"FAIL"} and "RS-DATA-014" in {r.code for r in rows}


def test_every_query_has_a_name_of_its_own():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    plan = queries.range_numeric(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
    plan = queries.fanout_orders_by_customer(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint>" in plan and "IsNotNull(o_custkey)" in plan
