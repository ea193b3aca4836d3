"""Every named query against its SQL on the smallest tables, and the shape of its plan."""

import duckdb
import pytest
from check_queries import compare_frame
from conftest import DATA

from tableloom.plans import load
from tableloom.plans.registry import SCHEMAS, Tables

QUERIES = load()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name].run(Tables(spark, DATA))
    ok, note = compare_frame(df, QUERIES[name], con)
    assert ok, note
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan


def test_every_query_has_sql():
    assert [n for n, q in QUERIES.items() if q.sql is None] == []


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = Tables(spark, DATA)
    plan = QUERIES["pre3_closed_range"].run(t)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThanOrEqual(l_shipdate" in plan
    plan = QUERIES["prj5_two_columns"].run(t)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    plan = QUERIES["s1_incremental_extract"].run(t)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(l_shipdate" in plan


@pytest.mark.parametrize("name", ["g2n_columns_at_any_depth", "g2n_node_labels", "t12_mapping_table", "e9e_undeclared_distance"])
def test_rows_of_much_work_are_dealt_to_all_partitions(spark, name):
    df = QUERIES[name].run(Tables(spark, DATA))
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
