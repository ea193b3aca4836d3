"""Documents and nested rows stay whole when arrays are cut at a few elements."""

from functools import partial

import duckdb
import pytest
from check_queries import compare_frame
from conftest import DATA

from tableloom.operators import documents, graph, nesting
from tableloom.plans import load, structures
from tableloom.plans.registry import SCHEMAS, Tables

QUERIES = load()


@pytest.mark.parametrize(
    "name",
    ["t3_embedded_array", "t4_nested_embedding", "t8_orders_collection", "t9_order_lines_collection", "t10_suppliers_collection",
     "t11_people_collection", "t14_unnested_rows", "src4_document_round_trip", "s3_refreshed_documents"],
)
def test_cut_documents_hold_every_row(spark, monkeypatch, name):
    cut = partial(documents.build_collection, max_items=8, repeat_items=3)
    monkeypatch.setattr(structures.D, "build_collection", cut)
    con = duckdb.connect()
    for table in SCHEMAS:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ok, note = compare_frame(QUERIES[name].run(Tables(spark, DATA)), QUERIES[name], con)
    assert ok, note


def test_cut_bucketed_documents_hold_every_row(spark, monkeypatch):
    cut = partial(documents.build_collection, max_items=8, repeat_items=3)
    monkeypatch.setattr(structures.D, "build_collection", cut)
    monkeypatch.setattr(structures.B, "build_collection", cut)
    con = duckdb.connect()
    for table in SCHEMAS:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    query = QUERIES["s3_bucketed_documents"]
    ok, note = compare_frame(query.run(Tables(spark, DATA)), query, con)
    assert ok, note


@pytest.mark.parametrize(
    "name", ["joi2_order_with_lines", "joi3_parts_with_suppliers", "joi4_customers_with_optional_orders", "joi5_multi_branch_include", "joi6_lines_in_line_order", "g9n_pattern_with_branches"]
)
def test_cut_includes_hold_every_row(spark, monkeypatch, name):
    collect = nesting.collect_children

    def cut(child, keys, name, fields=None, order=None, max_items=0, hot=None):
        return collect(child, keys, name, fields, order, max_items=2)

    monkeypatch.setattr(nesting, "collect_children", cut)
    monkeypatch.setattr(graph, "collect_children", cut)
    con = duckdb.connect()
    for table in SCHEMAS:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ok, note = compare_frame(QUERIES[name].run(Tables(spark, DATA)), QUERIES[name], con)
    assert ok, note


def test_cut_link_arrays_hold_every_row(spark):
    t = Tables(spark, DATA)
    link = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    args = (t("supplier").select("s_suppkey"), link, t("part"), {"s_suppkey": "l_suppkey"}, {"p_partkey": "l_partkey"}, "parts", ["p_partkey", "p_name"])
    whole = nesting.include_through_link(*args).exploded()
    cut = nesting.include_through_link(*args, max_items=16)
    assert cut.continuations is not None
    rows = cut.exploded()
    assert rows.exceptAll(whole).count() == 0 and whole.exceptAll(rows).count() == 0
