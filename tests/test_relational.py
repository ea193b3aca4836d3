import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableloom.operators import relational as R


def test_single_row_or_error(frame):
    df = frame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert R.single(df.filter("k = 1")).collect()[0]["v"] == "a"
    for k in (2, 3):
        with pytest.raises(Exception, match="expected exactly one order"):
            R.single(df.filter(F.col("k") == k), "order").collect()


def test_typed_values(spark):
    u = uuid.UUID("ABCDEF00-0000-0000-0000-000000000001")
    values = {
        "s": "it's \"x\" %_", "b": True, "t": dt.datetime(2020, 1, 2, 3, 4, 5, 6), "d": dt.date(2020, 1, 2),
        "m": dt.time(1, 2, 3, 4), "u": u, "x": b"\x00\x01", "p": Decimal("12.50"), "n": None,
    }
    row = R.run_sql(spark, "SELECT " + ", ".join(f":{k} AS {k}" for k in values), values)
    types = dict(row.dtypes)
    assert types["t"] == "timestamp_ntz" and types["p"] == "decimal(4,2)" and types["x"] == "binary"
    got = row.collect()[0]
    assert got["s"] == values["s"] and got["t"] == values["t"] and got["u"] == str(u) and got["n"] is None
    assert got["m"] == 3723000004 and got["p"] == Decimal("12.50") and bytes(got["x"]) == b"\x00\x01"


def test_long_value_list_becomes_a_semi_join(frame):
    df = frame([(i,) for i in range(50)] + [(None,)], "k bigint")
    values = list(range(10, 5000))
    got = R.in_list(df, "k", values)
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in got.collect()) == list(range(10, 50))
    rest = R.not_in_list(df, "k", values)
    assert sorted(r[0] for r in rest.collect()) == list(range(10))


def test_long_value_lists_compare_in_their_own_type_and_keep_the_columns(frame):
    df = frame([(i, i, "v") for i in range(10)], "n int, k bigint, v string")
    halves = [i + 0.5 for i in range(1200)]
    assert R.in_list(df, "k", halves).count() == 0 and R.not_in_list(df, "k", halves).count() == 10
    got = R.in_list(df, "k", [float(i) for i in range(3, 1500)])
    assert got.columns == ["n", "k", "v"] and sorted(r["k"] for r in got.collect()) == list(range(3, 10))
    assert R.not_in_list(df, "k", list(range(5, 1500))).columns == ["n", "k", "v"]


def test_not_in_with_a_null_leaves_nothing(frame):
    df = frame([(1,), (2,), (None,)], "k int")
    assert R.not_in_list(df, "k", [2, None]).count() == 0
    assert [r[0] for r in R.not_in_list(df, "k", [2]).collect()] == [1]
    assert [r[0] for r in R.in_list(df, "k", [2, None]).collect()] == [2]


def test_text_search_is_literal(frame):
    df = frame([("50% off",), ("50 off",), ("C++ x",), ("c++ y",)], "v string")
    assert [r[0] for r in df.filter(R.contains_text(F.col("v"), "50%")).collect()] == ["50% off"]
    assert [r[0] for r in df.filter(R.contains_text(F.col("v"), "C++")).collect()] == ["C++ x"]
    assert df.filter(R.contains_text(F.col("v"), "C++", ignore_case=True)).count() == 2


def test_offset_and_keyset_pages_agree(frame):
    df = frame([(i, i % 3) for i in range(100)], "k int, v int")
    page = [r["k"] for r in R.page(df, 40, 10, "k").collect()]
    assert page == list(range(40, 50))
    assert [r["k"] for r in R.page_after(df, "k", 39, 10).collect()] == page


def test_sort_puts_nulls_first_on_asc(frame):
    df = frame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in R.sort(df, "k").collect()] == [None, 1, 2]
    assert [r[0] for r in R.sort(df, ("k", "desc")).collect()] == [2, 1, None]


def test_join_kinds(frame):
    a = frame([(1,), (2,)], "a int")
    b = frame([(2,), (3,)], "b int")
    sizes = {k: R.equi_join(a, b, ("a", "b"), k).count() for k in ("inner", "left", "right", "full")}
    assert sizes == {"inner": 1, "left": 2, "right": 2, "full": 3}


def test_set_operations_keep_or_drop_copies(frame):
    a = frame([(1,), (1,), (1,), (2,), (None,)], "x int")
    b = frame([(1,), (3,), (None,)], "y int")
    rows = lambda df: sorted((r[0] is None, r[0] or 0) for r in df.collect())
    val = lambda *v: sorted((x is None, x or 0) for x in v)
    assert rows(R.union(a, b)) == val(1, 2, 3, None)
    assert rows(R.union_all(a, b)) == val(1, 1, 1, 2, None, 1, 3, None)
    assert rows(R.intersect(a, b)) == val(1, None)
    assert rows(R.except_distinct(a, b)) == val(2)
    assert rows(R.except_all(a, b)) == val(1, 1, 2)


def test_count_of_column_and_of_rows(frame):
    df = frame([(1, None), (1, 2), (2, None)], "k int, v int")
    row = df.agg(R.aggregate("count", "*").alias("n"), R.aggregate("COUNT", "v").alias("c")).collect()[0]
    assert (row["n"], row["c"]) == (3, 1)


def test_first_per_key_and_ends(frame):
    df = frame([(1, 5, "b"), (1, 3, "a"), (2, 9, "c")], "k int, o int, v string")
    assert sorted(r["v"] for r in R.first_per_key(df, ["k"], ["o"]).collect()) == ["a", "c"]
    ends = R.first_and_last(df, "o").collect()[0]
    assert (ends["first_row"]["v"], ends["last_row"]["v"]) == ("a", "c")
