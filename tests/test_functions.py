import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableloom.functions import canonical as K
from tableloom.functions import jsontext as J
from tableloom.functions import leaves
from tableloom.functions import names as N
from tableloom.functions import units as U
from tableloom.operators import conformance as C


@pytest.mark.parametrize(
    "name, want",
    [
        ("OrderID", "orderId"), ("WebsiteURL", "websiteUrl"), ("URLValue", "urlValue"), ("Name", "name"), ("already", "already"),
        ("ID", "id"), ("IsOnSupplier", "isOnSupplier"), ("URL", "url"), ("", ""), ("ABTest", "abTest"), ("A1", "a1"),
    ],
)
def test_camel_case(name, want):
    assert N.camel_case(name) == want


def test_rename_reaches_nested_fields(spark):
    df = spark.sql("SELECT 1 AS OrderID, named_struct('LineID', 2, 'Tags', array(named_struct('TagURL', 'x'))) AS Line")
    got = N.rename_deep(df)
    assert got.columns == ["orderId", "line"]
    assert got.select("line.lineId", F.col("line.tags")[0]["tagUrl"].alias("u")).collect()[0] == (2, "x")


def test_singular(frame):
    words = {"Cities": "City", "Orders": "Order", "Address": "Address", "ies": "ie", "s": "s", "People": "People", "": ""}
    df = frame([(w,) for w in words], "w string")
    assert {r["w"]: r["x"] for r in df.select("w", N.singular(F.col("w")).alias("x")).collect()} == words


def test_duplicate_columns_get_ordinals(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS a, 3 AS b")
    assert N.ordinal_columns(df).columns == ["0__a", "1__a", "2__b"]


def test_quantities(frame):
    df = frame([("808.9 μs",), ("525,861.8 μs",), ("690.0 ns",), ("NA",), ("",), (None,), ("1.5 s",), ("3 parsecs",)], "v string")
    got = [r[0] for r in df.select(U.nanoseconds(F.col("v"))).collect()]
    assert got == [Decimal("808900"), Decimal("525861800"), Decimal("690"), None, None, None, Decimal("1500000000"), None]
    sizes = frame([("14.05 KB",), ("1104 B",), ("2 MB",)], "v string")
    assert [float(r[0]) for r in sizes.select(U.size_bytes(F.col("v"))).collect()] == [14387.2, 1104.0, 2097152.0]


def test_timestamp_texts(frame):
    df = frame([("2014-12-20 11:00:00.0",), ("2014-12-20 11:00:00.5+01:00",), ("2014-12-20",), ("2014-13-20",), ("2014-12-20 11:00:00",)], "v string")
    rows = df.select(
        F.unix_millis(U.text_to_timestamp(F.col("v"))).alias("t"), U.text_to_date(F.col("v")).alias("d")
    ).collect()
    base = 1419073200000
    assert [r["t"] for r in rows] == [base, base - 3600000 + 500, None, None, None]
    assert [r["d"] for r in rows] == [None, None, dt.date(2014, 12, 20), None, None]


def test_json_text(frame):
    df = frame([('["Slovak", "Czech"]',), ("[]",), ("",), ("  ",), (None,), ("broken",)], "v string")
    assert [r[0] for r in df.select(J.array_has(F.col("v"), "Slovak")).collect()] == [True, False, False, False, False, False]
    obj = frame([('{"Title":"Team Member","OtherLanguages":["a"],"HireDate":"2014-01-02T00:00:00"}',), ("",)], "v string")
    parsed = obj.select(J.parse_object(F.col("v"), "Title string, OtherLanguages array<string>, HireDate timestamp").alias("p"))
    rows = parsed.collect()
    assert rows[0]["p"]["Title"] == "Team Member" and rows[0]["p"]["OtherLanguages"] == ["a"] and rows[1]["p"] is None


def test_three_decimals_half_up(frame):
    df = frame([(2.0005,), (-2.0005,), (0.0004999,), (1e30,), (None,)], "v double")
    got = [r[0] for r in df.select(K.canonical_number(F.col("v")).cast("string")).collect()]
    assert got == ["2.001", "-2.001", "0.000", "1000000000000000000000000000000.000", None]


def test_canonical_json(spark):
    df = spark.sql(
        "SELECT 7 AS OrderID, timestamp_ntz'2014-12-20 11:00:00.1239' AS PickedWhen, date'2014-12-20' AS Day, "
        "cast(1.5 AS decimal(10,2)) AS Price, cast(NULL AS string) AS Note, array(3.0D, 1.0D) AS List, 'drop' AS _id"
    )
    text = df.select(K.canonical_json(df, drop=("_id",))).collect()[0][0]
    assert text == (
        '{"day":"2014-12-20T00:00:00.000Z","list":[3.000,1.000],"note":null,"orderId":7,'
        '"pickedWhen":"2014-12-20T11:00:00.123Z","price":1.500}'
    )
    assert '"list":[1.000,3.000]' in df.select(K.canonical_json(df, sort_arrays=True)).collect()[0][0]


def test_zone_option(spark):
    df = spark.sql("SELECT timestamp_ntz'2014-07-20 13:00:00' AS t")
    assert df.select(K.canonical_time(F.col("t"), "Europe/Prague")).collect()[0][0] == "2014-07-20T11:00:00.000Z"


def hashes(df, **kw):
    return [r[0] for r in df.select(K.row_hash(df, **kw)).collect()]


def test_row_hash_follows_the_canonical_form(spark, frame):
    values = ["2.0005", "-2.0005", "0", "-0.0004", "123456789.125", "8999999999.9995", "9000000000.001", "99999999999.5"]
    doubles = frame([(float(v),) for v in values], "Amount double")
    decimals = frame([(Decimal(v),) for v in values], "Amount decimal(24,6)")
    assert hashes(doubles) == hashes(decimals)
    other = frame([(float(v) + 0.001,) for v in values], "Amount double")
    assert all(a != b for a, b in zip(hashes(doubles), hashes(other)))


def test_row_hash_tells_nulls_names_and_kinds_apart(frame):
    a, b = hashes(frame([(None, "x"), ("x", None)], "a string, b string"))
    assert a != b
    assert hashes(frame([(1,)], "a bigint")) != hashes(frame([(1,)], "b bigint"))
    assert hashes(frame([(1,)], "a bigint")) == hashes(frame([(1,)], "A int"))
    nan, null = hashes(frame([(float("nan"),), (None,)], "a double"))
    assert nan != null


def test_row_hash_ignores_list_order_but_not_copies(spark):
    def one(sql):
        return hashes(spark.sql(f"SELECT {sql} AS v"))[0]

    assert one("array(1, 2, 2)") == one("array(2, 1, 2)") != one("array(1, 2)")
    assert one("array(array(1), array(2))") != one("array(array(1, 2))")


@pytest.mark.parametrize(
    "name, want",
    [("int", "int"), ("tinyint", "smallint"), ("decimal(18, 4)", "decimal(18,4)"), ("NUMERIC", "decimal(18,2)"), ("money", "decimal(19,4)"),
     ("nvarchar(50)", "string"), ("datetime2(7)", "timestamp_ntz"), ("decimal(9)", "decimal(9,0)")],
)
def test_database_types(name, want):
    assert C.spark_type(name) == want


def test_unknown_database_type():
    with pytest.raises(ValueError):
        C.spark_type("hyperint")


def test_conformance_counts(frame):
    child = frame([(1, 99.95, "a", 1), (1, 1.5, None, 2), (3, 1234.0, "long", None), (4, 12.25, "b", 7)], "k int, d double, s string, f int")
    parent = frame([(1,), (2,)], "id int")
    rule = C.TableRule(
        "child", (C.ColumnRule("d", "decimal(3,1)"), C.ColumnRule("s", required=True, max_length=3)), ("k",), {"f": ("parent", "id")}
    )
    got = {(r["rule"], r["column"]): r["violations"] for r in C.conformance({"child": child, "parent": parent}, [rule]).collect()}
    # 99.95 and 12.25 lose digits, 1234 does not fit.
    assert got == {("type", "d"): 3, ("required", "s"): 1, ("length", "s"): 1, ("unique", "k"): 1, ("foreign key", "f"): 1}


def test_each_value_of_a_sample_is_opened_once(frame):
    # A column that is named twice in a function over elements is worked out twice, and doubles again at each level.
    df = frame([('{"a": {"b": [1, "x"]}}',)], "j string").select(leaves.leaves(leaves.parse(F.col("j"))).alias("l"))
    assert df._jdf.queryExecution().analyzed().toString().count("variant_get") <= 6
    assert df.first()["l"] == {"a.b": "[1.000,x]"}
