import json

import pytest
from pyspark.sql import functions as F

from tableloom.operators import equivalence as E
from tableloom.operators import summary as S

SCHEMA = "id int, amount decimal(38,3), lines array<struct<n:int,p:decimal(38,3)>>"


def payload(count, first, last=None):
    return json.dumps({"count": count, "firstSample": first, "lastSample": last})


def verdict(frame, source, target, **kw):
    rows = lambda d: [(k, v) for k, v in d.items()]
    got = E.compare_summaries(
        frame(rows(source), "query_id string, payload string"), frame(rows(target), "query_id string, payload string"), SCHEMA, **kw
    )
    return {r["query_id"]: r for r in got.collect()}


A = {"id": 1, "amount": 1.5, "lines": [{"n": 1, "p": 2.0}, {"n": 2, "p": 3.0}]}
B = {"id": 9, "amount": 7.0, "lines": []}


def test_identical_single_row(frame):
    got = verdict(frame, {"query1": payload(1, A)}, {"query1": payload(1, A)})
    assert got["query1"]["status"] == E.EQUIVALENT


def test_swapped_samples(frame):
    source, target = {"q": payload(2, A, B)}, {"q": payload(2, B, A)}
    assert verdict(frame, source, target)["q"]["status"] == E.EQUIVALENT
    strict = verdict(frame, source, target, allow_swap=False)["q"]
    assert strict["status"] == E.DIFFERENT
    assert {d["path"] for d in strict["first_diffs"]} == {"id", "amount", "lines"}


def test_count_differs_without_last_sample(frame):
    got = verdict(frame, {"q": payload(1, A)}, {"q": payload(2, A)})["q"]
    assert (got["status"], got["count_old"], got["count_new"]) == (E.DIFFERENT, 1, 2)
    assert got["first_diffs"] == [] and got["last_diffs"] == []


def test_lists_are_order_free_but_copies_count(frame):
    turned = {**A, "lines": A["lines"][::-1]}
    assert verdict(frame, {"q": payload(1, A)}, {"q": payload(1, turned)})["q"]["status"] == E.EQUIVALENT
    doubled = {**A, "lines": A["lines"] + A["lines"][:1]}
    got = verdict(frame, {"q": payload(1, A)}, {"q": payload(1, doubled)})["q"]
    assert got["status"] == E.DIFFERENT and [d["path"] for d in got["first_diffs"]] == ["lines"]


def test_three_decimals_count(frame):
    near, far = {**A, "amount": 1.5004}, {**A, "amount": 1.501}
    assert verdict(frame, {"q": payload(1, A)}, {"q": payload(1, near)})["q"]["status"] == E.EQUIVALENT
    got = verdict(frame, {"q": payload(1, A)}, {"q": payload(1, far)})["q"]
    assert [tuple(d) for d in got["first_diffs"]] == [("amount", "1.500", "1.501")]


def test_only_common_ids_and_broken_payloads(frame):
    got = verdict(
        frame,
        {"a": payload(0, None), "b": "[1, 2]", "left": payload(1, A)},
        {"a": payload(0, None), "b": payload(1, A), "right": payload(1, A)},
    )
    assert set(got) == {"a", "b"}
    assert got["a"]["status"] == E.EQUIVALENT
    assert got["b"]["status"] is None and got["b"]["error"] == E.NOT_OBJECT


def test_broken_json_and_failed_sides_are_errors(frame):
    bad = lambda text: json.dumps({"error": text})
    got = verdict(
        frame,
        {"junk": "{broken", "both": bad("x"), "one": payload(1, A), "same": bad("x")},
        {"junk": "{other junk", "both": bad("y"), "one": bad("late"), "same": bad("x")},
    )
    assert got["junk"]["error"] == E.NOT_OBJECT
    assert got["both"]["error"] == E.SOURCE_FAILED + "x" and got["same"]["error"] == E.SOURCE_FAILED + "x"
    assert got["one"]["error"] == E.TARGET_FAILED + "late"
    assert all(r["status"] is None for r in got.values())


def test_fields_outside_the_schema_are_compared(frame):
    more = {**A, "extra": {"deep": [{"x": 1}, {"x": 2.0004}], "n": None}}
    turned = {**A, "extra": {"n": None, "deep": [{"x": 2}, {"x": 1.0}]}}
    assert verdict(frame, {"q": payload(1, more)}, {"q": payload(1, turned)})["q"]["status"] == E.EQUIVALENT
    got = verdict(frame, {"q": payload(1, more)}, {"q": payload(1, A)})["q"]
    assert got["status"] == E.DIFFERENT and [(d["path"], d["new"]) for d in got["first_diffs"]] == [("extra.deep", None), ("extra.n", None)]


def test_a_failing_query_is_an_error_row(spark, frame):
    df = frame([(0,), (1,)], "k int")
    queries = {"good": lambda: (df, "k"), "plan": lambda: (df.select("none"), "k"), "run": lambda: (df.selectExpr("k", "1 / k AS x"), "k")}
    got = {r["query_id"]: r for r in S.run_all(spark, queries).collect()}
    assert got["good"]["count"] == 2 and got["good"]["error"] is None
    assert got["run"]["error"] == "DIVIDE_BY_ZERO" and got["plan"]["error"].startswith("UNRESOLVED_COLUMN")


def test_no_common_id_gives_one_error_row(frame):
    got = verdict(frame, {"a": payload(1, A)}, {"b": payload(1, A)})
    assert list(got) == [None] and got[None]["error"] == E.NO_COMMON


def test_summary_of_none_one_and_many_rows(frame):
    df = frame([(2, "b"), (1, "a"), (3, "c")], "Key int, Name string")
    many = S.summarise(df, "q", "Key").collect()[0]
    assert (many["count"], many["first_sample"], many["last_sample"]) == (3, '{"key":1,"name":"a"}', '{"key":3,"name":"c"}')
    one = S.summarise(df.filter("Key = 2"), "q", "Key").collect()[0]
    assert one["first_sample"] is not None and one["last_sample"] is None
    none = S.summarise(df.filter("Key > 9"), "q", "Key").collect()[0]
    assert (none["count"], none["first_sample"], none["last_sample"]) == (0, None, None)
    assert S.failed(df, "q", "no table").collect()[0]["error"] == "no table"


@pytest.fixture
def rows(frame):
    return frame([(1, 1.0, "a"), (1, 1.0, "a"), (2, 2.0, None), (3, 3.0, "c")], "k int, v double, s string")


def test_shuffled_copy_is_equivalent(rows):
    got = E.equivalence(rows, rows.orderBy("v", ascending=False).repartition(3)).collect()[0]
    assert tuple(got) == (E.EQUIVALENT, 0, 0)


def test_multiset_difference_counts_copies(frame, rows):
    other = frame([(1, 1.0, "a"), (2, 2.0, None), (2, 2.0, None), (3, 3.0009, "c")], "k int, v double, s string")
    assert tuple(E.equivalence(rows, other).collect()[0]) == (E.DIFFERENT, 2, 2)
    texts = {r["row"]: (r["left_count"], r["right_count"]) for r in E.differing_rows(rows, other).collect()}
    assert texts == {
        '{"k":1,"s":"a","v":"1.000"}': (2, 1),
        '{"k":2,"s":null,"v":"2.000"}': (1, 2),
        '{"k":3,"s":"c","v":"3.000"}': (1, 0),
        '{"k":3,"s":"c","v":"3.001"}': (0, 1),
    }


def test_keyed_difference(frame):
    left = frame([(1, 1.0, "a"), (2, 2.0, None), (3, 3.0, "c"), (4, 4.0, "d"), (4, 4.0, "d")], "k int, v double, s string")
    right = frame([(1, 1.0001, "a"), (2, 2.5, "new"), (4, 4.0, "d"), (5, 5.0, "e")], "k int, v double, s string")
    got = {tuple(r) for r in E.keyed_difference(left, right, ["k"]).collect()}
    assert got == {
        (2, "changed", "v", "2.000", "2.500"), (2, "changed", "s", None, "new"), (3, "removed", None, None, None),
        (4, "duplicate", None, None, None), (5, "added", None, None, None),
    }
    counts = {(r["kind"], r["column"]): r["cells"] for r in E.difference_counts(E.keyed_difference(left, right, ["k"]), ["k"]).collect()}
    assert counts[("changed", "v")] == 1 and counts[("duplicate", None)] == 1


def test_latest_outcome(frame):
    log = frame(
        [("a", 1, "[Passed]"), ("a", 2, "[Failed]"), ("a", 3, "chat"), ("b", 1, "[Failed]"), ("b", 2, "[Failed] [Passed]"), ("c", 1, "x")],
        "run string, seq int, text string",
    )
    runs = frame([("a",), ("b",), ("c",), ("d",)], "run string")
    got = {r["run"]: r["outcome"] for r in E.latest_outcome(log, "run", "seq", "text", "[Passed]", "[Failed]", runs).collect()}
    assert got == {"a": "failed", "b": "passed", "c": "missing", "d": "missing"}


def test_new_tokens(frame):
    from pyspark.sql import functions as F

    df = frame([("x", "SORT Asc"), ("sort", "sort asc"), ("  ", "sort"), (None, "sort"), ("x", None)], "s string, t string")
    tokens = ["sort", "asc"]
    found = E.new_tokens(E.present_tokens(F.col("s"), tokens), E.present_tokens(F.col("t"), tokens))
    got = [r[0] for r in df.select(found).collect()]
    assert got[:2] == [["sort", "asc"], ["asc"]] and got[2:] == [[], [], []]


def leaves_of(frame, *texts):
    from tableloom.functions.leaves import leaves, parse, unpacked

    rows = frame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", leaves(unpacked(parse("t"))).alias("l")).collect()
    return [r["l"] for r in sorted(rows, key=lambda r: r["k"])]


def test_leaves_of_any_value(frame):
    got = leaves_of(
        frame, '"abc"', "3", "[2, 1, [3, null], {}]", "{}", "null", None, '{"a": {}, "b": [], "c": null}', '{"a.b": 1, "a": {"b": 2}, "x\\\\y": true}',
        '"1.000"', '"null"', '"{\\"a\\": 1}"', '{"a": NaN, "b": [-Infinity, "NaN"]}', "1e30", "12345678901234567890123", "{broken",
    )
    assert got == [
        {"": "abc"}, {"": "3.000"}, {"": "[1.000,2.000,[3.000,null],{}]"}, {}, {}, {}, {"a": "{}", "b": "[]", "c": "null"},
        {"a\\.b": "1.000", "a.b": "2.000", "x\\\\y": "true"}, {"": '"1.000"'}, {"": '"null"'}, {"a": "1.000"}, {"a": "NaN", "b": "[-Infinity,NaN]"},
        {"": "1000000000000000000000000000000.000"}, {"": "12345678901234567890123.000"}, {},
    ]


def test_lists_within_lists_have_no_order(frame):
    one = '{"r": [{"k": 1, "v": [[1, 2], [3]]}, {"k": 2, "v": [{"z": [true, "a"]}]}]}'
    other = '{"r": [{"v": [{"z": ["a", true]}], "k": 2}, {"v": [[3.0], [2, 1]], "k": 1.0004}]}'
    copies = '{"r": [{"k": 1, "v": [[1, 2], [3], [3]]}, {"k": 2, "v": [{"z": [true, "a"]}]}]}'
    a, b, c = leaves_of(frame, one, other, copies)
    assert a == b and a != c and list(a) == ["r"]


def test_leaves_of_a_deep_and_of_a_wide_value(frame):
    deep = "[" * 40 + "1" + "]" * 40
    wide = json.dumps({f"k{i}": [i, {"x": [i]}] for i in range(300)})
    got = leaves_of(frame, deep, wide)
    assert got[0] == {"": deep.replace("1", "1.000")}
    assert got[1] == {f"k{i}": f'[{i}.000,{{"x":[{i}.000]}}]' for i in range(300)}


def test_text_and_list_samples_do_not_end_the_comparison(frame):
    got = verdict(
        frame,
        {"same": payload(1, "abc"), "text": payload(1, "abc"), "list": payload(1, [1, 2]), "mixed": payload(1, "abc"), "fine": payload(1, A)},
        {"same": payload(1, "abc"), "text": payload(1, "abd"), "list": payload(1, [2, 1.0]), "mixed": payload(1, A), "fine": payload(1, A)},
    )
    assert {k: r["status"] for k, r in got.items()} == {
        "same": E.EQUIVALENT, "text": E.DIFFERENT, "list": E.EQUIVALENT, "mixed": E.DIFFERENT, "fine": E.EQUIVALENT,
    }
    assert [tuple(d) for d in got["text"]["first_diffs"]] == [("", "abc", "abd")]
    assert ("", "abc", None) in [tuple(d) for d in got["mixed"]["first_diffs"]]


def test_summaries_are_compared_in_as_many_tasks_as_shuffles_have(spark, frame):
    rows = frame([(str(k), '{"count": 1, "firstSample": {"a": {"b": [%d, 2]}, "x": 1}}' % k) for k in range(40)], "query_id string, payload string")
    other = rows.withColumn("payload", F.replace("payload", F.lit('"x": 1'), F.lit('"x": 2')))
    found = E.compare_summaries(rows, other, "x decimal(38,3)")
    counted = found.filter("status IS NOT NULL").select(F.spark_partition_id().alias("p"), "first_diffs").collect()
    assert len({r["p"] for r in counted}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [[tuple(d) for d in r["first_diffs"]] for r in counted] == [[("x", "1.000", "2.000")]] * 40
