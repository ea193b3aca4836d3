import datetime as dt

import pytest

from tableloom.operators import documents as D
from tableloom.operators.marks import Marks
from tableloom.streaming import changes as S

FEED = "k int, v string, op string, ts int, seq int"
FIRST = [(1, "a", "upsert", 1, 1), (2, "b", "upsert", 1, 2), (1, "a2", "upsert", 2, 1), (9, None, "delete", 1, 1)]
SECOND = [(2, None, "delete", 3, 1), (1, "old", "upsert", 0, 1), (3, "c", "upsert", 3, 2), (5, "x", "upsert", 3, 3), (5, None, "delete", 3, 4)]


@pytest.fixture
def target(frame):
    return frame([(9, "gone"), (8, "stays")], "k int, v string")


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.select("k", "v").collect())


def test_last_change_wins(frame, target):
    assert rows(S.apply_changes(target, frame(FIRST, FEED), ["k"], ["ts", "seq"])) == [(1, "a2"), (2, "b"), (8, "stays")]
    both = S.apply_changes(target, frame(FIRST + SECOND, FEED), ["k"], ["ts", "seq"])
    assert rows(both) == [(1, "a2"), (3, "c"), (8, "stays")]


def test_stream_over_several_batches_and_a_restart(spark, frame, target, tmp_path):
    folder, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for part in (FIRST, SECOND):
        frame(part, FEED).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(folder)
        S.stream_changes(stream, out, offsets, ["k"], ["ts", "seq"]).awaitTermination()
    # Batches hold the last change per key of their own; the order columns decide across batches.
    assert rows(S.current_rows(target, out, ["k"], ["ts", "seq"])) == [(1, "a2"), (3, "c"), (8, "stays")]


def test_table_versions(spark, frame, target, tmp_path):
    folder, table, offsets = (str(tmp_path / n) for n in ("in", "table", "offsets"))
    for part in (FIRST, SECOND):
        frame(part, FEED).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(folder)
        S.stream_into_table(stream, table, offsets, target, ["k"], ["ts", "seq"]).awaitTermination()
    assert rows(spark.read.parquet(f"{table}/version=0")) == [(1, "a2"), (2, "b"), (8, "stays")]
    # The late change of key 1 is older than what the table has.
    assert rows(spark.read.parquet(f"{table}/version=1")) == [(1, "a2"), (3, "c"), (8, "stays")]


def test_late_changes_do_not_bring_deleted_rows_back(spark, frame, target, tmp_path):
    folder, table, offsets, out, small = (str(tmp_path / n) for n in ("in", "table", "offsets", "out", "small"))
    parts = [[(1, None, "delete", 10, 1), (2, "new", "upsert", 10, 1)], [(1, "back", "upsert", 4, 1), (2, "old", "upsert", 5, 1)], [(9, None, "delete", 1, 1)]]
    for part in parts:
        frame(part, FEED).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(folder)
        S.stream_into_table(stream, table, offsets, target, ["k"], ["ts", "seq"]).awaitTermination()
        S.stream_changes(stream, out, offsets + "2", ["k"], ["ts", "seq"]).awaitTermination()
    assert rows(spark.read.parquet(f"{table}/version=2")) == [(2, "new"), (8, "stays")]
    S.compact_changes(spark, out, small, ["k"], ["ts", "seq"])
    assert rows(S.current_rows(target, small, ["k"], ["ts", "seq"])) == [(2, "new"), (8, "stays")]
    assert spark.read.parquet(small).count() == 3


def test_columns_keep_their_order(frame):
    target = frame([("a", 1)], "v string, k int")
    feed = frame([("b", 2, "upsert", 1)], "v string, k int, op string, ts int")
    assert S.apply_changes(target, feed, ["k"], ["ts"]).columns == ["v", "k"]


def test_extract_takes_the_open_closed_interval(frame):
    day = lambda d: dt.datetime(2014, 1, d)
    head = frame([(1, day(1)), (2, day(3)), (3, day(9))], "h int, ht timestamp_ntz")
    line = frame([(1, day(2)), (1, day(5)), (2, day(1)), (3, day(1))], "l int, lt timestamp_ntz")
    got = S.incremental_extract(head, line, ("h", "l"), ("ht", "lt"), day(2), day(5))
    # The later of the two changes counts: 1/day 5 and 2/day 3; day 2 itself is out, day 9 is beyond.
    assert sorted((r["h"], r["lt"].day) for r in got.collect()) == [(1, 5), (2, 1)]


ROOT = D.TableMapping(
    D.NEW_DOCUMENT, "parent", (D.Field("pid", "id", primary_key=True),),
    children=(D.TableMapping(D.EMBEDDED_ARRAY, "child", (D.Field("cid", "id", primary_key=True), D.Field("v", "v")), "children", ("pid", "owner")),),
)


def content(collection):
    out = {r["id"]: [(x["id"], x["v"]) for x in r["children"]] for r in collection.documents.collect()}
    return out


def test_only_touched_documents_are_rebuilt(frame):
    parent = frame([(1,), (2,), (3,)], "pid int")
    before = {"parent": parent, "child": frame([(10, 1, "a"), (11, 2, "b")], "cid int, owner int, v string")}
    # Child 10 moves from parent 1 to parent 3; child 11 changes; parent 2 stays.
    after = {"parent": parent, "child": frame([(10, 3, "a"), (11, 2, "B")], "cid int, owner int, v string")}
    collection = D.build_collection("p", ROOT, before)
    changed = {"child": frame([(10,), (11,)], "cid int")}
    touched = S.touched_roots(ROOT, after, changed, before)
    assert sorted(r["pid"] for r in touched.collect()) == [1, 2, 3]
    assert content(S.refresh_collection("p", ROOT, collection, after, touched)) == {1: [], 2: [(11, "B")], 3: [(10, "a")]}


def test_removed_roots_lose_their_document(frame):
    child = frame([(10, 1, "a")], "cid int, owner int, v string")
    collection = D.build_collection("p", ROOT, {"parent": frame([(1,), (2,)], "pid int"), "child": child})
    gone = frame([(1,)], "pid int")
    after = {"parent": frame([(2,)], "pid int"), "child": child}
    assert content(S.refresh_collection("p", ROOT, collection, after, gone)) == {2: []}


def test_continuations_are_replaced_with_their_owner(frame, monkeypatch):
    from functools import partial

    monkeypatch.setattr(S, "build_collection", partial(D.build_collection, max_items=16))
    parent = frame([(1,), (2,)], "pid int")
    many = [(i, 1, "a") for i in range(100)] + [(200 + i, 2, "z") for i in range(90)]
    before = {"parent": parent, "child": frame(many, "cid int, owner int, v string")}
    after = {"parent": parent, "child": frame([(i, o, "b" if o == 1 else v) for i, o, v in many], "cid int, owner int, v string")}
    collection = D.build_collection("p", ROOT, before, max_items=16)
    touched = S.touched_roots(ROOT, after, {"child": frame([(0,)], "cid int")})
    got = S.refresh_collection("p", ROOT, collection, after, touched)
    items = [(r["id"], x["id"], x["v"]) for r in got.documents.collect() for x in r["children"]]
    items += [(r["owner"], x["id"], x["v"]) for r in got.continuations["children"].collect() for x in r["children"]]
    assert sorted(items) == sorted((o, i, "b" if o == 1 else v) for i, o, v in many)


def test_documents_that_stay_are_not_shuffled(frame, monkeypatch):
    travelled = []
    met = Marks.met
    monkeypatch.setattr(Marks, "met", lambda self, rows, keys: travelled.append(met(self, rows, keys)) or travelled[-1])
    parents = frame([(k,) for k in range(1000)], "pid int")
    before = {"parent": parents, "child": frame([(k, k % 1000, "a") for k in range(2000)], "cid int, owner int, v string")}
    built = D.build_collection("p", ROOT, before)
    after = before | {"child": frame([(k, k % 1000, "b" if k == 7 else "a") for k in range(2000)], "cid int, owner int, v string")}
    fresh = S.refresh_collection("p", ROOT, built, after, S.touched_roots(ROOT, after, {"child": frame([(7,)], "cid int")}))
    assert fresh.documents.count() == 1000
    assert [rows.count() < 50 for rows in travelled] == [True]
