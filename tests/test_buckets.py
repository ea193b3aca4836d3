"""Tables in hash buckets: only touched buckets are written, and readers see whole versions."""

import pytest
from test_changes import ROOT

from tableloom.operators import documents as D
from tableloom.streaming import buckets as B
from tableloom.streaming import changes as S

FEED = "k int, v string, op string, ts int"


@pytest.fixture
def table(spark, frame, tmp_path):
    return B.BucketTable(spark, str(tmp_path / "t"), frame([], "k int, v string").schema, ("k",), ("ts",), ("int",), 8)


def rows(df):
    return {r["k"]: r["v"] for r in df.collect()}


def files(tmp_path, batch):
    return sorted(p.name for p in (tmp_path / "t" / "data" / f"batch={batch}").glob("bucket=*"))


def test_only_touched_buckets_are_written(table, frame, tmp_path):
    first = table.apply(frame([(k, "a", "upsert", 1) for k in range(100)], FEED), 0)
    assert first == list(range(8)) and len(files(tmp_path, 0)) == 8
    second = table.apply(frame([(5, "b", "upsert", 2), (5, "late", "upsert", 0)], FEED), 1)
    assert len(second) == 1 and files(tmp_path, 1) == [f"bucket={second[0]}"]
    assert rows(table.read()) == {k: "b" if k == 5 else "a" for k in range(100)}
    assert rows(table.read(0)) == dict.fromkeys(range(100), "a")
    assert {b: n for b, n in table.manifest().items() if n == 1} == {second[0]: 1}


def test_late_changes_bring_nothing_back(table, frame):
    table.apply(frame([(1, "a", "upsert", 1), (2, "a", "upsert", 1)], FEED), 0)
    table.apply(frame([(1, None, "delete", 5)], FEED), 1)
    table.apply(frame([(1, "older", "upsert", 3), (2, "older", "upsert", 0)], FEED), 2)
    assert rows(table.read()) == {2: "a"}
    table.apply(frame([(1, "newer", "upsert", 9)], FEED), 3)
    assert rows(table.read()) == {1: "newer", 2: "a"}


def test_a_batch_without_manifest_is_not_seen_and_may_run_again(table, frame, spark, tmp_path):
    table.apply(frame([(k, "a", "upsert", 1) for k in range(20)], FEED), 0)
    change = frame([(3, "b", "upsert", 2)], FEED)
    bucket = table.apply(change, 1)
    # A batch that was lost before its manifest: its data alone changes nothing.
    lost = B.BucketTable(spark, table.path, table.schema, table.keys, table.order, table.order_types, 8)
    frame([(4, "x", "upsert", 9, bucket[0])], FEED + ", bucket int").write.partitionBy("bucket").parquet(f"{table.path}/data/batch=2")
    assert rows(lost.read())[4] == "a" and lost.versions() == [0, 1]
    lost.apply(change, 1)
    lost.apply(frame([(4, "c", "upsert", 3)], FEED), 2)
    assert rows(lost.read()) == {k: {3: "b", 4: "c"}.get(k, "a") for k in range(20)}


def test_empty_batches_and_empty_tables(table, frame):
    assert rows(table.read()) == {} and table.versions() == []
    assert table.apply(frame([], FEED), 0) == [] and rows(table.read()) == {}
    table.apply(frame([(None, "n", "upsert", 1)], FEED), 1)
    assert rows(table.read()) == {None: "n"}


def test_old_versions_go_and_the_rest_stays_readable(table, frame, tmp_path):
    table.apply(frame([(k, "a", "upsert", 1) for k in range(50)], FEED), 0)
    for n in range(1, 5):
        table.apply(frame([(7, f"v{n}", "upsert", n + 1)], FEED), n)
    assert table.drop_old(keep=2) == [0, 1, 2]
    # The first batch still holds the buckets that no later one wrote.
    assert table.versions() == [3, 4] and sorted(p.name for p in (tmp_path / "t/data").iterdir()) == ["batch=0", "batch=3", "batch=4"]
    assert rows(table.read(3))[7] == "v3" and rows(table.read()) == {k: "v4" if k == 7 else "a" for k in range(50)}


def test_documents_in_buckets(spark, frame, tmp_path):
    parents = frame([(k,) for k in range(200)], "pid int")
    before = {"parent": parents, "child": frame([(k, k % 200, "a") for k in range(400)], "cid int, owner int, v string")}
    built = D.build_collection("p", ROOT, before)
    table = B.document_table(spark, str(tmp_path / "d"), built.documents, 32)
    assert len(B.store_documents(table, built)) == 32
    after = {"parent": parents.filter("pid <> 9"), "child": frame([(k, 3 if k == 9 else k % 200, "a") for k in range(400)], "cid int, owner int, v string")}
    touched = S.touched_roots(ROOT, after, {"child": frame([(9,)], "cid int")}, before)
    written = B.refresh_documents(table, "p", ROOT, after, touched, 1)
    assert 1 <= len(written) <= 2
    got = {r["id"]: [x["id"] for x in r["children"]] for r in table.read().collect()}
    assert got == {k: [3, 9, 203] if k == 3 else [k, k + 200] for k in range(200) if k != 9}


def test_only_rows_whose_keys_come_again_are_shuffled(table, frame, monkeypatch):
    travelled = []
    monkeypatch.setattr(B, "last_changes", lambda rows, *a: travelled.append(rows.count()) or S.last_changes(rows, *a))
    table.apply(frame([(k, "a", "upsert", 1) for k in range(2000)], FEED), 0)
    assert travelled == []
    table.apply(frame([(k, "b", "upsert", 2) for k in range(0, 2000, 20)] + [(5000, "new", "upsert", 2), (None, "n", "upsert", 2)], FEED), 1)
    assert 200 <= travelled.pop() < 300 and travelled == []
    assert rows(table.read()) == {k: "b" if k % 20 == 0 else "a" for k in range(2000)} | {5000: "new", None: "n"}


def test_many_small_files_are_put_together(table, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILES", 2)
    table.apply(frame([(k, "a", "upsert", 0) for k in range(100)], FEED), 0)
    for n in range(1, 6):
        table.apply(frame([(k, f"v{n}", "upsert", n) for k in range(0, 100, 2)], FEED), n)
    assert max(len(list(p.glob("*.parquet"))) for p in (tmp_path / "t/data/batch=5").iterdir()) <= 10
    assert rows(table.read()) == {k: "v5" if k % 2 == 0 else "a" for k in range(100)}


BOUNDS = {"max_items": 16}


def parents_of(frame, keys, rows):
    """Tables of the parents with these keys and of the children in ``rows``."""
    return {"parent": frame([(k,) for k in keys], "pid int"), "child": frame(rows, "cid int, owner int, v string")}


def items(collection):
    """Parent, child and value of every part, and the number of parts that each document says it has."""
    documents = collection.documents.collect()
    out = [(r["id"], x["id"], x["v"]) for r in documents for x in r["children"]]
    found = {r["id"]: 1 for r in documents}
    for r in collection.continuations["children"].collect() if collection.continuations else ():
        out += [(r["owner"], x["id"], x["v"]) for x in r["children"]]
        found[r["owner"]] = found.get(r["owner"], 0) + 1
    assert found == {r["id"]: r["childrenParts"] for r in documents}
    return sorted(out)


def test_long_arrays_are_stored_and_refreshed_whole(spark, frame, tmp_path):
    first = [(100 * o + i, o, "a") for o in range(6) for i in range(90 if o < 4 else 3)]
    before = parents_of(frame, range(6), first)
    built = D.build_collection("p", ROOT, before, **BOUNDS)
    table = B.document_table(spark, str(tmp_path / "d"), built.documents, 4)
    B.store_documents(table, built)
    want = [sorted((o, c, v) for c, o, v in first)]
    # Parent 0 changes, 1 keeps two children, 2 goes, 4 grows; 3 and 5 stay as they are.
    second = [(c, o, "b" if o == 0 else v) for c, o, v in first if o not in (1, 2) or c in (100, 101)]
    second += [(400 + i, 4, "new") for i in range(3, 80)]
    after = parents_of(frame, [0, 1, 3, 4, 5], second)
    touched = frame([(0,), (1,), (2,), (4,)], "pid int")
    B.refresh_documents(table, "p", ROOT, after, touched, 1, **BOUNDS)
    want.append(sorted((o, c, v) for c, o, v in second))
    # All arrays get short: stored again, they have no parts any more.
    third = [(c, o, v) for c, o, v in second if c % 100 < 5]
    B.store_documents(table, D.build_collection("p", ROOT, parents_of(frame, [0, 1, 3, 4, 5], third), **BOUNDS), 2)
    want.append(sorted((o, c, v) for c, o, v in third))
    # Earlier versions are still whole, also after older ones are dropped.
    assert [items(table.collection(v)) for v in (0, 2)] == [want[0], want[2]]
    assert table.drop_old(keep=2) == [0] and items(table.collection(1)) == want[1]


def test_parts_of_a_batch_without_documents_are_not_seen(spark, frame, tmp_path):
    rows = [(i, 0, "a") for i in range(3)]
    built = D.build_collection("p", ROOT, parents_of(frame, range(2), rows), **BOUNDS)
    table = B.document_table(spark, str(tmp_path / "d"), built.documents, 4)
    B.store_documents(table, built)
    long = [(i, 0, "b") for i in range(90)]
    grown = D.build_collection("p", ROOT, parents_of(frame, range(2), long), **BOUNDS)
    table.apply_parts(grown, 1)
    assert items(table.collection()) == sorted((o, c, v) for c, o, v in rows)
    B.store_documents(table, grown, 1)
    assert items(table.collection()) == sorted((o, c, v) for c, o, v in long)
    # What is left of batch 2 does not push out what the last version needs, and batch 3 does not build on it.
    table.apply_parts(built, 2)
    assert table.drop_old(keep=1) == [0]
    B.refresh_documents(table, "p", ROOT, parents_of(frame, range(2), [*long, (200, 1, "c")]), frame([(1,)], "pid int"), 3, **BOUNDS)
    assert items(table.collection()) == sorted([*((o, c, v) for c, o, v in long), (1, 200, "c")])
