import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableloom.operators import documents as D
from tableloom.sources import files

ORDER = (D.Field("oid", "orderId", "INTEGER", primary_key=True), D.Field("cust", "customerId", "INTEGER"))
CUSTOMER = (D.Field("cid", "customerId", "INTEGER", primary_key=True), D.Field("cname", "customerName", "STRING"))
TX = (D.Field("tid", "transactionId", "INTEGER", primary_key=True), D.Field("amount", "amount", "DOUBLE"))

TREE = D.TableMapping(
    D.NEW_DOCUMENT,
    "orders",
    ORDER,
    children=(
        D.TableMapping(
            D.EMBEDDED, "customers", CUSTOMER, "customer", ("cust", "cid"),
            children=(D.TableMapping(D.EMBEDDED_ARRAY, "tx", TX, "transactions", ("cid", "tcust")),),
        ),
    ),
)


@pytest.fixture
def tables(frame):
    return {
        "orders": frame([(1, 10), (2, 10), (3, 20), (4, None)], "oid int, cust int"),
        "customers": frame([(10, "ten"), (20, "twenty")], "cid int, cname string"),
        "tx": frame([(i, 10, float(i)) for i in range(50, 0, -1)] + [(99, 77, 1.0)], "tid int, tcust int, amount double"),
    }


def test_object_with_nested_array(tables):
    built = D.build_collection("orders", TREE, tables)
    assert built.continuations == {}
    rows = {r["orderId"]: r for r in built.documents.collect()}
    assert rows[4]["customer"] is None and rows[3]["customer"]["transactions"] == []
    assert [x["transactionId"] for x in rows[1]["customer"]["transactions"]] == list(range(1, 51))
    assert rows[1]["customer"] == rows[2]["customer"]
    assert len({r["_id"] for r in rows.values()}) == 4


def test_long_arrays_in_objects_are_kept_once(tables):
    built = D.build_collection("orders", TREE, tables, max_items=16, repeat_items=8)
    rows = {r["orderId"]: r for r in built.documents.collect()}
    assert rows[1]["customer"]["transactions"] == []
    rest = built.continuations["customer.transactions"].collect()
    assert {r["tcust"] for r in rest} == {10} and len(rest) > 1
    ids = Counter(x["transactionId"] for r in rest for x in r["transactions"])
    assert ids == Counter(range(1, 51))


def test_long_root_arrays_continue(tables):
    tree = D.TableMapping(
        D.NEW_DOCUMENT, "customers", CUSTOMER, children=(D.TableMapping(D.EMBEDDED_ARRAY, "tx", TX, "transactions", ("cid", "tcust")),)
    )
    whole = D.build_collection("customers", tree, tables)
    cut = D.build_collection("customers", tree, tables, max_items=16)
    assert not whole.continuations and set(cut.continuations) == {"transactions"}
    docs = {r["customerId"]: r["transactions"] for r in cut.documents.collect()}
    more = [x for r in cut.continuations["transactions"].collect() for x in r["transactions"]]
    assert docs[20] == [] and 0 < len(docs[10]) < 50
    assert sorted(x["transactionId"] for x in [*docs[10], *more]) == list(range(1, 51))
    assert cut.documents.columns == whole.documents.columns


def test_round_trip(tables):
    docs = D.build_collection("orders", TREE, tables).documents
    back = D.unnest(docs, "customer.transactions").select("transactionId", "amount")
    want = tables["tx"].join(tables["orders"], F.col("tcust") == F.col("cust")).select("tid", "amount").distinct()
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    names = D.unnest(docs, "customer", keep=["orderId"]).collect()
    assert {(r["orderId"], r["customerName"]) for r in names} == {(1, "ten"), (2, "ten"), (3, "twenty")}


def test_ids_repeat_and_depend_on_the_collection(tables):
    one = D.build_collection("orders", TREE, tables).documents.select("orderId", "_id").collect()
    two = D.build_collection("orders", TREE, tables).documents.select("orderId", "_id").collect()
    other = D.build_collection("other", TREE, tables).documents.select("orderId", "_id").collect()
    assert sorted(one) == sorted(two) and not {r["_id"] for r in one} & {r["_id"] for r in other}


def test_null_fields_in_json(spark, frame, tmp_path):
    df = frame([(1, None), (2, "x")], "k int, v string")
    files.write_documents(df, str(tmp_path / "all"))
    files.write_documents(df, str(tmp_path / "some"), exclude_nulls=True)
    lines = lambda p: sorted(r[0] for r in spark.read.text(str(tmp_path / p)).collect())
    assert lines("all") == ['{"k":1,"v":null}', '{"k":2,"v":"x"}']
    assert lines("some") == ['{"k":1}', '{"k":2,"v":"x"}']


def project(fields, settings=None, collection="c1", table="t1"):
    body = {
        "collections": {"c1": {"name": "orders"}},
        "tables": {"t1": {"path": {"database": "db", "schema": "Sales", "table": "Orders"}}, "t2": {"path": {"table": "X"}}},
        "mappings": {"m1": {"settings": settings or {}, "fields": fields, "collectionId": collection, "table": table}},
    }
    return json.dumps({"version": "1", "project": {"name": "p", "content": body}})


def entry(target, source, sql="int", type_="INTEGER", included=True, key=False):
    return {"target": {"name": target, "included": included, "type": type_}, "source": {"name": source, "databaseSpecificType": sql, "isPrimaryKey": key}}


def test_mapping_rows(frame):
    fields = {
        "OrderID": entry("orderId", "OrderID", "INT", key=True),
        "_id": entry("_id", "_id", "NONE", "OBJECT_ID"),
        "b": entry("Name", "Name", "nvarchar", "string"),
        "A": entry("name", "NAME", "varchar", "STRING"),
        "Hidden": entry("hidden", "Hidden", included=False),
        "Untyped": entry("untyped", "Untyped", ""),
        "NoSource": {"target": {"name": "x", "included": True, "type": "INTEGER"}},
        "Nameless": entry("nameless", " ", "int"),
    }
    texts = frame([(1, project(fields, {"type": "embedded_document", "embeddedPath": "customer"})), (2, project(fields, collection="zz")),
                   (3, project(fields, table="t2")), (4, "{}"), (5, project(fields, {"type": "NEW_DOCUMENT", "embeddedPath": "p"}))], "pid int, text string")
    rows = D.mapping_rows(texts, "text", ["pid"]).collect()
    assert {r["pid"] for r in rows} == {1, 5}
    assert {r["embedded_path"] for r in rows if r["pid"] == 1} == {"customer"} and {r["embedded_path"] for r in rows if r["pid"] == 5} == {None}
    assert {r["mapping_type"] for r in rows if r["pid"] == 1} == {"EMBEDDED_DOCUMENT"}
    got = {(r["source_column"], r["target_property"], r["sql_type"], r["target_type"], r["is_primary_key"]) for r in rows if r["pid"] == 1}
    # Of the two names that differ in case, field key "A" comes first; a blank source name falls back to the key.
    assert got == {("OrderID", "orderId", "int", "INTEGER", True), ("NAME", "name", "varchar", "STRING", False), ("Nameless", "nameless", "int", "INTEGER", False)}
    assert {r["source_schema"] for r in rows} == {"db.Sales"} and {r["source_table"] for r in rows} == {"Orders"}
    first = D.sorted_mapping_rows(D.mapping_rows(texts, "text", ["pid"]), ["pid"]).collect()
    assert [r["target_property"] for r in first][:3] == ["name", "nameless", "orderId"]
    built = D.fields_of([r for r in first if r["pid"] == 1])
    assert [f.target for f in built if f.primary_key] == ["orderId"]


def test_composite_keys_with_the_separator_keep_their_own_ids(frame):
    from tableloom.operators import graph as G

    keys = [("a:b", "c"), ("a", "b:c"), ("a\\", ":b"), ("a", "\\:b"), ("a", None), (None, "a"), ("a", "\\N"), ("a", "N")]
    df = frame(keys, "x string, y string")
    ids = [r[0] for r in df.select(D.document_id("p", ["x", "y"])).collect()]
    assert len(set(ids)) == len(keys)
    nodes = [r[0] for r in df.select(G.node_id("p", ["x", "y"])).collect()]
    assert nodes.count(None) == 2 and len(set(nodes)) == len(keys) - 1


@pytest.mark.parametrize("n", [1000, 1001])
def test_arrays_in_objects_are_whole_at_any_length(frame, n):
    tables = {
        "orders": frame([(1, 7), (2, 7)], "oid int, cid int"),
        "customer": frame([(7,)], "cid int"),
        "tx": frame([(i, 7) for i in range(n)], "tid int, cid int"),
    }
    tx = D.TableMapping(D.EMBEDDED_ARRAY, "tx", (D.Field("tid", "id", primary_key=True),), "transactions", ("cid", "cid"))
    customer = D.TableMapping(D.EMBEDDED, "customer", (D.Field("cid", "id", primary_key=True),), "customer", ("cid", "cid"), (tx,))
    root = D.TableMapping(D.NEW_DOCUMENT, "orders", (D.Field("oid", "id", primary_key=True),), children=(customer,))
    built = D.build_collection("o", root, tables)
    assert [(len(r["customer"]["transactions"]), r["customer"]["transactionsParts"]) for r in built.documents.collect()] == [(n, 1)] * 2
    assert not built.continuations


def test_a_written_collection_reads_back_with_its_parts(spark, frame, tmp_path):
    tables = {"p": frame([(1,), (2,)], "k int"), "c": frame([(i, 1) for i in range(40)] + [(99, 2)] + [(i, 5) for i in range(100, 140)], "i int, k int")}
    child = D.TableMapping(D.EMBEDDED_ARRAY, "c", (D.Field("i", "i", primary_key=True),), "items", ("k", "k"))
    root = D.TableMapping(D.NEW_DOCUMENT, "p", (D.Field("k", "k", primary_key=True),), children=(child,))
    files.write_collection(D.build_collection("p", root, tables, max_items=8), str(tmp_path / "c"))
    back = files.read_collection(spark, str(tmp_path / "c"))
    docs = {r["k"]: r for r in back.documents.collect()}
    more = back.continuations["items"].collect()
    items = [(k, x["i"]) for k, r in docs.items() for x in r["items"]] + [(r["k"], x["i"]) for r in more for x in r["items"]]
    assert sorted(items) == [(1, i) for i in range(40)] + [(2, 99)]
    assert docs[2]["itemsParts"] == 1 and docs[1]["itemsParts"] == 1 + len(more)


def test_documents_are_small_files_of_gzip(spark, frame, tmp_path):
    df = frame([(k, "x" * 50) for k in range(10)], "k int, v string").coalesce(1)
    files.write_documents(df, str(tmp_path / "d"), max_records=4)
    assert len(list((tmp_path / "d").glob("*.json.gz"))) == 3
    assert sorted(r["k"] for r in files.read_documents(spark, str(tmp_path / "d"), df.schema).collect()) == list(range(10))
