import datetime as dt
import json

from tableloom.operators import graph as G
from tableloom.sources import files


def test_nodes_and_edges(frame):
    df = frame([(1, 10), (2, None)], "oid int, cid int")
    node = G.nodes(df, G.NodeMapping("Order", "orders", ("oid",), {"oid": "orderId"}, "Sales.Orders"))
    assert [tuple(r) for r in node.orderBy("orderId").collect()] == [("Sales.Orders:1", "Order", 1), ("Sales.Orders:2", "Order", 2)]
    edge = G.edges(df, G.EdgeMapping("customers", "orders", ("Sales.Orders", ("oid",)), ("Sales.Customers", ("cid",))))
    assert [tuple(r) for r in edge.collect()] == [("Sales.Orders:1", "Sales.Customers:10", "CUSTOMERS")]


def test_repair_changes_whole_columns_only(frame):
    df = frame(
        [("2014-12-20 11:00:00.0Z", "2014-12-20", "2014-12-20", "x"), (None, "2015-01-02", "later", "y")],
        "at string, day string, mixed string, name string",
    )
    got = G.repair_types(df)
    assert dict(got.dtypes) == {"at": "timestamp", "day": "date", "mixed": "string", "name": "string"}
    assert got.collect()[1]["day"] == dt.date(2015, 1, 2)


def test_pattern_collects_each_branch_alone(frame):
    a = frame([("a1", "A"), ("a2", "A")], "id string, label string")
    b = frame([("b1", "B", 5), ("b2", "B", 6)], "id string, label string, n int")
    edge = frame([("b1", "a1", "T"), ("b2", "a1", "T")], "src string, dst string, type string")
    got = {r["id"]: [x["n"] for x in r["bs"]] for r in G.collect_incoming(a, edge, b, "bs", ["n"]).rows.collect()}
    assert got == {"a1": [5, 6], "a2": []}
    hop = G.follow(b, edge, a, name="parent").collect()
    assert {(r["id"], r["parent"]["id"]) for r in hop} == {("b1", "a1"), ("b2", "a1")}


def item(kind, column=None, name=None, space=None, type_=None, **extra):
    return {"field": {"type": kind, "name": name, "id-space": space, "neo4j-data-type": type_}, "column": {"name": column, **extra}}


def files_frame(frame, *objects):
    return G.mapping_entries(frame([(1, json.dumps(list(objects)))], "fid int, text string"), "text", ["fid"])


STOCK = {
    "graph-object-type": "Node", "schema": "Warehouse",
    "mappings": [
        item("Id", None, space="db.Warehouse.StockItems", columns=[{"name": "StockItemID", "table": "StockItems"}]),
        item("Label", "StockItems"),
        item("Data", "StockItemID", "stockItemId", type_="int", **{"sql-data-type": "INT"}),
        item("Data", "Size", "size", type_="string", **{"sql-data-type": "nvarchar"}),
        item("Data", "Untyped", "untyped"),
    ],
}


def test_node_mapping_rows(frame):
    again = {
        "graph-object-type": "Node", "schema": "Other",
        "mappings": [item("Id", "X", table="StockItems"), item("Data", "SIZE", "Size", type_="text", **{"sql-data-type": "varchar"})],
    }
    rows = G.node_mapping_rows(files_frame(frame, STOCK, again), ["fid"]).collect()
    got = {(r["label"], r["source_schema"], r["source_table"], r["source_column"], r["target_property"], r["is_primary_key"]) for r in rows}
    # The later mapping of the label wins for the same names; schema and table stay those of the first.
    assert got == {
        ("StockItem", "Warehouse", "StockItems", "StockItemID", "stockItemId", True),
        ("StockItem", "Warehouse", "StockItems", "SIZE", "Size", False),
    }


def test_relationship_rows(frame):
    rel = {
        "graph-object-type": "Relationship", "schema": "Sales",
        "mappings": [
            item("StartId", "StockItemID", space="DB.warehouse.stockitems", table="Orders"),
            item("EndId", None, space="db.Application.People", **{"referenced-column": {"name": "PersonID", "table": "Orders"}}),
            item("RelationshipType", "People"),
            item("Data", "Since", "since", type_="date", **{"sql-data-type": "date"}),
            item("Data", "SINCE", "Since", type_="text", **{"sql-data-type": "text"}),
        ],
    }
    no_end = {"graph-object-type": "Relationship", "schema": "Sales", "mappings": rel["mappings"][:1] + rel["mappings"][2:3]}
    entries = files_frame(frame, STOCK, rel, no_end)
    rows = G.relationship_mapping_rows(entries, ["fid"]).collect()
    assert [(r["relationship_type"], r["source_table"], r["start_column"], r["start_entity"], r["end_column"], r["end_entity"]) for r in rows] == [
        ("PEOPLE", "Orders", "StockItemID", "StockItem", "PersonID", "People")
    ]
    props = G.relationship_property_rows(entries, ["fid"]).collect()
    assert [(r["relationship_type"], r["source_column"], r["target_property"]) for r in props] == [("PEOPLE", "Since", "since")]


def test_graph_files(spark, frame, tmp_path):
    nodes = {"A": frame([("A:1", "A", 'q"x')], "id string, label string, p string")}
    edges = {("T", "A", "A"): frame([("A:1", "A:1", "T")], "src string, dst string, type string")}
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges/T/A-A")).count() == 1
    files.write_graph_csv(nodes, edges, str(tmp_path / "csv"), {"A": "db.A"})
    text = spark.read.text(str(tmp_path / "csv/nodes/A")).collect()
    assert text[0][0] == '"id:ID(db.A)",":LABEL","p"' or text[0][0] == "id:ID(db.A),:LABEL,p"


def nested(depth, table):
    """Columns in a chain ``depth`` levels deep, parts and references by turns, the table at the end."""
    column = {"name": f"c{depth}", "table": table}
    for k in reversed(range(depth)):
        column = {"name": f"c{k}", "columns": [column]} if k % 2 else {"name": f"c{k}", "referenced-column": column}
    return column


def test_columns_of_any_depth(frame):
    objects = [{"graph-object-type": "Node", "schema": "s", "mappings": [{"field": {"type": "Id"}, "column": nested(d, f"t{d}")} for d in (0, 1, 3, 4, 17)]}]
    got = files_frame(frame, *objects).orderBy("entry_no").collect()
    assert [(r["columns"], r["source_table"]) for r in got] == [([f"c{k}" for k in range(d + 1)], f"t{d}") for d in (0, 1, 3, 4, 17)]


def test_texts_that_are_no_mapping_file(frame):
    texts = [None, "", "no json", "{}", "[]", "[1, null]", '[{"mappings": 3}]', '[{"mappings": [5, {"column": 7}, {"column": {"columns": {}}}]}]']
    rows = G.mapping_entries(frame([(k, t) for k, t in enumerate(texts)], "fid int, text string"), "text", ["fid"]).collect()
    assert sorted((r["fid"], r["entry_no"], r["columns"], r["source_table"]) for r in rows) == [(7, 0, [], None), (7, 1, [], None), (7, 2, [], None)]


def test_compiled_mappings_are_those_written_by_hand(frame):
    from tableloom.plans import structures as S

    pair = G.NodeMapping("Pair", "pairs", ("x", "y"), {"x": "x"}, "db.Pairs")
    link = G.EdgeMapping("linked", "pairs", ("db.Pairs", ("x", "y")), ("db.Pairs", ("y", "x")), {})
    text = S.graph_text([*S.NODES, pair], [*S.EDGES, link])
    got = G.compile_graph(G.mapping_entries(frame([(text,)], "text string"), "text", []))
    assert got[0] == [G.NodeMapping(m.label, f"local.{m.table}", m.key, m.properties, m.id_space) for m in [*S.NODES, pair]]
    assert got[1] == [G.EdgeMapping(m.type, f"local.{m.table}", m.start, m.end, m.properties) for m in [*S.EDGES, link]]


def test_mapping_rows_are_made_without_joins(frame):
    entries = files_frame(frame, STOCK)
    for rows in (G.node_mapping_rows, G.relationship_mapping_rows, G.relationship_property_rows):
        plan = rows(entries, ["fid"])._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


def test_edges_of_known_keys_make_an_id_only_where_it_is_read(frame):
    df = frame([(1, "a", 5), (None, "a", 6), (2, None, 7), (3, "b", None)], "k int, part string, owner int")
    made = G.edges(df, G.EdgeMapping("has", "t", ("Note", ("k", "part")), ("Owner", ("owner",))))
    assert [tuple(r) for r in made.collect()] == [("Note:1:a", "Owner:5", "HAS")]
    # Counting the owners makes no id of a note.
    assert "Note" not in made.groupBy("dst").count()._jdf.queryExecution().optimizedPlan().toString()
